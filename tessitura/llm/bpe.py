"""BPE encoding and decoding with the merges of a tokenizers file whose words are independent (lower-cased, white space
dropped, word ends marked).

Texts are cut into the pieces that merge on their own; each distinct piece of a partition is encoded once and kept in a bounded
table, so texts are put together by look-ups. New pieces are encoded all at once by a pair occurrence index: every adjacent pair
of symbols is mapped to all its positions, active ranks are applied in ascending order, each at all its positions together,
and the pairs to the left and right of each merge join the lists of their own ranks.

Defined results: null texts are empty; empty texts give no ids and an empty decoded text. Repeated rows are encoded one by one, from
the same table of pieces. Equal pairs that overlap (as in `aaa`) merge from the left, as the library does. Very long texts are
encoded whole, piece by piece. Only the key and the text are read, whatever other columns are called. No rows, no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import count, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .shared import in_arrow, table

#: Distinct pieces beyond which a Python worker empties its table before the next texts.
MAX_KEPT = 600_000
#: Code points looked at before new pieces are encoded together, in whole texts.
MAX_SEEN = 24_000_000
#: Symbols merged at once: bounds the memory of the pair index.
MAX_SYMBOLS = 2_000_000
#: Code points that the file's normalizer takes as white space (fixed values).
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
PIECES = regex.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[\\p{{L}}]+|[\\p{{N}}]|[^{WHITE}\\p{{L}}\\p{{N}}]+")
#: The same for texts of U+0000 to U+00FF, which are in normal form; the standard library is quicker with them.
LATIN = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^\t-\r \x85\xa0a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff0-9\xb2\xb3\xb9\xbc-\xbe]+")


def _is_latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: printable Latin-1 as itself, the rest from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Merges:
    """Vocabulary and ranked merges of a tokenizers JSON file, as arrays."""

    def __init__(self, path: str):
        spec = json.loads(open(path, encoding="utf-8").read())
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.token = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right = (np.array([vocab[p[k]] for p in pairs], dtype=np.int64) for k in (0, 1))
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        self.made = made
        key = (left << 20) | right
        order = np.argsort(key, kind="stable")
        self.key, self.rank = key[order], order
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], dtype=np.int64)
        self.last = np.array([vocab[c + self.suffix] for c in letters], dtype=np.int64)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 if no merge joins it."""
        key = (a << 20) | b
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.rank[at], -1)

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, list[int]]:
        """The ids of all pieces in one array, and where each piece's ids begin (and the last end)."""
        size = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        data = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        ends = np.cumsum(size)
        symbol = self.inner[data]
        symbol[ends - 1] = self.last[data[ends - 1]]
        n = len(symbol)
        after = np.arange(1, n + 1)  # next living symbol of the piece, n for none
        after[ends - 1] = n
        before = np.arange(-1, n - 1)
        before[ends - size] = -1
        alive = np.ones(n, dtype=bool)
        lists: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def index(at: np.ndarray) -> None:
            """Adds the pairs that start at these positions."""
            at = at[after[at] < n]
            r = self.ranks(symbol[at], symbol[after[at]])
            keep = r >= 0
            at, r = at[keep], r[keep]
            order = np.argsort(r, kind="stable")
            at, r = at[order], r[order]
            cut = np.flatnonzero(np.diff(r)) + 1
            for rank, some in zip(r[np.concatenate(([0], cut))].tolist() if len(r) else (), np.split(at, cut), strict=False):
                if rank not in lists:
                    lists[rank] = []
                    heapq.heappush(heap, rank)
                lists[rank].append(some)

        index(np.arange(n))
        while heap:
            rank = heapq.heappop(heap)
            at = lists.pop(rank)
            at = at[0] if len(at) == 1 else np.concatenate(at)
            at = at[alive[at]]
            at = at[after[at] < n]
            at = at[self.ranks(symbol[at], symbol[after[at]]) == rank]
            if not len(at):
                continue
            at = np.sort(at)
            at = at[np.concatenate(([True], at[1:] != at[:-1]))]
            nxt = after[at]
            if len(at) > 1 and (nxt[:-1] == at[1:]).any():  # runs such as aaa: from the left, every other pair
                run = np.concatenate(([True], nxt[:-1] != at[1:]))
                start = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - start) % 2 == 0]
                nxt = after[at]
            symbol[at] = self.made[rank]
            alive[nxt] = False
            beyond = after[nxt]
            after[at] = beyond
            inside = beyond < n
            before[beyond[inside]] = at[inside]
            back = before[at]
            index(np.concatenate((at, back[back >= 0])))
        kept = np.flatnonzero(alive)
        counts = np.add.reduceat(alive.astype(np.int64), ends - size)
        return symbol[kept], [0, *np.cumsum(counts).tolist()]


@lru_cache(maxsize=2)
def merges(path: str) -> Merges:
    return Merges(path)


def lowered(text: str) -> str:
    """Lower case one code point at a time: a last sigma is no exception."""
    return text.lower() if text.isascii() or "Σ" not in text else "".join(c.lower() for c in text)


class Encoder:
    """Texts to numbers of pieces, and pieces to ids, with a bounded table of the pieces met."""

    def __init__(self, path: str, of_piece: Callable | None = None):
        """of_piece(ids, bounds): a list with an item for each new piece, kept in `items`."""
        self.m, self.of_piece = merges(path), of_piece
        self.empty()

    def empty(self) -> None:
        self.number: dict[str, int] = defaultdict(count().__next__)  # a piece met for the first time gets the next number
        self.ids, self.at = np.zeros(0, dtype=np.int32), np.zeros(1, dtype=np.int64)
        self.items: list = []

    def pieces(self, text: str) -> list[str]:
        """The pieces that merge on their own. A special token is written with a space before it, which no piece has."""
        if self.m.specials and "<|" in text:
            out = []
            for part in self.m.specials.split(text):
                out += [" " + part] if part in self.m.special else self._plain(part)
            return out
        return self._plain(text)

    @staticmethod
    def _plain(text: str) -> list[str]:
        low = text.lower()
        if low.isascii() or _is_latin(low):
            return LATIN.findall(low)
        return PIECES.findall(lowered(unicodedata.normalize("NFC", text)))

    def learn(self) -> None:
        """Encodes the pieces that have a number but no ids yet."""
        fresh = list(islice(self.number, len(self.at) - 1, None))
        ids, sizes, at = [self.ids], [], 0
        while at < len(fresh):
            some, bulk = [], 0
            while at < len(fresh) and (not some or bulk < MAX_SYMBOLS) and fresh[at][0] != " ":
                some.append(fresh[at].encode())
                bulk += len(some[-1])
                at += 1
            if some:
                got, bounds = self.m.merge(some)
            else:
                got, bounds = np.array([self.m.special[fresh[at][1:]]]), [0, 1]
                at += 1
            ids.append(got.astype(np.int32))
            sizes.append(np.diff(bounds))
            if self.of_piece:
                self.items += self.of_piece(got, bounds)
        self.ids = np.concatenate(ids)
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(np.concatenate(sizes))]) if sizes else self.at

    def texts(self, texts: list[str]) -> Iterator[np.ndarray]:
        """For each text the numbers of its pieces; their ids are known when it is given out."""
        at = 0
        while at < len(texts):
            if len(self.number) > MAX_KEPT:
                self.empty()
            to, seen, numbers = at, 0, []
            while to < len(texts) and (to == at or seen < MAX_SEEN):
                got = self.pieces(texts[to])
                numbers.append(np.fromiter(map(self.number.__getitem__, got), dtype=np.int32, count=len(got)))
                seen += len(texts[to])
                to += 1
            self.learn()
            yield from numbers
            at = to

    def ids_of(self, numbers: np.ndarray) -> np.ndarray:
        start, size = self.at[numbers], self.at[numbers + 1] - self.at[numbers]
        end = np.cumsum(size)
        return self.ids[np.repeat(start - end + size, size) + np.arange(end[-1])] if len(numbers) else self.ids[:0]


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def for_ids(path: str) -> Encoder:
    """One for each worker, kept between its tasks."""
    if (path, "ids") not in _ENCODERS:
        _ENCODERS[path, "ids"] = Encoder(path)
    return _ENCODERS[path, "ids"]


def for_strings(path: str) -> Encoder:
    """One whose items are (number of ids, decimal ids, tokens), both with one space between."""
    if (path, "strings") not in _ENCODERS:
        token = {i: t.encode() for i, t in merges(path).token.items()}

        def of_piece(ids, bounds):
            one = ids.tolist()
            number, name = [b"%d" % i for i in one], [token[i] for i in one]
            return [(b" ".join(number[i:j]), b" ".join(name[i:j])) for i, j in zip(bounds, bounds[1:], strict=False)]

        _ENCODERS[path, "strings"] = Encoder(path, of_piece)
    return _ENCODERS[path, "strings"]


def strings(e: Encoder, numbers: np.ndarray) -> tuple[int, bytes, bytes]:
    """Number of ids, the ids in decimal and the tokens, both with one space between."""
    items = list(map(e.items.__getitem__, numbers.tolist()))
    ids, tokens = zip(*items, strict=True) if items else ((), ())
    return int((e.at[numbers + 1] - e.at[numbers]).sum()), b" ".join(ids), b" ".join(tokens)


def coded(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", digests: bool = False) -> DataFrame:
    """(key, n_tokens, ids, decoded): the ids in decimal with one space between, and the tokens with one space between, which
    is what decoding gives for a file without a decoder. digests: ids_sha256 and decoded_sha256 instead, made in the task, so
    that the long strings needn't leave it."""
    names = ["ids_sha256", "decoded_sha256"] if digests else ["ids", "decoded"]
    last = (lambda x: hashlib.sha256(x).hexdigest()) if digests else bytes.decode

    def run(batches):
        e = for_strings(path)
        for b in batches:
            n, ids, decoded = [], [], []
            for numbers in e.texts([t or "" for t in b.column(1).to_pylist()]):
                size, i, d = strings(e, numbers)
                n.append(size)
                ids.append(last(i))
                decoded.append(last(d))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["k", "n_tokens", *names])

    return in_arrow(docs.select(key, text), run, f"k {docs.schema[key].dataType.simpleString()}, n_tokens long, {names[0]} string, {names[1]} string").withColumnRenamed("k", key)


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coded(table(spark, sf_dir, "documents"), vocabulary(), digests=True)
