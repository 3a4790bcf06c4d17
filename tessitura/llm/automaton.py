"""Log-probabilities of texts under a smoothed n-gram model of the corpus, by a weighted backoff automaton.

The model. Level 1 is (c + 1) / (N + V + 1) for a token seen c times among N training tokens of V kinds. Each further level mixes
its counts with the level below, weighted by a Dirichlet prior (MacKay and Peto 1995): p(w | h) = (c(h w) + PRIOR p(w | h')) /
(c(h) + PRIOR), h' being h without its first token. So a context h that training has seen is a state; a continuation it has seen
is an arc that carries log10 p(w | h); and every other token takes the failure arc to the state of h', which carries
log10 (PRIOR / (c(h) + PRIOR)). One walk from left to right carries the state and adds up what it passes.

How it is dealt. Texts are dealt into blocks of about BLOCK bytes. A block's distinct n-grams with their training counts go, packed
and sorted by hash, to shards (ranges of the hash, as many as the corpus needs), which add the blocks' counts up and send each
block the totals of its own n-grams, in its order and without repeating them. A block then builds the part of the automaton
that its texts can reach and walks them, many pieces of text in step. So no table of the model, which grows with the corpus, is
broadcast or held by one task: a task holds a block or a shard. The blocks' shuffle serves both passes and the shards' serves the
scalar query for N and V; a block's digest makes sure that both passes met the same block. Tokens are compared as strings,
longer n-grams by 64-bit hashes.

Defined results: null and empty texts have one token, the end; so do blank ones. With nothing to learn from, N and V are 0 and
each token scores log10 1. A null key is not held out. Repeated rows count and score one by one. Very long texts are scored whole
(and make their block larger). An empty table gives an empty result. Only the named columns are read, so others can have any names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import LOWER, chunks, mix, paired, spaced, table

ORDER = 2
PRIOR = 300.0
#: Bytes of text of a block, and of all texts for one shard, about.
BLOCK, SHARD = 1 << 22, 1 << 23
#: Tokens that a lane of the walk reads.
LANE = 128
#: Hash of the token that ends every text; as a string it is empty.
END = np.uint64(0x5851F42D4C957F2D)


# ---------------------------------------------------------------- n-grams of a block

class Grams:
    """Distinct n-grams of some texts, by level. ids[k][i]: the (k + 1)-gram that ends at token i, or -1 where the text begins
    later. For each gram of level k: hash[k], parent[k] (it without its last token), last[k] (that token), shorter[k] (it without
    its first token), and order[k], the grams by hash."""

    def __init__(self, texts: pa.ChunkedArray, order: int):
        hashes, lengths, self.tokens = [], [], {}
        for _, data, offsets in chunks(texts, 1 << 20):
            low = LOWER[data]
            w = spaced(low, offsets)
            hashes.append(np.insert(w.hash, w.text[1:], END))
            lengths.append(np.diff(w.text) + 1)
            one, first = np.unique(w.hash, return_index=True)
            raw = low.tobytes()
            for h, a, b in zip(one.tolist(), w.start[first].tolist(), w.end[first].tolist(), strict=True):
                if h not in self.tokens:
                    self.tokens[h] = raw[a:b]
        self.tokens[int(END)] = b""
        h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.lengths = np.concatenate(lengths) if lengths else np.zeros(0, np.int64)
        self.begin = np.cumsum(self.lengths) - self.lengths
        kinds, first, one = np.unique(h, return_index=True, return_inverse=True)
        none = np.full(len(kinds), -1)
        self.n = len(kinds)
        self.ids, self.hash, self.parent, self.last, self.shorter, self.order = [one], [kinds], [none], [np.arange(self.n)], [none], [np.arange(self.n)]
        place = np.arange(len(h)) - np.repeat(self.begin, self.lengths)
        for k in range(1, order):
            at = np.flatnonzero(place >= k)
            code = self.ids[k - 1][at - 1] * self.n + one[at]
            kinds, first, inverse = np.unique(code, return_index=True, return_inverse=True)
            ids = np.full(len(h), -1)
            ids[at] = inverse
            parent, last = kinds // max(self.n, 1), kinds % max(self.n, 1)
            hashed = paired(self.hash[k - 1][parent], self.hash[0][last])
            for into, x in ((self.ids, ids), (self.hash, hashed), (self.parent, parent), (self.last, last), (self.shorter, self.ids[k - 1][at[first]]), (self.order, np.argsort(hashed, kind="stable"))):
                into.append(x)

    def counts(self, k: int, rows: np.ndarray) -> np.ndarray:
        """How often each gram of level k stands in the texts that `rows` marks."""
        inside = np.repeat(rows, self.lengths) & (self.ids[k] >= 0)
        return np.bincount(self.ids[k][inside], minlength=len(self.hash[k]))

    def digest(self) -> int:
        """Of the texts in this block, in any order of theirs."""
        ends = np.add.reduceat(mix(self.hash[0][self.ids[0]] + np.arange(len(self.ids[0]), dtype=np.uint64) - np.repeat(self.begin, self.lengths).astype(np.uint64)), self.begin) if len(self.begin) else np.zeros(0, np.uint64)
        return int(np.bitwise_xor.reduce(mix(ends + np.uint64(1)))) >> 1


def _planes(x: np.ndarray) -> bytes:
    """64-bit numbers, byte by byte of all of them, so that Spark's compression removes bytes that are all zero."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _numbers(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<u8").ravel()


def _cuts(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Where the shards begin and end in ascending hashes."""
    shard = ((hashes >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)
    return np.searchsorted(shard, np.arange(shards + 1, dtype=np.uint64))


_SENT = "block long, shard int, level int, hashes binary, tokens binary, counts binary, digest long"


def _gathered(order: int, shards: int):
    def run(key, rows):
        """A block's n-grams, one row a level and shard."""
        g = Grams(rows["text"], order)
        train, digest, out = rows["train"].to_numpy(zero_copy_only=False).astype(bool), g.digest(), []
        for k in range(order):
            by = g.order[k]
            h, n = g.hash[k][by], g.counts(k, train)[by]
            cuts = _cuts(h, shards)
            for s in np.flatnonzero(np.diff(cuts)).tolist():
                a, b = cuts[s], cuts[s + 1]
                tokens = b" ".join(g.tokens[x] for x in h[a:b].tolist()) if k == 0 else None
                out.append((key[0].as_py(), s, k, None if k == 0 else _planes(np.diff(h[a:b], prepend=np.uint64(0))), tokens, _planes(n[a:b]), digest))
        columns = list(zip(*out, strict=True)) if out else [()] * 7
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64())
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["block", "shard", "level", "hashes", "tokens", "counts", "digest"])

    return run


# ---------------------------------------------------------------- totals of a shard

def _summed(row_keys: list, row_counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(number of each given key, total of each number)."""
    if row_keys and isinstance(row_keys[0], np.ndarray):
        where = np.unique(np.concatenate(row_keys), return_inverse=True)[1]
    else:
        where = pa.concat_arrays(row_keys).dictionary_encode().indices.to_numpy() if row_keys else np.zeros(0, np.int64)
    counts = np.concatenate(row_counts).astype(np.int64) if row_counts else np.zeros(0, np.int64)
    total = np.zeros(int(where.max(initial=-1)) + 1, dtype=np.int64)
    np.add.at(total, where, counts)
    return where, total


def _level(rows: pa.Table, k: int) -> tuple[list[dict], np.ndarray, np.ndarray]:
    mine = [x for x in rows.to_pylist() if x["level"] == k]
    keys = [pa.array(x["tokens"].split(b" "), pa.binary()) if k == 0 else np.cumsum(_numbers(x["hashes"]), dtype=np.uint64) for x in mine]
    return mine, *_summed(keys, [_numbers(x["counts"]) for x in mine])


def _kinds(key, rows):
    """Training tokens of a shard and how many kinds they are of."""
    _, _, total = _level(rows.filter(pc.equal(rows["level"], 0)), 0)
    return pa.table({"n": [int(total.sum())], "v": [int((total > 0).sum())]})


def _totals(order: int):
    def run(key, rows):
        """For each block that sent n-grams, their totals over all blocks, in the order they came in."""
        out = []
        for k in range(order):
            mine, where, total = _level(rows.filter(pc.equal(rows["level"], k)), k)
            at = 0
            for x in mine:
                many = len(x["counts"]) // 8
                out.append((x["block"], key[0].as_py(), k, _planes(total[where[at : at + many]]), x["digest"]))
                at += many
        columns = list(zip(*out, strict=True)) if out else [()] * 5
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64())
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["block", "shard", "level", "totals", "digest"])

    return run


# ---------------------------------------------------------------- the automaton

class Automaton:
    """The part of the model that a block's texts can reach. State 0 is the empty context; `home` leads from each token to its
    arc there. Of the other arcs, `arc` holds state * tokens + token in ascending order, `weight` and `to` what they carry and
    where they lead; `fail` and `loss` are each state's failure arc."""

    def __init__(self, g: Grams, totals: list[np.ndarray], n: int, v: int, prior: float):
        p = [(totals[0] + 1) / (n + v + 1)]
        self.known = totals[0] > 0
        self.base = np.log10(p[0])
        state, arcs, fails, losses, states = [], [], [np.zeros(1, np.int64)], [np.zeros(1)], 1
        for k, total in enumerate(totals):
            below = totals[k - 1][g.parent[k]] if k else None
            if k:
                p.append((total + prior * p[k - 1][g.shorter[k]]) / (below + prior))
            if k == len(totals) - 1:
                break
            # a state is a gram seen in training that no text ends with; other grams stand for what is left of them
            real = (total > 0) & (g.hash[0][g.last[k]] != END)
            numbers = np.cumsum(real) - 1 + states
            shorter = state[k - 1][g.shorter[k]] if k else np.zeros(len(total), np.int64)
            state.append(np.where(real, numbers, shorter))
            fails.append(shorter[real])
            losses.append(np.log10(prior / (total[real] + prior)))
            states += int(real.sum())
        ends = g.hash[0] == END
        self.home = np.where(ends, 0, state[0] if state else 0)
        for k in range(1, len(totals)):
            seen = totals[k] > 0
            to = state[k][seen] if k < len(state) else state[k - 1][g.shorter[k][seen]]
            arcs.append((state[k - 1][g.parent[k][seen]] * g.n + g.last[k][seen], np.log10(p[k][seen]), np.where(ends[g.last[k][seen]], 0, to)))
        key, weight, to = (np.concatenate(x) for x in zip(*arcs, strict=True)) if arcs else (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))
        by = np.argsort(key)
        self.tokens, self.arc, self.weight, self.to = g.n, np.append(key[by], -1), np.append(weight[by], 0.0), np.append(to[by], 0)
        self.fail, self.loss = np.concatenate(fails), np.concatenate(losses)

    def step(self, state: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(next state, log-probability) of reading a token in each lane: failure arcs until there is an arc."""
        out, gained, left = np.empty_like(state), np.zeros(len(state)), np.arange(len(state))
        here = state.copy()
        while len(left):
            at_home = here == 0
            lane = left[at_home]
            out[lane] = self.home[token[lane]]
            gained[lane] += self.base[token[lane]]
            left, here = left[~at_home], here[~at_home]
            wanted = here * self.tokens + token[left]
            j = np.searchsorted(self.arc[:-1], wanted)
            hit = self.arc[j] == wanted
            out[left[hit]] = self.to[j[hit]]
            gained[left[hit]] += self.weight[j[hit]]
            left, here = left[~hit], here[~hit]
            gained[left] += self.loss[here]
            here = self.fail[here]
        return out, gained

    def walk(self, tokens: np.ndarray, begin: np.ndarray, lengths: np.ndarray, context: int) -> np.ndarray:
        """Log-probability of each text tokens[begin : begin + lengths]. Texts are cut into lanes that are read in step. A state
        depends on the last `context` tokens only, so a lane inside a text first reads those before it."""
        lanes = -(-lengths // LANE)
        owner = np.repeat(np.arange(len(lengths)), lanes)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        start = begin[owner] + nth * LANE
        size = np.minimum(LANE, begin[owner] + lengths[owner] - start)
        by = np.argsort(-size, kind="stable")
        owner, nth, start, size = owner[by], nth[by], start[by], size[by]
        state, gained = np.zeros(len(owner), np.int64), np.zeros(len(owner))
        for back in range(context, 0, -1):
            inside = np.flatnonzero(nth > 0)
            state[inside] = self.step(state[inside], tokens[start[inside] - back])[0]
        for k in range(int(size.max(initial=0))):
            on = int(np.searchsorted(-size, -k, "left"))  # lanes with more than k tokens
            state[:on], more = self.step(state[:on], tokens[start[:on] + k])
            gained[:on] += more
        return np.bincount(owner, gained, minlength=len(lengths))


def _scored(order: int, prior: float):
    def run(key, rows, totals):
        g = Grams(rows["text"], order)
        totals = totals.sort_by([("level", "ascending"), ("shard", "ascending")]).to_pylist()
        found = []
        for k in range(order):
            got = [_numbers(x["totals"]) for x in totals if x["level"] == k]
            total = np.zeros(len(g.hash[k]), dtype=np.int64)
            total[g.order[k]] = np.concatenate(got) if got else 0
            found.append(total)
        if totals[0]["digest"] != g.digest():
            raise RuntimeError("the input has been dealt anew while it was read; store it first")
        n, v = totals[0]["n"], totals[0]["v"]
        model = Automaton(g, found, n, v, prior)
        tokens = g.ids[0]
        sums = lambda x: np.add.reduceat(x, g.begin)  # noqa: E731  (no text is without a token)
        return pa.table([rows["key"], rows["held_out"], pa.array(g.lengths), pa.array(sums(model.known[tokens].astype(np.int64))), pa.array([n] * len(g.lengths), pa.int64()), pa.array(sums(model.base[tokens])), pa.array(model.walk(tokens, g.begin, g.lengths, order - 1))], names=["key", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def held_out(key: Column) -> Column:
    """Rows that the model doesn't learn from, by their key."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def scored(docs: DataFrame, key: str = "doc_id", text: str = "text", order: int = ORDER, prior: float = PRIOR, apart: Column | None = None) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row of docs, a stored table. apart: rows not to
    learn from, `held_out` unless given."""
    apart = held_out(F.col(key)) if apart is None else F.coalesce(apart, F.lit(False))
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text) + 8), F.lit(0))).first()[0]
    blocks, shards = max(1, -(-size // BLOCK)), max(1, -(-size // SHARD))
    block = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).alias("block")
    dealt = docs.select(block, F.col(key).alias("key"), F.col(text).alias("text"), apart.alias("held_out"), (~apart).alias("train"))
    by_block = dealt.groupBy("block")
    by_shard = by_block.applyInArrow(_gathered(order, shards), _SENT).groupBy("shard")
    known = by_shard.applyInArrow(_kinds, "n long, v long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("v"), F.lit(0)).alias("v"))
    totals = by_shard.applyInArrow(_totals(order), "block long, shard int, level int, totals binary, digest long")
    totals = totals.withColumn("n", known.select("n").scalar()).withColumn("v", known.select("v").scalar())
    kind = f"key {docs.schema[key].dataType.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return by_block.cogroup(totals.groupBy("block")).applyInArrow(_scored(order, prior), kind).withColumnRenamed("key", key)


def op11_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"))
