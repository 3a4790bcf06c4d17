"""Language identification by rank-order profiles of letter n-grams (1 to 3 letters, words padded with one space).

A profile is a language's PROFILE most frequent n-grams in rank order, learned from labelled rows. A document's own most
frequent n-grams are compared with each profile: an n-gram's distance is the difference of its ranks, or PROFILE if the
profile lacks it. The language with the least sum wins; the score is 1 minus that sum over the largest possible one.

Defined results: null and empty texts and texts without a letter are `und` with score 0; so is everything if nothing was
learned, from an empty table for example. Ties of n-grams go to the smaller one, ties of languages to the one that sorts
first. Repeated rows are judged one by one. Very long texts are read whole, in slices of bounded memory. `judged` carries the
input in a struct, so its columns can have any names.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import in_arrow, table

PROFILE = 400
#: Labelled rows a language is learned from, about: a hash of the key picks them if there are more.
LEARN_ROWS = 4000
#: Code points counted together.
SLICE = 1 << 18


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point its lower-case letter, or a space."""
    out = np.full(0x110000, 32, dtype=np.uint32)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            low = c.lower()
            out[cp] = ord(low) if len(low) == 1 else cp
    return out


def counted(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, n-gram, count), sorted by text and n-gram; a few texts of SLICE code points together at most."""
    codes = _letters()[np.frombuffer("".join(f" {t} " for t in texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    owner = np.repeat(np.arange(len(texts), dtype=np.int64), np.fromiter((len(t) + 2 for t in texts), dtype=np.int64, count=len(texts)))
    alphabet, small = np.unique(codes, return_inverse=True)  # fewer bits a letter, so that one sort of 64-bit numbers counts all
    bits = max(1, int(len(alphabet)).bit_length())
    space = int(np.searchsorted(alphabet, 32))
    if 3 * bits + 2 + int(len(texts)).bit_length() > 63:  # very many letters and texts
        half = len(texts) // 2
        a, b = counted(texts[:half]), counted(texts[half:])
        return tuple(np.concatenate((x, y + half if k == 0 else y)) for k, (x, y) in enumerate(zip(a, b, strict=True)))
    c = small.astype(np.int64)
    c = np.where(c == space, 0, c + 1) if space < len(alphabet) and alphabet[space] == 32 else c + 1
    letter = c > 0
    pair = (c[:-1] << bits) | c[1:]
    parts = []
    base = owner << (3 * bits + 2)
    parts.append((base | c)[letter])
    two = letter[:-1] | letter[1:]
    parts.append((base[:-1] | (1 << (3 * bits)) | pair)[two])
    three = letter[1:-1] & (letter[:-2] | letter[2:])
    parts.append((base[:-2] | (2 << (3 * bits)) | (pair[:-1] << bits) | c[2:])[three])
    key = np.sort(np.concatenate(parts))
    new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, dtype=np.int64)
    count = np.diff(np.append(new, len(key)))
    key = key[new]
    text, rest = key >> (3 * bits + 2), key & ((1 << (3 * bits + 2)) - 1)
    size, body = rest >> (3 * bits), rest & ((1 << (3 * bits)) - 1)
    full = np.concatenate(([32], alphabet)).astype(np.int64)
    mask = (1 << bits) - 1
    one, second, third = full[body & mask], full[(body >> bits) & mask], full[(body >> (2 * bits)) & mask]
    gram = np.where(size == 0, one, np.where(size == 1, (second << 21) | one, (third << 42) | (second << 21) | one))
    return text, gram, count


def slices(texts: list[str], most: int = SLICE):
    """Runs (first, texts) of at most `most` code points, or one longer text."""
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) + 2 <= most):
            size += len(texts[to]) + 2
            to += 1
        yield at, texts[at:to]
        at = to


def learned(spark: SparkSession, labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = LEARN_ROWS, size: int = PROFILE) -> dict[str, np.ndarray]:
    """Profiles from labelled rows. Languages with more than `rows` rows give a share picked by a hash of the key."""
    few = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l"))
    share = few.groupBy("l").agg(F.least(F.lit(1.0), F.lit(float(rows)) / F.count("*")).alias("share"))
    picked = few.join(F.broadcast(share), "l").where(F.pmod(F.xxhash64("k"), F.lit(1 << 20)) < F.col("share") * (1 << 20)).select("l", "t")

    def count(batches):
        for b in batches:
            langs, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for name in sorted(set(langs)):
                for _, some in slices([t for t, x in zip(texts, langs, strict=True) if x == name]):
                    _, gram, n = counted(some)
                    order = np.argsort(gram, kind="stable")
                    gram, n = gram[order], n[order]
                    new = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1]))) if len(gram) else np.zeros(0, dtype=np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(new), pa.string()), pa.array(gram[new]), pa.array(np.add.reduceat(n, new) if len(new) else np.zeros(0, dtype=np.int64))], ["l", "g", "n"])

    total = in_arrow(picked, count, "l string, g long, n long").groupBy("l", "g").agg(F.sum("n").alias("n"))
    ranked = total.withColumn("r", F.row_number().over(Window.partitionBy("l").orderBy(F.desc("n"), "g"))).where(F.col("r") <= size)
    found: dict[str, list] = {}
    for row in ranked.orderBy("l", "r").collect():  # size rows a language
        found.setdefault(row["l"], []).append(row["g"])
    return {k: np.array(v, dtype=np.int64) for k, v in found.items()}


def judged(docs: DataFrame, profiles: dict[str, np.ndarray], text: str = "text", size: int = PROFILE) -> DataFrame:
    """(d, lang_pred, score): every row of docs as the struct d, with its language. Only the text is used."""
    names = sorted(profiles)
    gram = np.concatenate([profiles[x] for x in names]) if names else np.zeros(0, dtype=np.int64)
    known = np.unique(gram)
    rank = np.full((len(names), len(known) + 1), -1, dtype=np.int64)  # the last column: unknown
    for i, x in enumerate(names):
        rank[i, np.searchsorted(known, profiles[x])] = np.arange(len(profiles[x]))

    def judge(texts: list[str]) -> tuple[list[str], list[float]]:
        owner, gram, n = counted(texts)
        order = np.lexsort((gram, -n, owner))
        owner, gram = owner[order], gram[order]
        first = np.searchsorted(owner, np.arange(len(texts) + 1))
        place = np.arange(len(owner)) - first[owner]
        top = place < size
        owner, gram, place = owner[top], gram[top], place[top]
        at = np.searchsorted(known, gram)
        at = np.where((at < len(known)) & (known[np.minimum(at, max(len(known) - 1, 0))] == gram), at, len(known)) if len(known) else np.zeros(len(gram), dtype=np.int64)
        far = np.empty((len(names), len(texts)))
        for i in range(len(names)):
            r = rank[i, at]
            far[i] = np.bincount(owner, np.where(r >= 0, np.minimum(np.abs(r - place), size), size), len(texts))
        many = np.bincount(owner, minlength=len(texts))
        if not names:
            return ["und"] * len(texts), [0.0] * len(texts)
        best = np.argmin(far, axis=0)
        score = 1 - far[best, np.arange(len(texts))] / np.maximum(many * size, 1)
        return [names[b] if m else "und" for b, m in zip(best, many, strict=True)], np.where(many > 0, score, 0.0).tolist()

    def run(batches):
        for b in batches:
            langs, scores = [], []
            for _, some in slices([t or "" for t in b.column(0).field(place).to_pylist()]):
                x, y = judge(some)
                langs += x
                scores += y
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["d", "lang_pred", "score"])

    place = docs.columns.index(text)
    whole = docs.select(F.struct("*").alias("d"))
    return in_arrow(whole, run, f"d {whole.schema['d'].dataType.simpleString()}, lang_pred string, score double")


def held_out(key: str = "doc_id"):
    return F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2


def filter_language(spark: SparkSession, docs: DataFrame, least: float = 0.3) -> DataFrame:
    """Documents whose language is told with a score of at least `least`, with the columns they came with. Short documents
    score lower because few of their n-grams repeat, so `least` is low; texts without letters go."""
    profiles = learned(spark, docs.where(~held_out()).select("doc_id", "text", "lang"))
    return judged(docs, profiles).where((F.col("lang_pred") != "und") & (F.col("score") >= least)).select("d.*")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = learned(spark, docs.where(~held_out()).select("doc_id", "text", "lang"))
    return judged(docs.select("doc_id", held_out().alias("held_out"), "text"), profiles).select("d.doc_id", "d.held_out", "lang_pred", "score")
