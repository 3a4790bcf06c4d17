"""Packing of documents into training sequences by cutting-stock column generation.

A document's ids, with an end id, are cut into pieces of SEQUENCE ids and one rest. Piece lengths are rounded up to BIN ids,
which gives a histogram of at most SEQUENCE / BIN lengths whatever the corpus. A linear program over patterns (how many
pieces of each length share a sequence) is solved by a revised simplex whose columns are priced by an integer knapsack. It
starts from a largest-first packing, prices at a mix of the basis' prices and the best feasible ones so far (whose sum over
the demand is a lower bound), and ends only when it is within GAP of that bound or no pattern is worth more than 1. The patterns' rounded counts, and a largest-first packing of what
rounding leaves, become slots. In Spark every piece gets its rank among the pieces of its length and takes the slot of that
rank, by a join with the table of slots, which is broadcast: at most (SEQUENCE / BIN) ** 2 rows of the basis' patterns and
as many again for the rest, 2 MB or so, whatever the corpus.

Ids are those of the tokenizers library for the same file (see bpe.py). Padding comes from rounding lengths: half a BIN a piece.

Defined results: null and empty texts are one piece, the end id. Repeated rows are packed one by one; ties of length are ranked
by id and start. Very long texts are encoded whole and cut. Only doc_id and text are read, whatever other columns are called.
No rows, no rows.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bpe import for_ids, vocabulary
from .shared import in_arrow, stored, table

SEQUENCE = 4096
BIN = 16
END_ID = 2
#: How far the linear program may be from its optimum.
GAP = 1e-4
#: How far pricing is pulled to the best feasible prices.
PULL = 0.9
#: Rounds after which the inverse is computed anew, against rounding errors.
REFRESH = 200
#: Pieces ranked together in one window.
RANKED = 20_000


def pieces(docs: DataFrame, path: str, sequence: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): every document cut at multiples of `sequence` ids."""
    end = int(end_id).to_bytes(4, "little")

    def run(batches):
        e = for_ids(path)
        for b in batches:
            rows = []
            for key, numbers in zip(b.column(0).to_pylist(), e.texts([t or "" for t in b.column(1).to_pylist()]), strict=True):
                raw = e.ids_of(numbers).astype("<u4").tobytes() + end
                n = len(raw) // 4
                for at in range(0, n, sequence):
                    part = raw[4 * at : 4 * (at + sequence)]
                    rows.append((key, at, len(part) // 4, zlib.crc32(part), n))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.column(0).type), *(pa.array(c, pa.int64()) for c in cols[1:])], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return in_arrow(docs.select("doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long")


def priced(value: np.ndarray, weight: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Integer knapsack by dynamic programming: the best total value in `room`, and how many of each item."""
    best, took = np.zeros(room + 1), np.full(room + 1, -1)
    useful = np.flatnonzero(value > 1e-12)
    w, v = weight[useful], value[useful]
    for c in range(1, room + 1):
        fit = np.searchsorted(w, c, "right")
        best[c] = best[c - 1]
        if fit:
            sums = v[:fit] + best[c - w[:fit]]
            k = int(np.argmax(sums))
            if sums[k] > best[c] + 1e-15:
                best[c], took[c] = sums[k], k
    many, c = np.zeros(len(value)), room
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            many[useful[took[c]]] += 1
            c -= w[took[c]]
    return float(best[room]), many


def largest_first(weight: np.ndarray, left: np.ndarray, room: int) -> list[tuple[int, np.ndarray]]:
    """(count, items): a pattern of the largest lengths left, as often as it fits, until nothing is left."""
    left, made = left.copy(), []
    while left.any():
        items, free = np.zeros(len(weight), dtype=np.int64), room
        for k in np.flatnonzero(left)[::-1].tolist():
            take = min(int(left[k]), free // int(weight[k]))
            items[k], free = take, free - take * int(weight[k])
        n = int((left[items > 0] // items[items > 0]).min())
        made.append((n, items))
        left -= n * items
    return made


def inverted(a: np.ndarray) -> np.ndarray:
    """The inverse by Gauss-Jordan elimination. (LAPACK's threads can wait for ever in a driver that has started a JVM.)"""
    m = len(a)
    both = np.hstack((a, np.eye(m)))
    for k in range(m):
        p = k + int(np.argmax(np.abs(both[k:, k])))
        both[[k, p]] = both[[p, k]]
        both[k] /= both[k, k]
        factor = both[:, k].copy()
        factor[k] = 0
        both -= factor[:, None] * both[k][None, :]
    return both[:, m:]


def solved(weight: np.ndarray, demand: np.ndarray, room: int, gap: float = GAP) -> tuple[np.ndarray, np.ndarray, float]:
    """The basis (a pattern a column), how often each pattern is used, and a lower bound on the number of sequences."""
    m = len(weight)
    aim = demand + np.arange(1, m + 1) / (m * 1e5)  # apart from each other, so that no pivot is degenerate and none can return
    basis, left = np.zeros((m, m)), aim.copy()
    for _ in range(m):  # largest first, in fractions: each pattern uses up one length, which makes it that length's column
        items, free = np.zeros(m), room
        for k in np.flatnonzero(left > 0)[::-1].tolist():
            items[k] = min(free // weight[k], math.ceil(left[k]))
            free -= int(items[k]) * int(weight[k])
        some = np.flatnonzero(items)
        out = some[np.argmin(left[some] / items[some])]
        basis[:, out] = items
        left = np.maximum(left - left[out] / items[out] * items, 0)
        left[out] = -1
    inverse = inverted(basis)
    x = np.maximum(inverse @ aim, 0)
    # prices that no pattern is worth more than 1 at; their sum over the demand is a lower bound. Lengths beyond room - t count
    # whole, below t not at all, the others by their length.
    steps = [np.where(weight > room - t, 1.0, np.where(weight >= t, weight / room, 0.0)) for t in range(room // 2 + 1)]
    center = max(steps, key=lambda c: float(c @ demand))
    bound, rounds = float(center @ demand), 0
    while x.sum() > bound * (1 + gap):
        dual, pull = inverse.sum(axis=0), PULL
        while True:  # prices halfway to the best center jump about less; if they find no better pattern, those of the basis do
            mixed = pull * center + (1 - pull) * dual
            value, column = priced(mixed, weight, room)
            if mixed @ demand > bound * max(value, 1.0):
                center = mixed / max(value, 1.0)
                bound = float(center @ demand)
            better = dual @ column > 1 + 1e-9
            if better or pull == 0 or x.sum() <= bound * (1 + gap):
                break
            pull = pull / 2 if pull > 0.1 else 0.0
        if not better:
            break
        d = inverse @ column
        ratio = np.where(d > 1e-9, x / np.where(d > 1e-9, d, 1), np.inf)
        out = int(np.argmin(ratio))
        rounds += 1
        basis[:, out] = column
        if rounds % REFRESH:
            pivot = inverse[out] / d[out]
            inverse = inverse - np.outer(d, pivot)
            inverse[out] = pivot
        else:
            inverse = inverted(basis)
        x = np.maximum(inverse @ aim, 0)
    return basis, np.maximum(inverse @ demand, 0), bound


def patterns(weight: np.ndarray, demand: np.ndarray, room: int) -> list[tuple[int, np.ndarray]]:
    """(count, items of each length) that together hold exactly the demand. weight: ascending, 1 to room."""
    basis, x, _ = solved(weight, demand, room)
    left, chosen = demand.astype(np.int64).copy(), []
    for j in np.argsort(-x):
        items = basis[:, j].astype(np.int64)
        n = int(x[j] + 1e-6)
        if (items > 0).any():
            n = min(n, int((left[items > 0] // items[items > 0]).min()))
        if n > 0:
            chosen.append((n, items))
            left = left - n * items
    return chosen + largest_first(weight, left, room)


def packed(spark: SparkSession, cut: DataFrame, sequence: int = SEQUENCE, width: int = BIN) -> DataFrame:
    """cut with sequence_id and offset. cut: a stored table of pieces of 1 to `sequence` ids."""
    binned = cut.withColumn("p_bin", F.ceil(F.col("length") / width).cast("int"))
    hist = binned.groupBy("p_bin").agg(F.count("*").alias("n")).orderBy("p_bin").collect()
    weight, demand = np.array([r["p_bin"] for r in hist], dtype=np.int64), np.array([r["n"] for r in hist], dtype=np.float64)
    slots, base, done = [], 0, np.zeros(len(weight), dtype=np.int64)
    for n, items in patterns(weight, demand, sequence // width) if len(weight) else []:
        for k in np.flatnonzero(items):
            slots.append((int(weight[k]), int(done[k]), int(done[k] + n * items[k]), int(items[k]), base))
            done[k] += n * items[k]
        base += n
    slot = spark.createDataFrame(slots, "p_bin int, lo long, hi long, per long, first long")
    salts = max(1, int(demand.sum()) // RANKED)
    salted = binned.withColumn("p_salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(salts)).cast("int"))
    sizes = salted.groupBy("p_bin", "p_salt").agg(F.count("*").alias("n"))
    before = sizes.select("p_bin", "p_salt", (F.sum("n").over(Window.partitionBy("p_bin").orderBy("p_salt")) - F.col("n")).alias("before"))
    local = F.row_number().over(Window.partitionBy("p_bin", "p_salt").orderBy("doc_id", "start", "ids_crc32")) - 1
    ranked = salted.withColumn("p_at", local).join(before, ["p_bin", "p_salt"]).withColumn("p_rank", F.col("p_at") + F.col("before"))
    placed = ranked.join(F.broadcast(slot), (ranked["p_bin"] == slot["p_bin"]) & (F.col("p_rank") >= F.col("lo")) & (F.col("p_rank") < F.col("hi"))).drop(slot["p_bin"])
    placed = placed.withColumn("sequence_id", F.col("first") + F.floor((F.col("p_rank") - F.col("lo")) / F.col("per")).cast("long"))
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("p_bin"), "p_rank").rowsBetween(Window.unboundedPreceding, 0)
    return placed.withColumn("offset", F.sum("length").over(inside) - F.col("length")).select(*cut.columns, "sequence_id", "offset")


def pack(spark: SparkSession, docs: DataFrame, path: str, sequence: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """The pieces of docs(doc_id, text) with their places."""
    return packed(spark, stored(spark, pieces(docs, path, sequence, end_id), "pieces"), sequence)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark, table(spark, sf_dir, "documents"), vocabulary())
