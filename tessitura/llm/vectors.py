"""Near-duplicate vectors by an inverted multi-index.

Two codebooks, one for each half of the vectors, are fitted by k-means on a bounded sample (SAMPLE vectors, picked by a hash of
the id) and span a grid of cells. Every vector resides in the cell of its nearest centroids and probes the cells nearest to it
in the order of the multi-sequence traversal: ascending sum of the two squared distances. How many cells are probed is set on
the sample: for vectors moved in a random direction to exactly the threshold, TARGET of their cells must be among them. Since
a pair is found from either side, the recall of links is higher than that. Cells of a grid row are grouped so that a group holds
about RESIDENTS vectors; larger groups (copies) are split into blocks, as are their visitors, so that no task holds more than a
bounded number of either. Candidates are verified by cosine in double precision; a task gives counts and a spanning forest, not
pairs. Equal vectors are one class from the start.

The nearest cells are taken all at once instead of from a heap: of the pairs of ranks (r, s) in both sorted lists only those
with (r + 1) * (s + 1) <= probes can be among them, which gives the cells that the traversal visits. Vectors of different
lengths never link, so each length has an index of its own.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing, count no links and
are kept. Rows that repeat a vec_id are the same vector; a null vec_id gets a null component, is kept and links nothing. Ties
(a cosine of exactly the threshold) link. Very long vectors are read in batches of rows. Only vec_id and embedding are read,
whatever other columns are called. No rows, no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import connected, in_arrow, stored, table

THRESHOLD = 0.95
SAMPLE = 20_000
#: Centroids of a half at most, and vectors of a cell on average.
MAX_CENTROIDS, OCCUPANCY = 1024, 32
TARGET = 0.99
RESIDENTS, VISITORS = 4096, 16_384


def matrix(column) -> np.ndarray:
    """A list column of equal lengths as rows of unit length, in double precision."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = np.asarray(column.flatten()).astype(np.float64)
    x = flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))
    return x / np.sqrt((x * x).sum(axis=1))[:, None] if len(column) else x


def kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k centroids (fewer for fewer distinct points); always the same for the same sample."""
    rng = np.random.default_rng(7)
    points = np.unique(x, axis=0)
    c = points[rng.permutation(len(points))[:k]]
    for _ in range(rounds):
        at = np.argmin(distances(x, c), axis=1)
        n = np.bincount(at, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ c.T + (c * c).sum(axis=1)[None, :], 0)


class Grid:
    """Codebooks of both halves and the number of cells to probe."""

    def __init__(self, sample: np.ndarray, rows: int, threshold: float = THRESHOLD, target: float = TARGET):
        k = min(MAX_CENTROIDS, max(1, math.isqrt(max(0, rows - 1) // OCCUPANCY) + 1))
        self.half = max(1, sample.shape[1] // 2)
        self.one, self.two = kmeans(sample[:, : self.half], k), kmeans(sample[:, self.half :], k)
        self.wide = max(1, math.ceil(len(self.two) / max(1, math.ceil(rows / len(self.one) / RESIDENTS))))  # cells of a group
        self.probes = self._fitted(sample, threshold, target)

    def _fitted(self, sample: np.ndarray, threshold: float, target: float) -> int:
        rng = np.random.default_rng(11)
        x = sample[rng.permutation(len(sample))[:2000]]
        side = rng.standard_normal(x.shape)
        side -= (side * x).sum(axis=1)[:, None] * x
        size = np.sqrt((side * side).sum(axis=1))
        x, side, size = x[size > 0], side[size > 0], size[size > 0]
        if not len(x):
            return 1
        y = threshold * x + math.sqrt(1 - threshold**2) * side / size[:, None]
        a, b = self.far(x)
        i, j = self.cells(y)
        row = np.arange(len(x))
        goal = a[row, i] + b[row, j]
        before = np.array([int(np.searchsorted(np.sort((a[r][a[r] <= goal[r], None] + b[r][None, b[r] <= goal[r]]).ravel()), goal[r], "left")) for r in range(len(x))])
        return int(np.quantile(before, target, method="higher")) + 1

    def far(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return distances(x[:, : self.half], self.one), distances(x[:, self.half :], self.two)

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.far(x)
        return np.argmin(a, axis=1), np.argmin(b, axis=1)

    def group(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return i * (len(self.two) // self.wide + 1) + j // self.wide

    def visits(self, x: np.ndarray) -> list[np.ndarray]:
        """The groups of the `probes` nearest cells of each vector. In both sorted lists only pairs of ranks (r, s) with
        (r + 1) * (s + 1) <= probes can be among them."""
        a, b = self.far(x)
        first, second = np.argsort(a, axis=1, kind="stable"), np.argsort(b, axis=1, kind="stable")
        t = self.probes
        r, s = np.array([(r, s) for r in range(min(t, a.shape[1])) for s in range(min(t // (r + 1), b.shape[1]))]).T
        row = np.arange(len(x))[:, None]
        i, j = first[:, r], second[:, s]
        sums = a[row, i] + b[row, j]
        if sums.shape[1] > t:
            near = np.argpartition(sums, t - 1, axis=1)[:, :t]
            i, j = i[row, near], j[row, near]
        return [np.unique(g) for g in self.group(i, j)]


def _placed(vectors: DataFrame, grid: Grid, kind: str) -> DataFrame:
    """(id, home, visits, v): each vector's own group and those it probes."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                x = matrix(part.column(1))
                visits = grid.visits(x)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(grid.group(*grid.cells(x)), pa.int64()), pa.array(visits, pa.list_(pa.int64())), part.column(1)], ["id", "home", "visits", "v"])

    return in_arrow(vectors.select("id", "v"), run, f"id long, home long, visits array<long>, v {kind}")


def _met(key, group):
    """Counts of links, and a spanning forest, of one block of residents and one of visitors."""
    here, many = np.asarray(group.column("here").combine_chunks().to_numpy(zero_copy_only=False)).astype(bool), np.asarray(group.column("many"))
    ids, home = np.asarray(group.column("id")), np.asarray(group.column("home"))
    x = matrix(group.column("v"))
    lists = group.column("visits").combine_chunks()
    bounds, flat = np.asarray(lists.offsets), np.asarray(lists.values)
    r, q = np.flatnonzero(here), np.flatnonzero(~here)
    probed = np.unique(np.stack((np.repeat(np.arange(len(ids)), np.diff(bounds)), flat[bounds[0] : bounds[-1]])), axis=1)
    span = int(max(home.max(), probed[1].max(initial=0))) + 1
    probed = np.sort(probed[0] * span + probed[1])
    left, right = [], []
    for at in range(0, len(q), 512):
        some = q[at : at + 512]
        a, b = np.nonzero(x[some] @ x[r].T >= THRESHOLD)
        a, b = some[a], r[b]
        other = ids[a] != ids[b]
        left.append(a[other])
        right.append(b[other])
    a, b = np.concatenate(left) if left else np.zeros(0, np.int64), np.concatenate(right) if right else np.zeros(0, np.int64)
    count = np.zeros(len(ids), dtype=np.int64)
    np.add.at(count, a, many[b])
    want = b * span + home[a]  # does the resident probe its visitor's group? then the pair is met there as well
    at = np.minimum(np.searchsorted(probed, want), max(len(probed) - 1, 0))
    alone = probed[at] != want if len(probed) else np.ones(len(want), dtype=bool)
    np.add.at(count, b[alone], many[a[alone]])
    label = np.arange(len(ids))
    while True:
        low = label.copy()
        np.minimum.at(low, a, label[b])
        np.minimum.at(low, b, label[a])
        low = low[low]
        if np.array_equal(low, label):
            break
        label = low
    node = np.flatnonzero(label != np.arange(len(ids)))
    got = np.flatnonzero(count)
    return pa.table({"a": pa.array(np.concatenate((ids[node], ids[got])), pa.int64()), "b": pa.array(np.concatenate((ids[label[node]], ids[got])), pa.int64()), "n": pa.array(np.concatenate((np.zeros(len(node), np.int64), count[got])), pa.int64())})


def _indexed(spark: SparkSession, named: DataFrame, total: int, kind: str) -> DataFrame:
    """(v, n_links, component_id) of a stored table of distinct vectors of one length (v, id, many)."""
    sample = named.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toArrow()
    grid = Grid(matrix(sample.column(0)), total)
    placed = stored(spark, _placed(named, grid, kind).join(named.select("id", "many"), "id"), "placed")
    homes = placed.groupBy(F.col("home").alias("g")).agg(F.count("*").alias("r"))
    visitors = placed.select(F.explode("visits").alias("g"), "id").groupBy("g").agg(F.count("*").alias("q"))
    blocks = homes.join(visitors, "g").select("g", F.ceil(F.col("r") / RESIDENTS).alias("nr"), F.ceil(F.col("q") / VISITORS).alias("nq"))
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    mine = placed.withColumn("g", F.col("home")).join(blocks, "g").withColumn("rb", F.pmod(F.xxhash64("id"), F.col("nr"))).withColumn("qb", spread(F.col("nq"))).withColumn("here", F.lit(True))
    theirs = placed.withColumn("g", F.explode("visits")).join(blocks, "g").withColumn("qb", F.pmod(F.xxhash64("id"), F.col("nq"))).withColumn("rb", spread(F.col("nr"))).withColumn("here", F.lit(False))
    columns = ["g", "rb", "qb", "here", "id", "home", "visits", "many", "v"]
    met = stored(spark, mine.select(columns).unionByName(theirs.select(columns)).groupBy("g", "rb", "qb").applyInArrow(_met, "a long, b long, n long"), "met")
    links = met.where("n > 0").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    parts = connected(spark, met.where("n = 0").select("a", "b"))
    return named.join(links, "id", "left").join(parts, "id", "left").select("v", (F.coalesce("n", F.lit(0)) + F.col("many") - 1).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))


def linked(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of rows(vec_id, embedding)."""
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"))
    kind = rows.schema["v"].dataType.simpleString()
    fine = F.coalesce(F.col("vec_id").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
    marked = rows.withColumn("fine", fine)
    named = stored(spark, marked.where("fine").groupBy("v").agg(F.min("vec_id").alias("id"), F.countDistinct("vec_id").alias("many"), F.size(F.col("v")).alias("size")), "vectors")
    out = marked.where(~F.col("fine")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    sizes = [(r["size"], r["n"]) for r in named.groupBy("size").agg(F.count("*").alias("n")).orderBy("size").collect()]  # a row a length
    alone = [size for size, n in sizes if n == 1]
    found = named.where(F.col("size").isin(alone)).select("v", (F.col("many") - 1).alias("n_links"), F.col("id").alias("component_id"))
    for size, n in sizes:
        if n > 1:
            found = found.unionByName(_indexed(spark, named.where(F.col("size") == size).select("v", "id", "many"), n, kind))
    if sizes:
        out = out.unionByName(marked.where("fine").join(found, "v").select("vec_id", "n_links", "component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def brute_links(rows: DataFrame, queries: DataFrame) -> DataFrame:
    """(vec_id, n_links) of the queries by comparing them with all rows, in blocks; to measure recall. queries: a bounded set."""
    q = queries.select("vec_id", "embedding").toArrow()
    ids, x = np.asarray(q.column(0)), matrix(q.column(1))

    def run(batches):
        for b in batches:
            y, other = matrix(b.column(1)), np.asarray(b.column(0))
            n = ((x @ y.T >= THRESHOLD) & (ids[:, None] != other[None, :])).sum(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64())], ["vec_id", "n"])

    return in_arrow(rows.select("vec_id", "embedding"), run, "vec_id long, n long").groupBy("vec_id").agg(F.sum("n").alias("n_links"))


def op3_vector_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(spark, table(spark, sf_dir, "embeddings"))
