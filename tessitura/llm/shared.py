"""Helpers shared by the training-data operators: shared storage, hashing of words, connected components."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words: U+0020 and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where it is unset, a local master gets a temporary folder; a cluster, whose
    machines wouldn't share that folder, gets an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessitura-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: The folders stored within the innermost `scratch`, if any: of this thread or task only.
_OPEN: ContextVar[list[str] | None] = ContextVar("stored", default=None)


def stored(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: it cuts the lineage and survives lost executors."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if (own := _OPEN.get()) is not None:
        own.append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


@contextmanager
def scratch():
    """Collects the folders stored inside, in a list. Whoever opened it deletes them, with `forgotten`, once every result that
    reads them is written."""
    own: list[str] = []
    token = _OPEN.set(own)
    try:
        yield own
    finally:
        _OPEN.reset(token)


def forgotten(spark: SparkSession, paths: list[str]) -> None:
    """Deletes these stored folders, as far as they are still there."""
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def dropped(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes the files of tables made by `stored` that nothing reads any more."""
    forgotten(spark, [df.stored_at for df in tables])


#: Rows of an Arrow batch at most. Rows hold whole texts, so Spark's usual 10,000 would be large in both JVM and Python.
BATCH_ROWS = 2048
_ROWS_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def in_arrow(df: DataFrame, run, schema: str) -> DataFrame:
    """df.mapInArrow(run, schema) with batches of BATCH_ROWS rows at most. Spark has this bound for a session only, so the
    session's is lowered, and stays if it is lower already."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(_ROWS_SETTING, "0")) <= BATCH_ROWS:
        conf.set(_ROWS_SETTING, str(BATCH_ROWS))
    return df.mapInArrow(run, schema)


def words(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text as an array; null and blank texts have none."""
    bare = F.btrim(text, F.lit(SPACES))
    return F.when(F.length(bare) > 0, F.split(bare, "[\\x20\\x09-\\x0D]+")).otherwise(F.array().cast("array<string>"))


# ---------------------------------------------------------------- blocked Bloom filters

#: Blocks of 256 bits of a filter at most: about 10 MB as a broadcast table, whatever the number of keys.
MAX_BLOCKS = 1 << 17


def _block(key: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def _bits(key: Column) -> list[Column]:
    """The bit of a key in each of the eight 32-bit words of its block."""
    return [F.call_function("shiftleft", F.lit(1), (F.shiftrightunsigned(F.xxhash64(key, F.lit(k)), 40) % 32).cast("int")).alias(f"b{k}") for k in range(8)]


def bloom(keys: DataFrame, key: str, many: int) -> tuple[DataFrame, int]:
    """(blocks, number of blocks) of a blocked Bloom filter: about 16 bits for each of `many` keys, a power of two of blocks."""
    n = 1
    while n * 16 < many and n < MAX_BLOCKS:
        n *= 2
    keyed = keys.select(_block(F.col(key), n).alias("b_block"), *_bits(F.col(key)))
    return keyed.groupBy("b_block").agg(*(F.bit_or(f"b{k}").alias(f"f{k}") for k in range(8))), n


def _met(df: DataFrame, key: str, keys: DataFrame, many: int, how: str) -> tuple[DataFrame, Column]:
    """df joined to the filter's blocks, and whether the filter has a row's key."""
    blocks, n = bloom(keys, key, many)
    hit = F.lit(True)
    for k in range(8):
        bit = _bits(F.col(key))[k]
        hit = hit & (F.col(f"f{k}").bitwiseAND(bit) == bit)
    return df.withColumn("b_block", _block(F.col(key), n)).join(F.broadcast(blocks), "b_block", how), hit


def flagged(df: DataFrame, key: str, keys: DataFrame, many: int, flag: str) -> DataFrame:
    """df with a boolean `flag`: whether its key may be one of keys(key). True for all that are and few others, false for null
    keys."""
    found, hit = _met(df, key, keys, many, "left")
    return found.select(*df.columns, (F.col(key).isNotNull() & F.coalesce(hit, F.lit(False))).alias(flag))


def sifted(df: DataFrame, key: str, keys: DataFrame, many: int, maybe: bool = True) -> DataFrame:
    """Rows of df whose key may be one of keys(key): all that are and few others. maybe=False: those that certainly aren't one,
    null keys included. The filter is broadcast within its bound; with more keys than it has room for it lets more rows pass."""
    found, hit = _met(df, key, keys, many, "inner" if maybe else "left")
    return found.where(hit if maybe else ~F.coalesce(hit, F.lit(False))).select(*df.columns)


# ---------------------------------------------------------------- words of Arrow batches, hashed with numpy

_SEED = np.random.default_rng(20240229)
_BYTE = _SEED.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_POWERS: dict[str, np.ndarray] = {}
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(1 << 18, n)
        for name, base in (("up", _BASE), ("down", _INV)):
            x = np.full(size, base, dtype=np.uint64)
            x[0] = 1
            _POWERS[name] = np.multiply.accumulate(x)
    return _POWERS["up"], _POWERS["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes in this order."""
    return mix(a * np.uint64(0xD6E8FEB86659FD93) + mix(b + np.uint64(0x2545F4914F6CDD1D)))


class Words:
    """Words of some texts: hash, first and last byte of each, and where each text's words begin."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, inside: np.ndarray):
        """inside: for each byte whether it belongs to a word."""
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[offsets] = True
        before = np.zeros(len(data), dtype=bool)
        if len(data):
            before[1:] = inside[:-1]
        first = inside & (~before | edge[:-1])
        after = np.zeros(len(data), dtype=bool)
        if len(data):
            after[:-1] = inside[1:]
        last = inside & (~after | edge[1:])
        self.data, self.start, self.end = data, np.flatnonzero(first), np.flatnonzero(last) + 1
        self.text = np.searchsorted(self.start, offsets)  # text i has words text[i] to text[i+1]
        up, down = _powers(len(data) + 1)
        total = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
        self.hash = mix((total[self.end] - total[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64))

    def __len__(self) -> int:
        return len(self.start)

    def owner(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(len(self.text) - 1), np.diff(self.text))


def chunks(column: pa.Array | pa.ChunkedArray, most: int = 1 << 18):
    """Slices (first row, bytes, offsets) of a string column of about `most` bytes at most, or one longer text; null: empty. Rows
    count from the column's first one, whatever chunks it is made of."""
    before = 0
    for one in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        one = one.fill_null("").cast(pa.large_string())
        offsets = np.frombuffer(one.buffers()[1], dtype=np.int64)[one.offset : one.offset + len(one) + 1] if len(one) else np.zeros(1, np.int64)
        data = np.frombuffer(one.buffers()[2], dtype=np.uint8) if len(one) and one.buffers()[2] else np.zeros(0, np.uint8)
        at = 0
        while at < len(one):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
            yield before + at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            at = to
        before += len(one)


def spaced(data: np.ndarray, offsets: np.ndarray) -> Words:
    """The words between white space."""
    return Words(data, offsets, ~_IS_SPACE[data])


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive word hashes, at each start; the last k-1 starts have none. Built by doubling."""
    if len(h) < k:
        return np.zeros(0, dtype=np.uint64)
    size, x = 1, h
    while size * 2 <= k:
        x = paired(x[:-size], x[size:])
        size *= 2
    return x if size == k else paired(x[: len(h) - k + 1], x[k - size : k - size + len(h) - k + 1])


# ---------------------------------------------------------------- connected components

def _stars(e: DataFrame) -> bool:
    """Whether each id has one smaller neighbour at most, and that one has none: then edges(a, b), a > b, name components."""
    ends = e.select(F.col("a").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(e.select(F.col("b").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR (up > 0 AND down > 0)").isEmpty()


def connected(spark: SparkSession, edges: DataFrame, name: str = "components") -> DataFrame:
    """(id, component_id) for every id in edges(a, b): the smallest id reachable, by alternating large-star and small-star
    contraction until only stars are left. Each round is a few joins and map-side combined minima, so no node's links meet in one
    task; rounds grow with the logarithm of the diameter and are written to the shared folder. Edges that are stars from the
    outset, or none, need no round."""
    e = stored(spark, edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    while not _stars(e):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        new = stored(spark, small.distinct(), name)
        dropped(spark, e)
        e = new
    return e.select(F.col("a").alias("id"), F.col("b").alias("component_id")).unionByName(e.select(F.col("b").alias("id"), F.col("b").alias("component_id")).distinct())
