"""Operators on keyed collections: look-ups, joins, shards and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.places import scratch


def _ranged(df: DataFrame, keys: list[str]) -> DataFrame:
    """df dealt into key ranges and written once, with r_part, its range: later steps read the same ranges, whatever is retried."""
    path = scratch(df.sparkSession, "ranged")
    df.repartitionByRange(*keys).withColumn("r_part", F.spark_partition_id()).write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _shifted(ranged: DataFrame, keys: list[str], inner: Column, size: Column, name: str) -> DataFrame:
    """ranged with `name`: a running number inside each range plus the sizes of the ranges before. One row a range is numbered
    in one task, no more."""
    sizes = ranged.groupBy("r_part").agg(size.alias("r_n"))
    before = sizes.select("r_part", F.coalesce(F.sum("r_n").over(Window.orderBy("r_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("r_before"))
    return ranged.withColumn("r_in", inner.over(Window.partitionBy("r_part").orderBy(*keys))).join(F.broadcast(before), "r_part").withColumn(name, F.col("r_in") + F.col("r_before")).drop("r_part", "r_in", "r_before")


def ordinal(df: DataFrame, key: str) -> DataFrame:
    """df with pos, its place in key order from 0. Places are counted by key ranges, so no task holds all rows."""
    return _shifted(_ranged(df, [key]), [key], F.row_number(), F.count("*"), "pos").withColumn("pos", F.col("pos") - 1)


def lookup(df: DataFrame, default: DataFrame, key: str, value: str, fallback) -> DataFrame:
    """df with `value` from a map table, `fallback` where the map has no such key. The map's size is up to the caller; Spark
    picks the join by its statistics."""
    return df.join(default.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(fallback)))


def sample_keys(df: DataFrame, key: str, n: int, seed: int = 777) -> DataFrame:
    """n keys without replacement, picked by a seeded hash of the key: the same for any partitioning."""
    return df.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)


def strict_join(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Inner join that fails if b lacks a key of a."""
    joined = a.join(b.withColumn("r_found", F.lit(True)), key, "left")
    return joined.withColumn(key, F.when(F.col("r_found"), F.col(key)).otherwise(F.raise_error(F.concat(F.lit("no such key: "), F.col(key).cast("string"))))).drop("r_found")


def common_keys(tables: list[DataFrame], key: str) -> DataFrame:
    """Keys that every table has."""
    tagged = reduce(DataFrame.unionByName, [t.select(key, F.lit(i).alias("r_table")) for i, t in enumerate(tables)])
    return tagged.groupBy(key).agg(F.countDistinct("r_table").alias("n")).where(F.col("n") == len(tables)).select(key)


def semi(df: DataFrame, ids: DataFrame, key: str, exclude: bool = False) -> DataFrame:
    return df.join(ids.select(key).distinct(), key, "left_anti" if exclude else "left_semi")


def join_report(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """How many keys of a b has, and how many are skipped."""
    found = a.join(b.select(key).distinct().withColumn("r_found", F.lit(1)), key, "left")
    return found.agg(F.count("r_found").alias("done"), (F.count("*") - F.count("r_found")).alias("skipped"))


def chunked(df: DataFrame, key: str, chunks: int) -> DataFrame:
    """df with chunk: nearly equal contiguous pieces in key order, the first ones one row longer."""
    n = df.count()
    small, more = divmod(n, chunks)
    pos = F.col("pos")
    chunk = F.when(pos < more * (small + 1), F.floor(pos / (small + 1))).otherwise(more + F.floor((pos - more * (small + 1)) / max(small, 1)))
    return ordinal(df, key).withColumn("chunk", (chunk + 1).cast("long")).drop("pos")


def chunked_by_speaker(df: DataFrame, spk: str, chunks: int) -> DataFrame:
    """df with chunk: all rows of a speaker in one, speakers in order, chunks nearly even in rows: a speaker goes where the middle
    of its rows lies among all rows in speaker order. Fails if there are fewer speakers than chunks."""
    size = df.groupBy(spk).agg(F.count("*").alias("r_size"))
    if size.limit(chunks).count() < chunks:
        raise ValueError("fewer speakers than chunks")
    at = _shifted(_ranged(size, [spk]), [spk], F.sum("r_size"), F.sum("r_size"), "r_end")
    total = F.lit(df.count())
    chunk = F.least(F.floor((F.col("r_end") - F.col("r_size") / 2) * chunks / total), F.lit(chunks - 1)) + 1
    return df.join(at.select(spk, chunk.cast("long").alias("chunk")), spk)


def stacked(df: DataFrame, keys: list[str]) -> DataFrame:
    """df with row: the place of its frame when all matrices are stacked in key order. Offsets are prefix sums of the matrices'
    sizes by key ranges."""
    size = df.groupBy(*keys).agg(F.countDistinct("t").alias("r_size"))
    at = _shifted(_ranged(size, keys), keys, F.sum("r_size"), F.sum("r_size"), "r_at").select(*keys, (F.col("r_at") - F.col("r_size")).alias("r_at"))
    return df.join(at, keys).withColumn("row", F.col("r_at") + F.col("t")).drop("r_at")


def beside(parts: list[DataFrame], width: int) -> DataFrame:
    """Matrices side by side: f of part p moves by p * width."""
    return reduce(DataFrame.unionByName, [p.withColumn("f", F.col("f") + i * width) for i, p in enumerate(parts)])


def transposed(df: DataFrame, hermitian: bool = False) -> DataFrame:
    """(i, j) swapped, conjugated if hermitian."""
    out = df.withColumnsRenamed({"i": "r_j", "j": "i"}).withColumnRenamed("r_j", "j")
    return out.withColumn("im", -F.col("im")) if hermitian else out


def channel_rows(df: DataFrame, cell: list[str], value: list[str], by: list[str] | None = None) -> DataFrame:
    """(cell, z): one row a cell with its channels as an array of (ch, value), in order. by: deal rows by these of the cell's
    columns, so that what follows by them needs no further shuffle."""
    dealt = df.select(*cell, "ch", *value)
    return (dealt.repartition(*by) if by else dealt).groupBy(*cell).agg(F.array_sort(F.collect_list(F.struct("ch", *value))).alias("z"))


def microphone_pairs(df: DataFrame, cell: list[str], value: list[str], by: list[str] | None = None) -> DataFrame:
    """Rows of two channels i < j of a cell: value columns get suffixes 1 and 2. Pairs are made inside the cell's row."""
    pairs = F.flatten(F.transform("z", lambda a, k: F.transform(F.slice(F.col("z"), k + 2, F.size("z")), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    p = channel_rows(df, cell, value, by).select(*cell, F.explode(pairs).alias("p"))
    return p.select(*cell, F.col("p.a.ch").alias("i"), F.col("p.b.ch").alias("j"), *(F.col(f"p.a.{v}").alias(v + "1") for v in value), *(F.col(f"p.b.{v}").alias(v + "2") for v in value))


def first_best(df: DataFrame, keys: list[str], value: str, order: str, largest: bool = True) -> DataFrame:
    """Each group's row with the largest (or smallest) value; ties go to the smallest `order`. A map-side combined minimum."""
    sign = -1 if largest else 1
    best = F.min_by(F.struct(*[c for c in df.columns if c not in keys]), F.struct((sign * F.col(value)).alias("v"), F.col(order).alias("o")))
    return df.groupBy(*keys).agg(best.alias("r_best")).select(*keys, "r_best.*")


def class_report(df: DataFrame, cls: str, value: Column, missing: str = "NG") -> DataFrame:
    """(cls, n, mean) by class and for all (cls = ALL)."""
    named = df.select(F.coalesce(F.col(cls), F.lit(missing)).alias("cls"), value.alias("v"))
    return named.rollup("cls").agg(F.count("*").alias("n"), F.avg("v").alias("mean")).withColumn("cls", F.coalesce("cls", F.lit("ALL")))


def ratio_report(df: DataFrame, cls: str, part: str, whole: str) -> DataFrame:
    """(cls, rate) = 100 * sum(part) / sum(whole), null for an empty whole."""
    s = df.rollup(cls).agg(F.sum(part).alias("p"), F.sum(whole).alias("w"))
    return s.select(F.coalesce(cls, F.lit("ALL")).alias("cls"), (100 * F.col("p") / F.nullif(F.col("w"), F.lit(0))).alias("rate"))
