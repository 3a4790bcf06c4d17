"""Window operators over series (keys, t, x). Each partitions by the series' key; sequential ones are
prefix scans over blocks (scans)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import scans


def _w(keys: list[str], t: str = "t"):
    return Window.partitionBy(*keys).orderBy(t)


def taps(df: DataFrame, keys: list[str], count: int, delay: int, x: str = "x") -> DataFrame:
    """Columns tap0 ... with the values delay + k steps back, 0 before the start."""
    return df.select("*", *(F.lag(x, delay + k, 0.0).over(_w(keys)).alias(f"tap{k}") for k in range(count)))


def moving_average(df: DataFrame, keys: list[str], context: int, x: str = "x", floor: float | None = None) -> Column:
    """Centred mean over what exists of 2 * context + 1 values."""
    m = F.avg(x).over(_w(keys).rowsBetween(-context, context))
    return m if floor is None else F.greatest(m, F.lit(floor))


def clamped_average(df: DataFrame, keys: list[str], context: int, x: str = "x") -> DataFrame:
    """df with s: the centred mean of 2 * context + 1 values, the first and last repeated beyond the ends."""
    w, whole = _w(keys), Window.partitionBy(*keys)
    near = F.sum(x).over(w.rowsBetween(-context, context))
    at, n = F.row_number().over(w) - 1, F.count("*").over(whole)
    first, last = F.first(x).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.last(x).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    total = near + first * F.greatest(F.lit(context) - at, F.lit(0)) + last * F.greatest(at + context - (n - 1), F.lit(0))
    return df.withColumn("s", total / (2 * context + 1))


def folded(df: DataFrame, keys: list[str], x: str = "x") -> DataFrame:
    """(keys, xs): each series as an array in the order of t."""
    return df.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("t", x))), lambda z: z[x]).alias("xs"))


def impulse_answer(x: np.ndarray, h: np.ndarray) -> np.ndarray:
    """x convolved with h, cut to the length of x, by the fast Fourier transform."""
    if not len(x) or not len(h):
        return np.zeros(len(x))
    size = 1 << (len(x) + len(h) - 2).bit_length() if len(x) + len(h) > 2 else 1
    return np.fft.irfft(np.fft.rfft(x, size) * np.fft.rfft(h, size), size)[: len(x)] if size > 1 else x * h


def _arrays(xs: Column, kernel) -> Column:
    """kernel(array of numbers) for each row's array, by Arrow batches; null stays null."""

    @F.arrow_udf("array<double>")
    def run(column: pa.Array) -> pa.Array:
        return pa.array([None if not x.is_valid else kernel(np.asarray(x.values.to_numpy(zero_copy_only=False), dtype=np.float64)) for x in column], pa.list_(pa.float64()))

    return run(xs)


def smoothed(xs: Column, alpha: float) -> Column:
    """Array of s[t] = alpha s[t-1] + (1 - alpha) x[t], from s[0] = x[0], for short arrays; series of any length: scans.along."""
    return _arrays(xs, lambda x: scans.Exponential(alpha).run(x, None))


def running_minimum(df: DataFrame, keys: list[str], block: int, blocks: int, x: str = "x") -> DataFrame:
    """df with low: the minimum over the current block of `block` steps so far and the blocks - 1 blocks before."""
    b = df.withColumn("w_block", F.floor(F.col("t") / block))
    low = b.groupBy(*keys, "w_block").agg(F.min(x).alias("m")).withColumn("past", F.min("m").over(Window.partitionBy(*keys).orderBy("w_block").rangeBetween(1 - blocks, -1))).drop("m")
    so_far = F.min(x).over(Window.partitionBy(*keys, "w_block").orderBy("t").rowsBetween(Window.unboundedPreceding, 0))
    return b.withColumn("low", so_far).join(low, [*keys, "w_block"]).withColumn("low", F.least("low", "past")).drop("w_block", "past")


def neighbours(df: DataFrame, cell: list[str], weights: list[float], f: str = "f", x: str = "x") -> DataFrame:
    """df with s: the weighted sum over neighbouring f, zero outside. Equal to a convolution of the same size."""
    w = Window.partitionBy(*cell).orderBy(f)
    half = len(weights) // 2
    s = F.lit(0.0)
    for k, weight in enumerate(weights):
        step = half - k
        s = s + weight * F.coalesce(F.lag(x, -step).over(w) if step < 0 else F.lead(x, 0).over(w) if step == 0 else F.lead(x, step).over(w), F.lit(0.0))
    return df.withColumn("s", s)


def tumbling(t: Column, size: int) -> Column:
    return F.floor(t / size)


def tumbling_merged(t: Column, total: Column, size: int) -> Column:
    """Blocks of `size`, the ragged rest joined to the last whole one."""
    return F.least(F.floor(t / size), F.greatest(F.floor(total / size) - 1, F.lit(0)))


def hopping(df: DataFrame, size: int, back: int) -> DataFrame:
    """Rows times the chunks whose window [max(chunk * size - back, 0), chunk * size + size) holds them."""
    reach = F.sequence(F.floor(F.col("t") / size), F.floor((F.col("t") + back) / size))
    last = Window.partitionBy(*[c for c in df.columns if c in ("key", "utt")])
    return df.withColumn("w_last", F.floor(F.max("t").over(last) / size)).withColumn("chunk", F.explode(reach)).where("chunk <= w_last").drop("w_last")


def islands(df: DataFrame, keys: list[str], active: Column) -> DataFrame:
    """(keys, beg, end): stretches of consecutive active t."""
    on = df.where(active).withColumn("w_run", F.col("t") - F.row_number().over(_w(keys)))
    return on.groupBy(*keys, "w_run").agg(F.min("t").alias("beg"), F.max("t").alias("end")).drop("w_run")


def hysteresis(df: DataFrame, keys: list[str], cache: int, active: str = "active") -> DataFrame:
    """(keys, beg, end) of voice segments. A counter rises with active frames and, inside a segment, falls with others; a
    segment opens when it reaches `cache` (and then starts `cache` frames back, not before 0) and closes at 0. Outside a
    segment inactive frames don't lower the counter. An open segment closes with the last frame."""
    return scans.segments(df, keys, cache, active)


def gaps(segments: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, beg, end): what lies before and between segments; after the last one nothing is given."""
    before = F.lag("end", 1, 0).over(Window.partitionBy(*keys).orderBy("beg"))
    return segments.withColumn("w_b", before).where("w_b < beg").select(*keys, F.col("w_b").alias("beg"), F.col("beg").alias("end"))


def within(df: DataFrame, segments: DataFrame, keys: list[str], width: float | None = None) -> DataFrame:
    """Rows of df inside each segment [beg, end): a join by key and bin of time. A segment is dealt to all bins of `width` that it
    touches (the mean length of a segment unless given), a row to its own, so that rows meet the segments near them only."""
    if width is None:
        width = segments.agg(F.avg((F.col("end") - F.col("beg")).cast("double"))).first()[0]
    width = F.lit(max(float(width or 1.0), 1e-9))
    bins = F.sequence(F.floor(F.col("beg") / width), F.floor(F.col("end") / width))
    dealt = segments.where("beg < end").withColumn("w_bin", F.explode(bins))
    found = df.withColumn("w_bin", F.floor(F.col("t") / width)).join(dealt, [*keys, "w_bin"])
    return found.where((F.col("t") >= F.col("beg")) & (F.col("t") < F.col("end"))).drop("w_bin")


def repeated_to(xs: Column, n: int) -> Column:
    """An array repeated until it has n values."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.get(xs, (i % F.size(xs)).cast("int")))
