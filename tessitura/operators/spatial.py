"""Spatial features and source localisation on long-form spectra spec(utt, ch, t, f, re, im).

Steering tables steer(a, ch, f, re, im) have angles x microphones x bins rows, a constant of the geometry, so every task holds them."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.signal import EPSILON, SPEED, at, circular_delay, cis, linear_delay, omega, wrapped
from .linalg import matrices, per_row, principal, same_sizes
from .relational import channel_rows, microphone_pairs
from .steered import cross_correlations, each, of_channels, steering_array, summed
from .windows import clamped_average


def steering(spark: SparkSession, angles: int, bins: int, sr: int, topo: tuple[float, ...] = (), around: int = 0, radius: float = 0.0, centre: bool = False, speed: float = SPEED, normalize: bool = False) -> DataFrame:
    """(a, deg, ch, f, re, im): plane waves at a linear array (topo, 0 to 180 degrees inclusive) or a circular one (around and
    radius, steps of 360 / angles; a centre microphone comes first)."""
    grid = spark.range(angles).select(F.col("id").alias("a"))
    if topo:
        mics = spark.createDataFrame(list(enumerate(map(float, topo))), "ch long, p double")
        grid = grid.withColumn("deg", F.col("a") * (180.0 / (angles - 1))).join(F.broadcast(mics))
        delay, many = linear_delay(F.col("deg"), F.col("p"), speed), len(topo)
    else:
        mics = spark.range(around + centre).select(F.col("id").alias("ch"))
        grid = grid.withColumn("deg", F.col("a") * (360.0 / angles)).join(F.broadcast(mics))
        delay = circular_delay(F.col("deg"), F.col("ch") - int(centre), around, radius, speed)
        delay, many = F.when((F.col("ch") == 0) & F.lit(centre), 0.0).otherwise(delay), around + centre
    w = grid.join(F.broadcast(spark.range(bins).select(F.col("id").alias("f"))))
    z = cis(-omega(F.col("f"), bins, sr) * delay)
    size = math.sqrt(many) if normalize else 1.0
    return w.select("a", "deg", "ch", "f", (z.re / size).alias("re"), (z.im / size).alias("im"))


def phase_differences(spec: DataFrame, pairs: list[tuple[int, int]]) -> DataFrame:
    """(utt, t, f, i, j, ipd in [-pi, pi)) of the given channel pairs."""
    m = microphone_pairs(spec.withColumn("angle", at().angle()), ["utt", "t", "f"], ["angle"], ["utt", "t"])
    wanted = F.lit(False)
    for i, j in pairs:
        wanted = wanted | ((F.col("i") == i) & (F.col("j") == j))
    return m.where(wanted).select("utt", "t", "f", "i", "j", wrapped(F.col("angle1") - F.col("angle2")).alias("ipd"))


def coherence(spec: DataFrame, context: int, channels: int) -> DataFrame:
    """(utt, t, f, msc): mean over pairs of squared coherence of the spectra averaged over 2 * context + 1 frames (what exists
    of them)."""
    p = microphone_pairs(spec, ["utt", "t", "f"], ["re", "im"], ["utt", "f"])
    w = Window.partitionBy("utt", "f", "i", "j").orderBy("t").rowsBetween(-context, context)
    a, b = at(suffix="1"), at(suffix="2")
    x = a * b.conj()
    s = p.select("utt", "t", "f", F.avg(x.re).over(w).alias("re"), F.avg(x.im).over(w).alias("im"), F.avg(a.power()).over(w).alias("p1"), F.avg(b.power()).over(w).alias("p2"))
    return s.groupBy("utt", "t", "f").agg((F.sum(at().power() / (F.col("p1") * F.col("p2") + EPSILON)) * (2.0 / (channels * (channels - 1)))).alias("msc"))


def _pairwise(steer: DataFrame, pairs: list[tuple[int, int]]):
    """A kernel of cells with phases `angle`: the mean over pairs of the cosine between observed and steered phase differences."""
    channels, vectors = steering_array(steer)
    turn, at_ = np.angle(vectors), {int(c): k for k, c in enumerate(channels)}
    side = [(at_[i], at_[j]) for i, j in pairs]

    def kernel(b):
        there, angle = of_channels(b, ("angle",), channels)
        f = b.column("f").to_numpy(zero_copy_only=False)
        total, many = np.zeros((len(f), turn.shape[1])), np.zeros(len(f))
        for i, j in side:
            d = np.cos((angle[:, i] - angle[:, j])[:, None] - (turn[f, :, i] - turn[f, :, j]))
            good = there[:, i] & there[:, j] & np.isfinite(d).all(axis=1)
            total[good] += d[good]
            many += good
        return np.where(many[:, None] > 0, total / np.maximum(many, 1)[:, None], np.nan)

    return kernel


def _phases(spec: DataFrame, pairs: list[tuple[int, int]]) -> DataFrame:
    """The cells (utt, t, f, z) of the pairs' channels, with phases, dealt by frame."""
    return channel_rows(spec.where(F.col("ch").isin(*{c for p in pairs for c in p})).withColumn("angle", at().angle()), ["utt", "t", "f"], ["angle"], ["utt", "t"])


def directional(spec: DataFrame, steer: DataFrame, pairs: list[tuple[int, int]]) -> DataFrame:
    """(utt, t, f, a, df): mean over pairs of the cosine between observed and steered phase differences. Angles count from 0."""
    return each(_phases(spec, pairs), ["utt", "t", "f"], _pairwise(steer, pairs), "a", "df")


def directional_scores(spec: DataFrame, steer: DataFrame, pairs: list[tuple[int, int]]) -> DataFrame:
    """(utt, a, score): the directional features added over all cells."""
    return summed(_phases(spec, pairs), ["utt"], _pairwise(steer, pairs), "score")


def correlated(spec: DataFrame, delays: DataFrame, bins: int, sr: int) -> tuple[DataFrame, int]:
    """((utt, t, g, peak), pairs): generalised cross-correlations of every frame, see `cross_correlations`. delays(d, i, j, tau
    seconds), d counted from 0."""
    grid = delays.select("i", "j", "d", "tau").toPandas().sort_values(["i", "j", "d"])
    pairs = [(int(i), int(j)) for i, j in grid[["i", "j"]].drop_duplicates().itertuples(index=False)]
    tau = grid["tau"].to_numpy().reshape(len(pairs), -1)
    turns = math.pi * sr / (bins - 1) * np.arange(bins)
    return cross_correlations(_phases(spec, pairs), ["utt", "t"], pairs, tau, turns), len(pairs)


def srp_phat(spec: DataFrame, delays: DataFrame, bins: int, sr: int, channels: int, normalize: bool = True, floor: bool = True) -> DataFrame:
    """(utt, t, d, srp): steered response power with phase transform. delays(d, i, j, tau seconds): the grid of the array. Each pair
    is scaled by its largest magnitude in the utterance."""
    gcc, many = correlated(spec, delays, bins, sr)
    if normalize:
        most = gcc.select("utt", F.posexplode("peak").alias("p", "v")).groupBy("utt", "p").agg(F.max("v").alias("v"))
        most = most.groupBy("utt").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "v"))), lambda x: x["v"]).alias("most"))
        most = most.withColumnRenamed("utt", "of")
        gcc = gcc.join(most, F.col("utt").eqNullSafe(F.col("of"))).select("utt", "t", "g", "most")

    def kernel(b):
        g = b.column("g").flatten().to_numpy().reshape(b.num_rows, many, -1) / bins
        if normalize:
            g = g / np.maximum(b.column("most").flatten().to_numpy().reshape(b.num_rows, many, 1) / bins, EPSILON)
        return (np.maximum(g, 0.0) if floor else g).sum(axis=1) * (2.0 / (channels * (channels - 1)))

    return each(gcc, ["utt", "t"], kernel, "d", "srp")


def srp_smoothed(spec: DataFrame, delays: DataFrame, bins: int, sr: int, context: int = 0) -> DataFrame:
    """(utt, t, d, srp): the sum over pairs and bins, not scaled, then the mean of 2 * context + 1 frames (the first and last
    repeated beyond the ends), then no less than 0."""
    gcc, many = correlated(spec, delays, bins, sr)
    rows = each(gcc, ["utt", "t"], lambda b: b.column("g").flatten().to_numpy().reshape(b.num_rows, many, -1).sum(axis=1), "d", "x")
    rows = clamped_average(rows, ["utt", "d"], context) if context else rows.withColumn("s", F.col("x"))
    return rows.select("utt", "t", "d", F.greatest("s", F.lit(0.0)).alias("srp"))


def line_delays(spark: SparkSession, topo: tuple[float, ...], points: int, by_delay: bool = True, speed: float = SPEED) -> DataFrame:
    """(d, i, j, tau) of a linear array over all its pairs: equal steps of delay from the largest to the smallest, or of angle."""
    far = {(i, j): abs(topo[j] - topo[i]) / speed for i in range(len(topo)) for j in range(i + 1, len(topo))}
    at_ = (lambda d: 1 - 2 * d / (points - 1)) if by_delay else (lambda d: math.cos(d * math.pi / points))
    return spark.createDataFrame([(d, i, j, at_(d) * most) for (i, j), most in far.items() for d in range(points)], "d long, i long, j long, tau double")


def linear_delays(spark: SparkSession, topo: tuple[float, ...], angles: int, speed: float = SPEED) -> DataFrame:
    """(d, i, j, tau) of a linear array, 0 to 180 degrees."""
    rows = [(d, i, j, math.cos(math.pi * d / (angles - 1)) * (topo[i] - topo[j]) / speed) for d in range(angles) for i in range(len(topo)) for j in range(i + 1, len(topo))]
    return spark.createDataFrame(rows, "d long, i long, j long, tau double")


def diagonal_delays(spark: SparkSession, around: int, diameter: float, angles: int, pairs: list[tuple[int, int]], speed: float = SPEED) -> DataFrame:
    """(d, i, j, tau) of opposite microphones of a circular array, 0 to 360 degrees inclusive."""
    rows = [(d, i, j, -math.cos(2 * math.pi * (d / (angles - 1) - i / around)) * diameter / speed) for d in range(angles) for i, j in pairs]
    return spark.createDataFrame(rows, "d long, i long, j long, tau double")


def ml_likelihood(spec: DataFrame, steer: DataFrame, mask: Column | str | None = None, compression: float = 0.0, eps: float = EPSILON, keys: tuple[str, ...] = ("utt",)) -> DataFrame:
    """(keys, a, ll): log likelihood of directions, -sum of log(1 - |steer^H x|^2 / (|steer|^2 |x|^2)) over cells. |steer| goes over
    the channels that a cell has. mask: a column that is the same for all channels of a cell. Angles count from 0."""
    channels, vectors = steering_array(steer)
    size = np.abs(vectors) ** 2
    weight = F.col(mask) if isinstance(mask, str) else F.lit(1.0) if mask is None else mask
    cell = channel_rows(spec.withColumn("m", weight), [*keys, "t", "f"], ["re", "im", "m"], [*keys, "t"]).withColumn("m", F.element_at("z", 1)["m"].cast("double"))

    def kernel(b):
        there, re, im = of_channels(b, ("re", "im"), channels)
        x, f, m = re + 1j * im, b.column("f").to_numpy(zero_copy_only=False), b.column("m").to_numpy(zero_copy_only=False)
        power, out = (np.abs(x) ** 2).sum(axis=1), np.zeros((len(f), vectors.shape[1]))
        for k in np.unique(f):
            rows = np.flatnonzero(f == k)
            met = np.abs(x[rows] @ vectors[k].conj().T) ** 2
            ll = -np.log(np.maximum(1 - met / ((there[rows] @ size[k].T) * power[rows, None] + eps), eps))
            out[rows] = ll * (m[rows] * power[rows] ** compression)[:, None]
        return out

    return summed(cell, list(keys), kernel, "ll")


def music_scores(cov: DataFrame, steer: DataFrame) -> DataFrame:
    """(utt, a, e): what is left of steering vectors in the noise subspace of packed covariances (utt, f, r_ch, r_re, r_im), added over
    bins; the direction of the least is the source's. Bins that can't be decomposed add nothing. Channels that a recording or the
    steering table lacks take no part."""
    channels, vectors = steering_array(steer)
    apart = lambda r: np.eye(r.shape[-1]) - np.einsum("ni,nj->nij", principal(r), principal(r).conj())
    left = per_row(cov, ["utt", "f", "r_ch"], ["r"], apart, "p").where("p_re IS NOT NULL")

    def kernel(b):
        f, out = b.column("f").to_numpy(zero_copy_only=False), np.zeros((b.num_rows, vectors.shape[1]))
        for rows in same_sizes([b.column("p_re")]):
            ch, re, im = (b.column(c).take(pa.array(rows)) for c in ("r_ch", "p_re", "p_im"))
            ch = np.asarray(ch.flatten()).reshape(len(rows), -1)
            at = np.minimum(np.searchsorted(channels, ch), len(channels) - 1)
            a = np.take_along_axis(vectors[f[rows]], at[:, None, :], axis=2) * (channels[at] == ch)[:, None, :]
            out[rows] = np.einsum("nai,nij,naj->na", a.conj(), matrices(re, im), a, optimize=True).real
        return out

    return summed(left, ["utt"], kernel, "e")


def best_angle(score: DataFrame, value: str, largest: bool = True, keys: tuple[str, ...] = ("utt",)) -> DataFrame:
    """(keys, a): the first of the best angles."""
    v = -F.col(value) if largest else F.col(value)
    return score.groupBy(*keys).agg(F.min_by("a", F.struct(v.alias("v"), F.col("a"))).alias("a"))
