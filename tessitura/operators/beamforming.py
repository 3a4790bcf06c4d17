"""Beamformers: weights by key and bin, applied by a join. weight(utt, f, ch, re, im); y = sum over channels of conj(w) x."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.signal import SPEED, at
from . import linalg as L


def beamformed(spec: DataFrame, weight: DataFrame, on: list[str] | None = None) -> DataFrame:
    """(utt, t, f, re, im). on: the columns that pick the weight, (utt, f, ch) by default."""
    w = weight.withColumnsRenamed({"re": "w_re", "im": "w_im"})
    y = at("w_").conj() * at()
    keys = [c for c in ("utt", "beam", "t", "f") if c in spec.columns or c in weight.columns]
    return spec.join(w, on or ["utt", "f", "ch"]).groupBy(*keys).agg(F.sum(y.re).alias("re"), F.sum(y.im).alias("im"))


def delay_and_sum(steer: DataFrame, channels: int) -> DataFrame:
    return steer.withColumns({"re": F.col("re") / channels, "im": F.col("im") / channels})


def diffuse(distance: np.ndarray, bins: int, sr: int, speed: float = SPEED, load: float = 0.1, normalized_sinc: bool = True) -> np.ndarray:
    """Coherence of a diffuse field, bins x channels x channels, with `load` on the diagonal. normalized_sinc keeps the usual
    practice of sin(pi x) / (pi x) at x = omega distance / speed."""
    x = np.arange(bins)[:, None, None] * math.pi * sr / (bins - 1) * distance / speed
    return (np.sinc(x) if normalized_sinc else np.sinc(x / math.pi)) + load * np.eye(len(distance))


def linear_distances(topo: tuple[float, ...]) -> np.ndarray:
    return np.abs(np.subtract.outer(topo, topo))


def circular_distances(around: int, radius: float) -> np.ndarray:
    k = np.subtract.outer(np.arange(around), np.arange(around))
    return 2 * radius * np.abs(np.sin(math.pi * k / around))


def super_directive(spark: SparkSession, steer: np.ndarray, coherence: np.ndarray) -> DataFrame:
    """(f, ch, re, im) = R^-1 d / (d^H R^-1 d). steer: bins x channels; a table of the geometry's size."""
    top = np.linalg.solve(coherence, steer[:, :, None])[:, :, 0]
    w = top / (steer.conj() * top).sum(axis=1)[:, None]
    rows = [(f, c, float(w[f, c].real), float(w[f, c].imag)) for f in range(w.shape[0]) for c in range(w.shape[1])]
    return spark.createDataFrame(rows, "f long, ch long, re double, im double")


def mvdr(rs: np.ndarray, rn: np.ndarray) -> np.ndarray:
    d = L.principal(rs)
    top = np.linalg.solve(L.loaded(rn), d[:, :, None])[:, :, 0]
    return top / (d.conj() * top).sum(axis=1)[:, None]


def mpdr(rs: np.ndarray, rn: np.ndarray, ry: np.ndarray, whiten: bool = False) -> np.ndarray:
    d = L.principal(rs, rn) if whiten else L.principal(rs)
    if whiten:
        mixed = (rn @ d[:, :, None])[:, :, 0]
        d = np.where(mixed.any(axis=1)[:, None], mixed, d)  # no noise at all: as if it were white
    top = np.linalg.solve(L.loaded(ry), d[:, :, None])[:, :, 0]
    return top / (d.conj() * top).sum(axis=1)[:, None]


def gevd(rs: np.ndarray, rn: np.ndarray) -> np.ndarray:
    return L.principal(rs, rn)


def pmwf(rs: np.ndarray, rn: np.ndarray, beta: float = 0.0, ref: int = 0, rank1: str | None = None) -> np.ndarray:
    """Parametric multichannel Wiener filter for one reference channel. Without speech its weights are 0, also for a beta of 0."""
    rs = {"eig": lambda: L.rank_one(rs), "gev": lambda: L.rank_one(rs, rn), None: lambda: rs}[rank1]()
    x = np.linalg.solve(L.loaded(rn), rs)
    total = beta + np.trace(x, axis1=1, axis2=2).real
    return x[:, :, ref] / np.where(total == 0, 1.0, total)[:, None]


#: Weights by name, from speech and noise covariances.
WEIGHTS = {"mvdr": mvdr, "gevd": gevd, "pmwf-0": lambda s, n: pmwf(s, n, 0.0), "pmwf-1": lambda s, n: pmwf(s, n, 1.0), "pmwf-eig": lambda s, n: pmwf(s, n, 0.0, 0, "eig"), "mpdr": lambda s, n: mpdr(s, n, s + n), "mpdr-whiten": lambda s, n: mpdr(s, n, s + n, True)}


def normalised(w: np.ndarray, rn: np.ndarray) -> np.ndarray:
    """Blind analytic normalisation: w times sqrt(w^H Rn Rn w) / (w^H Rn w)."""
    x = (rn @ w[:, :, None])[:, :, 0]
    return w * (np.sqrt((np.abs(x) ** 2).sum(axis=1)) / np.maximum((w.conj() * x).sum(axis=1).real, 1e-10))[:, None]


def supervised(spec: DataFrame, mask: DataFrame, kind, ban: bool = False, noise: DataFrame | None = None, block=None) -> DataFrame:
    """(utt, [blk,] f, ch, re, im): weights from a speech mask(utt, t, f, m), noise by 1 - m or its own mask. Spark sums both
    covariances in one pass; one kernel call solves a batch of bins. kind: a name in WEIGHTS, or a function of stacks of both covariances.
    A recording that lacks channels gets weights for those it has; a reference channel by number is counted among them."""
    keys = ["utt", "f"] if block is None else ["utt", "blk", "f"]
    solve = kind if callable(kind) else WEIGHTS[kind]
    kernel = (lambda s, n: normalised(solve(s, n), n)) if ban else solve
    return L.by_channel(L.per_row(L.two_covariances(spec, mask, noise, block), [*keys, "ch"], ["s", "n"], kernel, "w"), keys, "ch", "w")


def online(spec: DataFrame, mask: DataFrame, kind: str, chunk: int, alpha: float = 0.8, later: float | None = None) -> DataFrame:
    """(utt, t, f, re, im): the output of a beamformer whose covariances forget, with new weights every `chunk` frames from all
    that came up to and with them."""
    from .estimation import forgetting

    keys = ["utt", "chunk", "f"]
    c = forgetting(L.two_sums(spec, mask, block=F.floor(F.col("t") / chunk)), L.TWO, alpha, later)
    w = L.by_channel(L.per_row(L.two_packed(c, keys), [*keys, "ch"], ["s", "n"], WEIGHTS[kind], "w"), keys, "ch", "w")
    return beamformed(spec.withColumn("chunk", F.floor(F.col("t") / chunk)), w, [*keys, "ch"])


def reference_channel(spec: DataFrame, mask: DataFrame) -> DataFrame:
    """(utt, ref): the channel of the largest ratio of speech to noise power, summed over bins, for pmwf."""
    p = at().power()
    x = spec.join(mask, ["utt", "t", "f"]).groupBy("utt", "ch").agg(F.sum(F.col("m") * p).alias("s"), F.sum((1 - F.col("m")) * p).alias("n"))
    return x.groupBy("utt").agg(F.min_by("ch", F.struct((-F.col("s") / F.greatest("n", F.lit(1e-10))).alias("v"), F.col("ch"))).alias("ref"))


def pattern(steer: DataFrame, weight: DataFrame) -> DataFrame:
    """(a, f, gain): the response of weights (f, ch) in each direction."""
    w = weight.select("f", "ch", F.col("re").alias("w_re"), F.col("im").alias("w_im"))
    y = at("w_").conj() * at()
    return steer.join(F.broadcast(w), ["f", "ch"]).groupBy("a", "f").agg(F.sum(y.re).alias("re"), F.sum(y.im).alias("im")).select("a", "f", at().abs().alias("gain"))
