"""Queries of counts, sorted reports, dense algebra in long form and further simulation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.signal import at
from ..operators import linalg as L
from ..operators import masks as K
from ..operators import relational as R
from ..operators import simulation as S
from ..operators import spatial as P
from . import fixtures as X
from .arrays import COV, GCC, MASK, mask
from .fixtures import ROWS, SAMPLES, SERIES, STFT, r6
from .spectral import spec

V = f"WITH {SAMPLES}"
SPEC = f"{V}, {STFT}"


def win07(spark, d):
    """Where a series' running sum first passes half of its total."""
    w = Window.partitionBy("key")
    x = X.series(spark, d).select("key", "t", F.sum("x").over(w.orderBy("t").rowsBetween(Window.unboundedPreceding, 0)).alias("run"), F.sum("x").over(w).alias("total"))
    return x.where("run > 0.5 * total").groupBy("key").agg(F.min("t").alias("t"))


def agg10(spark, d):
    clipped = F.count_if(F.col("x") > 40)
    return X.rows(spark, d).groupBy("utt").agg(F.count("*").alias("done"), clipped.alias("clipped"), F.round(100 * clipped / F.count("*"), 6).alias("percent"))


def agg11(spark, d):
    x = X.series(spark, d)
    return x.groupBy("key").agg(F.round(K.silent_share(F.col("x") * F.col("x"), 40.0), 6).alias("silent"))


def agg13(spark, d):
    p = R.microphone_pairs(X.samples(spark, d), ["utt", "n"], ["x"])
    return p.groupBy("utt", "n").agg(F.round(F.avg(F.col("x1") * F.col("x2")), 6).alias("m"))


def wide(spark, d):
    """(utt, i, j, re, im): all samples of four channels as a complex matrix."""
    return X.samples(spark, d).select("utt", F.col("ch").alias("i"), F.col("n").alias("j"), F.col("x").alias("re"), (F.col("x") * F.col("n") / 2).alias("im"))


def la01(spark, d):
    a = wide(spark, d)
    y = L.multiplied(a, R.transposed(a, hermitian=True), ["utt"])
    return y.select("utt", "i", "j", F.round("re", 6).alias("re"), F.round("im", 6).alias("im"))


def la01_vectors(spark, d):
    """y + 2 x, the inner product x^H y and the norm of the outer product x y^H of the first two channels' spectra, by frame."""
    z = spec(spark, d).where("ch < 2")
    p = R.microphone_pairs(z, ["utt", "t", "f"], ["re", "im"], ["utt", "t"])
    x, y = at(suffix="1"), at(suffix="2")
    q = x.conj() * y
    g = p.groupBy("utt", "t").agg(F.sum(q.re).alias("dot_re"), F.sum(q.im).alias("dot_im"), F.sum(y.re + 2 * x.re).alias("axpy_re"), F.sum(y.im + 2 * x.im).alias("axpy_im"), F.sqrt(F.sum(x.power()) * F.sum(y.power())).alias("ger"))
    return g.select("utt", "t", *(F.round(c, 6).alias(c) for c in ("dot_re", "dot_im", "axpy_re", "axpy_im", "ger")))


def la10(spark, d):
    c = L.covariance(spec(spark, d), mask(spark, d))
    return L.diagonal_added(c, 1.5).select("utt", "f", "i", "j", F.round("re", 6).alias("re"), F.round("im", 6).alias("im"))


def rel19(spark, d):
    """Channel-major spectra as one vector over channels for each bin."""
    z = F.array_sort(F.collect_list(F.struct("ch", "re", "im")))
    b = spec(spark, d).groupBy("utt", "f", "t").agg(z.alias("z"))
    return b.select("utt", "f", "t", F.size("z").cast("long").alias("channels"), F.round(F.element_at("z", 1)["re"], 6).alias("first"), F.round(F.element_at("z", -1)["re"], 6).alias("last"))


def sp06(spark, d):
    return P.srp_phat(spec(spark, d).where("ch < 2"), P.linear_delays(spark, X.TOPO[:2], 19), X.BINS, X.SR, 2).withColumn("srp", F.round("srp", 6))


def sim03(spark, d):
    """Noise as long as the speech at a given ratio."""
    x = X.samples(spark, d).where("ch = 0").select("utt", "n", "x")
    noise = X.wave(spark, d).where("ch = 2").select("utt", "x", F.lit(0).cast("long").alias("begin"), F.lit(5.0).alias("snr"))
    return S.add_noise(x, noise, ["utt"]).select("utt", "n", F.round("x", 6).alias("x"))


def sim11(spark, d):
    """A value between two bounds for each key, the same for any partitioning."""
    u = F.pmod(F.xxhash64(F.lit(777), "p_partkey"), F.lit(1 << 30)) / float(1 << 30)
    x = X.read(spark, d, "part").select(F.col("p_partkey").alias("k"), (0.2 + (0.7 - 0.2) * u).alias("x"))
    return x.select("k", F.round("x", 9).alias("x"))


def sim12(spark, d):
    p = X.read(spark, d, "part")
    return p.select(F.col("p_partkey").alias("k"), F.transform(F.array(F.col("p_retailprice") / 7, F.col("p_size") / 3.0), lambda x: F.round(x, 3)).alias("v")).select("k", F.element_at("v", 1).alias("a"), F.element_at("v", 2).alias("b"))


def top02(spark, d):
    e = X.samples(spark, d).withColumn("e", F.col("x") * F.col("x"))
    return e.select("utt", F.row_number().over(Window.partitionBy("utt").orderBy("e", "ch", "n")).cast("long").alias("place"), "ch", "n")


def top05(spark, d):
    """Indices of a grid of directions as degrees and radians."""
    p = X.read(spark, d, "part").select(F.col("p_partkey").alias("k"), (F.col("p_size") % X.ANGLES).cast("long").alias("a"))
    deg = F.col("a") * 180.0 / (X.ANGLES - 1)
    return p.select("k", "a", F.round(deg, 6).alias("deg"), F.round(F.radians(deg), 6).alias("rad"))


QUERIES = {
    "win07_running_sum": (win07, f"WITH {SERIES}, r AS (SELECT key, t, sum(x) OVER (PARTITION BY key ORDER BY t) AS run, sum(x) OVER (PARTITION BY key) AS total FROM series) SELECT key, min(t) AS t FROM r WHERE run > 0.5 * total GROUP BY key"),
    "agg10_counts": (agg10, f"WITH {ROWS} SELECT utt, count(*) AS done, count(*) FILTER (x > 40) AS clipped, {r6('100.0 * count(*) FILTER (x > 40) / count(*)')} AS percent FROM rows_ GROUP BY utt"),
    "agg11_silence": (agg11, f"WITH {SERIES} SELECT key, {r6('avg(CASE WHEN 10*log10(x*x+1e-5) < 40 THEN 1.0 ELSE 0.0 END)')} AS silent FROM series GROUP BY key"),
    "agg13_pair_mean": (agg13, f"{V} SELECT a.utt, a.n, {r6('avg(a.x*b.x)')} AS m FROM samples a JOIN samples b ON a.utt = b.utt AND a.n = b.n AND a.ch < b.ch GROUP BY ALL"),
    "la01_product": (la01, f"{V}, m AS (SELECT utt, ch AS i, n AS j, x AS re, x * n / 2 AS im FROM samples) SELECT a.utt, a.i, b.i AS j, {r6('sum(a.re*b.re+a.im*b.im)')} AS re, {r6('sum(a.im*b.re-a.re*b.im)')} AS im FROM m a JOIN m b ON a.utt = b.utt AND a.j = b.j GROUP BY ALL"),
    "la01_vectors": (la01_vectors, f"{SPEC} SELECT a.utt, a.t, {r6('sum(a.re*b.re+a.im*b.im)')} AS dot_re, {r6('sum(a.re*b.im-a.im*b.re)')} AS dot_im, {r6('sum(b.re+2*a.re)')} AS axpy_re, {r6('sum(b.im+2*a.im)')} AS axpy_im, {r6('sqrt(sum(a.re*a.re+a.im*a.im)*sum(b.re*b.re+b.im*b.im))')} AS ger FROM stft a JOIN stft b ON a.utt=b.utt AND a.t=b.t AND a.f=b.f AND a.ch=0 AND b.ch=1 GROUP BY a.utt, a.t"),
    "la10_diagonal": (la10, f"{SPEC}, {MASK}, {COV} SELECT utt, f, i, j, {r6('re + CASE WHEN i = j THEN 1.5 ELSE 0 END')} AS re, {r6('im')} AS im FROM cov"),
    "rel19_bin_major": (rel19, f"{SPEC} SELECT utt, f, t, count(*) AS channels, {r6('arg_min(re, ch)')} AS first, {r6('arg_max(re, ch)')} AS last FROM stft GROUP BY utt, f, t"),
    "sp06_gcc_pair": (sp06, f"{SPEC}, {GCC}, n AS (SELECT utt, t, d, i, j, greatest(g / greatest(max(abs(g)) OVER (PARTITION BY utt, i, j), 1.1920929e-07), 0) AS g FROM gcc) SELECT utt, t, d, {r6('g')} AS srp FROM n WHERE i = 0 AND j = 1"),
    "sim03_isotropic_noise": (sim03, f"{V}, p AS (SELECT utt, avg(x*x) FILTER (ch = 0) AS ps, avg(x*x) FILTER (ch = 2) AS pn FROM samples GROUP BY utt) SELECT a.utt, a.n, {r6('a.x + b.x * sqrt(ps/(pn*10**0.5+1.1920929e-07))')} AS x FROM samples a JOIN samples b ON a.utt = b.utt AND a.n = b.n AND a.ch = 0 AND b.ch = 2 JOIN p ON p.utt = a.utt"),
    "sim11_uniform": (sim11, None),
    "sim12_rounding": (sim12, "SELECT p_partkey AS k, round(p_retailprice / 7, 3) AS a, round(p_size / 3.0::DOUBLE, 3) AS b FROM part"),
    "top02_sorted_energies": (top02, f"{V} SELECT utt, row_number() OVER (PARTITION BY utt ORDER BY x*x, ch, n) AS place, ch, n FROM samples"),
    "top05_directions": (top05, f"SELECT p_partkey AS k, p_size % 19 AS a, {r6('p_size % 19 * 10.0')} AS deg, {r6('radians(p_size % 19 * 10.0)')} AS rad FROM part"),
}
