"""Queries of microphone arrays: spatial features, localisation, covariances and beamformers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions.signal import at
from ..operators import beamforming as B
from ..operators import linalg as L
from ..operators import spatial as P
from ..operators import transforms as T
from ..operators.masks import winner_takes_all
from ..operators.metrics import dot_products
from ..operators.windows import hopping
from . import fixtures as X
from .fixtures import GRID, SAMPLES, STFT, r6
from .spectral import C, spec

V = f"WITH {SAMPLES}, {STFT}"
PAIRS = [(0, 1), (1, 3)]


def steer(spark):
    return P.steering(spark, X.ANGLES, X.BINS, X.SR, topo=X.TOPO, speed=X.SPEED)


def r(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


def mask(spark, d):
    """A smooth mask of every cell of an utterance."""
    return spec(spark, d).where("ch = 0").select("utt", "t", "f", F.abs(F.sin(1.0 + F.col("t") + 2 * F.col("f"))).alias("m"))


MASK = "mask AS (SELECT utt, t, f, abs(sin(1 + t + 2 * f)) AS m FROM stft WHERE ch = 0)"
COV = f"""cov AS (SELECT a.utt, a.f, a.ch AS i, b.ch AS j, sum(m*(a.re*b.re+a.im*b.im))/greatest(sum(m),1e-6) AS re, sum(m*(a.im*b.re-a.re*b.im))/greatest(sum(m),1e-6) AS im
  FROM stft a JOIN stft b ON a.utt=b.utt AND a.t=b.t AND a.f=b.f JOIN mask k ON a.utt=k.utt AND a.t=k.t AND a.f=k.f GROUP BY ALL)"""
#: Loaded covariances l, their powers, power sums and inverse by the characteristic polynomial (Cayley and Hamilton).
TIMES = "SELECT a.utt, a.f, a.i, b.j, sum(a.re*b.re-a.im*b.im) AS re, sum(a.re*b.im+a.im*b.re) AS im FROM {a} a JOIN {b} b ON a.utt=b.utt AND a.f=b.f AND a.j=b.i GROUP BY ALL"
TRACE = "SELECT utt, f, sum(re) AS p FROM {a} WHERE i = j GROUP BY utt, f"
LOADED = f"""t0 AS ({TRACE.format(a='cov')}), l AS (SELECT c.utt, c.f, i, j, re + CASE WHEN i = j THEN 0.5 * p / 4 ELSE 0 END AS re, im FROM cov c JOIN t0 ON c.utt=t0.utt AND c.f=t0.f)"""
INVERSE = f"""l2 AS ({TIMES.format(a='l', b='l')}), l3 AS ({TIMES.format(a='l2', b='l')}), l4 AS ({TIMES.format(a='l2', b='l2')}),
  e AS (SELECT utt, f, p1 AS e1, (p1*p1-p2)/2 AS e2, p1, p2, p3, p4 FROM (SELECT a.utt, a.f, a.p AS p1, b.p AS p2, c.p AS p3, d.p AS p4 FROM ({TRACE.format(a='l')}) a JOIN ({TRACE.format(a='l2')}) b USING (utt, f) JOIN ({TRACE.format(a='l3')}) c USING (utt, f) JOIN ({TRACE.format(a='l4')}) d USING (utt, f))),
  e3 AS (SELECT *, (e2*p1-e1*p2+p3)/3 AS e3 FROM e), e4 AS (SELECT *, (e3*p1-e2*p2+e1*p3-p4)/4 AS e4 FROM e3),
  inv AS (SELECT utt, f, l.i, l.j, -(l3.re-e1*l2.re+e2*l.re-CASE WHEN l.i=l.j THEN e3 ELSE 0 END)/e4 AS re, -(l3.im-e1*l2.im+e2*l.im)/e4 AS im FROM l JOIN l2 USING (utt, f, i, j) JOIN l3 USING (utt, f, i, j) JOIN e4 USING (utt, f))"""
DIRECT = f"""df AS (SELECT utt, t, x.f, a, avg(cos(ipd - d)) AS df FROM (SELECT a.utt, a.t, a.f, a.ch AS i, b.ch AS j, atan2(a.im,a.re)-atan2(b.im,b.re) AS ipd FROM stft a JOIN stft b ON a.utt=b.utt AND a.t=b.t AND a.f=b.f
  WHERE (a.ch, b.ch) IN ((0,1),(1,3))) x JOIN (SELECT a.a, a.f, a.ch AS i, b.ch AS j, atan2(a.im,a.re)-atan2(b.im,b.re) AS d FROM steer a JOIN steer b ON a.a=b.a AND a.f=b.f) y ON x.f=y.f AND x.i=y.i AND x.j=y.j GROUP BY utt, t, x.f, a)"""
GCC = f"""gcc AS (SELECT utt, t, d, i, j, sum(cos(dphi + pi()*{X.SR}/8*f*cos(pi()*d/18)*(ti-tj)/343.0))/9 AS g FROM (SELECT a.utt, a.t, a.f, a.ch AS i, b.ch AS j, atan2(a.im,a.re)-atan2(b.im,b.re) AS dphi, ta.p AS ti, tb.p AS tj
  FROM stft a JOIN stft b ON a.utt=b.utt AND a.t=b.t AND a.f=b.f AND a.ch<b.ch JOIN (VALUES (0,0.0),(1,0.05),(2,0.1),(3,0.15)) ta(c,p) ON ta.c=a.ch JOIN (VALUES (0,0.0),(1,0.05),(2,0.1),(3,0.15)) tb(c,p) ON tb.c=b.ch), range(19) x(d) GROUP BY ALL)"""
ML = """ll AS (SELECT utt, a, sum(m * -ln(greatest(1 - (re*re+im*im)/(ss*xx+1.1920929e-07), 1.1920929e-07))) AS ll FROM (SELECT x.utt, x.t, x.f, s.a, sum(s.re*x.re+s.im*x.im) AS re, sum(s.re*x.im-s.im*x.re) AS im, sum(x.re*x.re+x.im*x.im) AS xx, sum(s.re*s.re+s.im*s.im) AS ss
  FROM stft x JOIN steer s ON x.ch=s.ch AND x.f=s.f GROUP BY ALL) JOIN mask USING (utt, t, f) GROUP BY utt, a)"""


def sp01(spark, d):
    p = P.phase_differences(spec(spark, d), PAIRS)
    return p.select("utt", "t", "f", "i", "j", F.round(F.cos("ipd"), 6).alias("cos"), F.round(F.sin("ipd"), 6).alias("sin"))


def sp02(spark, d):
    return r(P.coherence(spec(spark, d), 1, 4), "msc")


def sp03(spark, d):
    return r(P.directional(spec(spark, d), steer(spark), PAIRS), "df")


def sp04(spark, d):
    s = spec(spark, d)
    v = L.per_row(L.packed(L.covariance(s, mask(spark, d)), ["utt", "f"], "r"), ["utt", "f", "r_ch"], ["r"], L.principal, "v")
    ang = L.by_channel(v, ["utt", "f"], "r_ch", "v").withColumn("angle", at().angle())
    d01 = ang.where("ch = 0").select("utt", "f", F.col("angle").alias("a0")).join(ang.where("ch = 1").select("utt", "f", F.col("angle").alias("a1")), ["utt", "f"])
    return P.phase_differences(s, [(0, 1)]).join(d01, ["utt", "f"]).select("utt", "t", "f", F.round(F.cos(F.col("ipd") - (F.col("a0") - F.col("a1"))), 6).alias("df"))


def sp07(spark, d):
    g = P.srp_phat(spec(spark, d), P.diagonal_delays(spark, 4, 0.1, 13, [(0, 2), (1, 3)]), X.BINS, X.SR, 2)
    return r(g, "srp")


def sp08(spark, d):
    return r(P.srp_phat(spec(spark, d), P.linear_delays(spark, X.TOPO, 19), X.BINS, X.SR, 4), "srp")


def sp09(spark, d):
    return r(P.srp_phat(spec(spark, d), P.linear_delays(spark, X.TOPO, 19), X.BINS, X.SR, 4, normalize=False), "srp")


def sp09_smoothed(spark, d):
    """Equal steps of delay, raw sums over pairs, the mean of three frames."""
    return r(P.srp_smoothed(spec(spark, d), P.line_delays(spark, X.TOPO, 21, speed=X.SPEED), X.BINS, X.SR, 1), "srp")


def sp10(spark, d):
    s = spec(spark, d).join(mask(spark, d), ["utt", "t", "f"])
    return r(P.ml_likelihood(s, steer(spark), mask="m"), "ll")


def sp11(spark, d):
    s = P.directional_scores(spec(spark, d), steer(spark), PAIRS)
    return P.best_angle(r(s, "score"), "score").join(steer(spark).select("a", "deg").distinct(), "a").select("utt", "a", F.round("deg", 6).alias("deg"))


def sp12(spark, d):
    """Noise subspace of the covariance: directions of least projection."""
    e = P.music_scores(L.packed(L.covariance(spec(spark, d), mask(spark, d)), ["utt", "f"], "r"), steer(spark))
    return P.best_angle(r(e, "e"), "e", largest=False)


def sp13(spark, d):
    """Two competing masks, winner takes all; one direction for each."""
    m = mask(spark, d)
    two = winner_takes_all(m.select("utt", "t", "f", F.lit(0).cast("long").alias("k"), "m").unionByName(m.select("utt", "t", "f", F.lit(1).cast("long").alias("k"), (1 - F.col("m")).alias("m"))), ["utt", "t", "f"])
    out = None
    for k in (0, 1):
        s = spec(spark, d).join(two.where(F.col("k") == k).drop("k"), ["utt", "t", "f"])
        one = P.best_angle(r(P.ml_likelihood(s, steer(spark), mask="m"), "ll"), "ll").withColumn("k", F.lit(k).cast("long"))
        out = one if out is None else out.unionByName(one)
    return out


def sp13_online(spark, d):
    """A direction for every three frames, from them and the two before."""
    s = hopping(spec(spark, d).join(mask(spark, d), ["utt", "t", "f"]), 3, 2)
    ll = P.ml_likelihood(s, steer(spark), mask="m", keys=("utt", "chunk")).withColumn("ll", F.round("ll", 6))
    return P.best_angle(ll, "ll", keys=("utt", "chunk"))


def sp14(spark, d):
    circular = P.steering(spark, 8, X.BINS, X.SR, around=6, radius=0.05, centre=True, normalize=True).withColumn("kind", F.lit("circular"))
    return r(steer(spark).withColumn("kind", F.lit("linear")).unionByName(circular), "deg", "re", "im")


def agg08(spark, d):
    return r(L.covariance(spec(spark, d), mask(spark, d)), "re", "im")


def loaded_covariance(spark, d, share=0.5):
    """The covariances with a good part of their trace on the diagonal, packed."""
    c = L.covariance(spec(spark, d), mask(spark, d))
    size = c.where("i = j").groupBy("utt", "f").agg(F.sum("re").alias("trace"))
    on = F.when(F.col("i") == F.col("j"), share * F.col("trace") / 4).otherwise(0.0)
    return L.packed(c.join(size, ["utt", "f"]).withColumn("re", F.col("re") + on), ["utt", "f"], "r")


def kept(v, out, power=1):
    """Rows without a result get NaN for each of their channels r_ch (power 2: for each element of a matrix), so that none is lost."""
    void = F.array_repeat(F.lit(float("nan")), F.pow(F.size("r_ch"), F.lit(power)).cast("int"))
    return v.withColumns({f"{out}_{p}": F.coalesce(f"{out}_{p}", void) for p in ("re", "im")})


def square(v, *names):
    """Row-major arrays o_re, o_im of matrices, by element, under the channels r_ch of their rows and columns."""
    long = kept(v, "o", 2).select("utt", "f", "r_ch", F.posexplode(F.arrays_zip("o_re", "o_im")).alias("at", "z"))
    ch = lambda k: F.get("r_ch", k.cast("int")).cast("long")
    return r(long.select("utt", "f", ch(F.floor(F.col("at") / F.size("r_ch"))).alias("i"), ch(F.col("at") % F.size("r_ch")).alias("j"), F.col("z.o_re").alias("re"), F.col("z.o_im").alias("im")), "re", "im")


def power_sums(values, many=4):
    """Sums of the first powers of a matrix's eigenvalues, which determine them."""
    return [F.round(F.aggregate(values, F.lit(0.0), lambda a, x: a + F.pow(x, F.lit(k))), 5).alias(f"p{k}") for k in range(1, many + 1)]


def la02(spark, d):
    return square(L.per_row(loaded_covariance(spark, d), ["utt", "f", "r_ch"], ["r"], L.inverse, "o"))


def la03(spark, d):
    c = L.packed(L.covariance(spec(spark, d), mask(spark, d)), ["utt", "f"], "r")
    return L.per_row(c, ["utt", "f"], ["r"], L.eigenvalues, "v").select("utt", "f", *power_sums("v_re"))


def la04(spark, d):
    c = L.packed(L.covariance(spec(spark, d), mask(spark, d)), ["utt", "f"], "s").join(loaded_covariance(spark, d), ["utt", "f"])
    return L.per_row(c, ["utt", "f"], ["s", "r"], L.generalized_eigenvalues, "v").select("utt", "f", *power_sums("v_re", 2))


def la05(spark, d):
    """How far covariances are from Hermitian after their columns were scaled by 1, 2, 3 and 4."""
    c = L.covariance(spec(spark, d), mask(spark, d)).withColumns({x: F.col(x) * (F.col("j") + 1) for x in ("re", "im")})
    return r(L.hermitian_error(c, ["utt", "f"]), "err")


def la07(spark, d):
    c = L.packed(L.covariance(spec(spark, d), mask(spark, d)), ["utt", "f"], "r")
    return square(L.per_row(c, ["utt", "f", "r_ch"], ["r"], L.rank_one, "o"))


def la08(spark, d):
    """x of R x = b: R the loaded covariance, b the first column of the one without a load."""
    c = L.packed(L.covariance(spec(spark, d), mask(spark, d)), ["utt", "f"], "s").join(loaded_covariance(spark, d), ["utt", "f"])
    v = L.per_row(c, ["utt", "f", "r_ch"], ["s", "r"], lambda s, x: L.solved(x, s[:, :, :1])[:, :, 0], "x")
    return r(L.by_channel(kept(v, "x"), ["utt", "f"], "r_ch", "x").withColumnRenamed("ch", "i"), "re", "im")


def la09(spark, d):
    c = L.packed(L.covariance(spec(spark, d), mask(spark, d)), ["utt", "f"], "r")
    return L.per_row(c, ["utt", "f"], ["r"], L.log_determinant, "d").select("utt", "f", F.round(F.element_at("d_re", 1), 4).alias("logdet"))


def la09_rebuilt(spark, d):
    """Scaled covariances and their inverses from floored eigenvalues, as long rows."""
    c = L.packed(L.covariance(spec(spark, d), mask(spark, d)), ["utt", "f"], "r")
    out = None
    for how, inverted in (("matrix", False), ("inverse", True)):
        x = L.per_row(c, ["utt", "f"], ["r"], lambda r_, inverted=inverted: L.rebuilt(r_, inverted), "m")
        x = x.select("utt", "f", F.lit(how).alias("how"), F.posexplode(F.arrays_zip("m_re", "m_im")).alias("at", "z")).select("utt", "f", "how", F.col("at").cast("long").alias("at"), F.col("z.m_re").alias("re"), F.col("z.m_im").alias("im"))
        out = x if out is None else out.unionByName(x)
    return out


def bf04_circular(spark, d):
    """One microphone in the centre of three, looking to 80 degrees."""
    _, vectors = P.steering_array(P.steering(spark, 9, X.BINS, X.SR, around=3, radius=0.05, centre=True, speed=X.SPEED))
    far = np.zeros((4, 4))
    far[1:, 1:] = B.circular_distances(3, 0.05)
    far[0, 1:] = far[1:, 0] = 0.05
    w = B.super_directive(spark, vectors[:, 2], B.diffuse(far, X.BINS, X.SR, X.SPEED, load=1e-5))
    return r(B.beamformed(spec(spark, d), F.broadcast(w), ["f", "ch"]), "re", "im")


def la12(spark, d):
    """Principal components: the covariance is summed by Spark, 64 x 64 numbers are decomposed, rows are projected by Spark."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = X.speakers(spark, d).withColumn("features", array_to_vector("v"))
    model = PCA(k=2, inputCol="features", outputCol="pc").fit(v)
    return model.transform(v).select("utt", F.round(F.abs(F.element_at(vector_to_array("pc"), 1)), 4).alias("pc1"))


def la13(spark, d):
    rows = [("linear", i, j, float(x)) for (i, j), x in np.ndenumerate(B.linear_distances(X.TOPO))] + [("circular", i, j, float(x)) for (i, j), x in np.ndenumerate(B.circular_distances(6, 0.05))]
    return r(spark.createDataFrame(rows, "kind string, i long, j long, dist double"), "dist")


def la14(spark, d):
    c = B.diffuse(B.linear_distances(X.TOPO), X.BINS, X.SR, load=0.1)
    return r(spark.createDataFrame([(f, i, j, float(x)) for (f, i, j), x in np.ndenumerate(c)], "f long, i long, j long, re double"), "re")


def la16(spark, d):
    """Every twentieth vector as a query against all."""
    v = X.read(spark, d, "embeddings").select(F.col("vec_id").alias("a"), F.col("embedding").alias("v"))
    q = v.where("a % 20 = 0").select(F.col("a").alias("b"), F.col("v").alias("w"))
    return dot_products(v, q).select("a", "b", F.round("dot", 6).alias("dot"))


def bf01(spark, d):
    w = steer(spark).where("a = 4").select("f", "ch", "re", "im")
    return r(B.beamformed(spec(spark, d), F.broadcast(w), ["f", "ch"]), "re", "im")


def bf02(spark, d):
    """One of several fixed beams, picked by a map from utterance to beam."""
    beams = steer(spark).withColumnRenamed("a", "beam").select("beam", "f", "ch", "re", "im")
    pick = spec(spark, d).withColumn("beam", F.col("utt") % 3 * 6)
    return r(B.beamformed(pick, F.broadcast(beams), ["beam", "f", "ch"]), "re", "im")


def bf03(spark, d):
    w = B.delay_and_sum(steer(spark).where("a = 9"), 4).select("f", "ch", "re", "im")
    return r(B.beamformed(spec(spark, d), F.broadcast(w), ["f", "ch"]), "re", "im")


def bf04(spark, d):
    s = np.array([[np.exp(-1j * np.pi * X.SR / (X.BINS - 1) * f * np.cos(np.pi / 3) * p / X.SPEED) for p in X.TOPO] for f in range(X.BINS)])
    w = B.super_directive(spark, s, B.diffuse(B.linear_distances(X.TOPO), X.BINS, X.SR, X.SPEED))
    return r(B.beamformed(spec(spark, d), F.broadcast(w), ["f", "ch"]), "re", "im")


def supervised(kind, ban=False):
    def query(spark, d):
        s, m = spec(spark, d), mask(spark, d)
        y = B.beamformed(s, B.supervised(s, m, kind, ban))
        return y.groupBy("utt", "f").agg(F.round(F.sum(at().power()), 4).alias("power"))

    return query


def bf08_ref(spark, d):
    return B.reference_channel(spec(spark, d), mask(spark, d))


def bf12(spark, d):
    """One direction for each chunk of three frames."""
    w = B.delay_and_sum(steer(spark), 4).withColumnRenamed("a", "doa").select("doa", "f", "ch", "re", "im")
    s = spec(spark, d).withColumn("doa", F.floor(F.col("t") / 3) * 6)
    return r(B.beamformed(s, F.broadcast(w), ["doa", "f", "ch"]), "re", "im")


def bf13(spark, d):
    s, m = spec(spark, d), mask(spark, d)
    blk = F.floor(F.col("t") / 4)
    w = B.supervised(s, m, "mvdr", block=blk)
    y = B.beamformed(s.withColumn("blk", blk), w, ["utt", "blk", "f", "ch"])
    return r(y, "re", "im")


def bf14(spark, d):
    return r(B.pattern(steer(spark), B.delay_and_sum(steer(spark).where("a = 9"), 4)), "gain")


def bf16(spark, d):
    y = B.beamformed(spec(spark, d), F.broadcast(B.delay_and_sum(steer(spark).where("a = 9"), 4).select("f", "ch", "re", "im")), ["f", "ch"])
    x = T.istft(y, C, ["utt"])
    return x.select("utt", F.posexplode("x").alias("n", "x")).select("utt", F.col("n").cast("long").alias("n"), F.round("x", 6).alias("x"))


S = f"{V}, {GRID}"
MIX = "SELECT {k}utt, t, x.f, {a} AS re, {b} AS im FROM stft x JOIN steer s ON x.f = s.f AND x.ch = s.ch {w} GROUP BY {k}utt, t, x.f"
RE, IM = "sum(s.re*x.re+s.im*x.im)", "sum(s.re*x.im-s.im*x.re)"
QUERIES = {
    "sp01_phase_differences": (sp01, f"{V} SELECT a.utt, a.t, a.f, a.ch AS i, b.ch AS j, {r6('cos(atan2(a.im,a.re)-atan2(b.im,b.re))')} AS cos, {r6('sin(atan2(a.im,a.re)-atan2(b.im,b.re))')} AS sin FROM stft a JOIN stft b ON a.utt=b.utt AND a.t=b.t AND a.f=b.f WHERE (a.ch, b.ch) IN ((0,1),(1,3))"),
    "sp02_coherence": (sp02, f"""{V}, p AS (SELECT a.utt, a.t, a.f, a.ch AS i, b.ch AS j, avg(a.re*b.re+a.im*b.im) OVER w AS re, avg(a.im*b.re-a.re*b.im) OVER w AS im, avg(a.re*a.re+a.im*a.im) OVER w AS p1, avg(b.re*b.re+b.im*b.im) OVER w AS p2 FROM stft a JOIN stft b ON a.utt=b.utt AND a.t=b.t AND a.f=b.f AND a.ch<b.ch
      WINDOW w AS (PARTITION BY a.utt, a.f, a.ch, b.ch ORDER BY a.t ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)) SELECT utt, t, f, {r6('sum((re*re+im*im)/(p1*p2+1.1920929e-07))*2.0/12')} AS msc FROM p GROUP BY utt, t, f"""),
    "sp03_directional": (sp03, f"{S}, {DIRECT} SELECT utt, t, f, a, {r6('df')} AS df FROM df"),
    "sp04_directional_on_mask": (sp04, None),
    "sp07_gcc_diagonal": (sp07, None),
    "sp08_srp_phat": (sp08, f"{V}, {GCC}, n AS (SELECT utt, t, d, greatest(g / greatest(max(abs(g)) OVER (PARTITION BY utt, i, j), 1.1920929e-07), 0) AS g FROM gcc) SELECT utt, t, d, {r6('sum(g)*2.0/12')} AS srp FROM n GROUP BY ALL"),
    "sp09_srp_phat_raw": (sp09, f"{V}, {GCC} SELECT utt, t, d, {r6('sum(greatest(g, 0))*2.0/12')} AS srp FROM gcc GROUP BY ALL"),
    "sp09_srp_smoothed": (sp09_smoothed, f"""{V}, g AS (SELECT a.utt, a.t, d, sum(cos(atan2(a.im,a.re)-atan2(b.im,b.re)+pi()*{X.SR}/8*a.f*abs(tb.p-ta.p)/343.0*(1-d/10.0))) AS g
      FROM stft a JOIN stft b ON a.utt=b.utt AND a.t=b.t AND a.f=b.f AND a.ch<b.ch JOIN (VALUES (0,0.0),(1,0.05),(2,0.1),(3,0.15)) ta(c,p) ON ta.c=a.ch JOIN (VALUES (0,0.0),(1,0.05),(2,0.1),(3,0.15)) tb(c,p) ON tb.c=b.ch, range(21) x(d) GROUP BY ALL)
      SELECT x.utt, x.t, x.d, {r6('greatest(sum(y.g)/3, 0)')} AS srp FROM g x, range(-1, 2) o(k) JOIN g y ON y.utt=x.utt AND y.d=x.d AND y.t=least(greatest(x.t+k, 0), 6) GROUP BY ALL"""),
    "sp10_ml_ssl": (sp10, f"{S}, {MASK}, {ML} SELECT utt, a, {r6('ll')} AS ll FROM ll"),
    "sp11_srp_ssl": (sp11, f"{S}, {DIRECT} SELECT utt, a, {r6('a*10.0')} AS deg FROM (SELECT utt, a, row_number() OVER (PARTITION BY utt ORDER BY round(sum(df), 6) DESC, a) AS r FROM df GROUP BY utt, a) WHERE r = 1"),
    "sp12_music_ssl": (sp12, None),
    "sp13_masked_ssl": (sp13, None),
    "sp13_online_ssl": (sp13_online, f"""{S}, {MASK}, {ML.replace('ll AS (SELECT utt, a,', 'll AS (SELECT utt, t, a,').replace('GROUP BY utt, a)', 'GROUP BY utt, t, a)')}, c AS (SELECT utt, c AS chunk, a, round(sum(ll), 6) AS ll FROM ll, range(3) r(c) WHERE t >= c * 3 - 2 AND t < c * 3 + 3 GROUP BY ALL)
      SELECT utt, chunk, a FROM (SELECT *, row_number() OVER (PARTITION BY utt, chunk ORDER BY ll DESC, a) AS r FROM c) WHERE r = 1"""),
    "sp14_steering": (sp14, f"""WITH {GRID} SELECT 'linear' AS kind, a, {r6('deg')} AS deg, ch, f, {r6('re')} AS re, {r6('im')} AS im FROM steer UNION ALL
      SELECT 'circular', a, {r6('a*45.0')}, ch, f, {r6('cos(w*tau)/sqrt(7)')}, {r6('-sin(w*tau)/sqrt(7)')} FROM (SELECT a, ch, f, pi()*16000/8*f AS w, CASE WHEN ch = 0 THEN 0 ELSE -cos(radians(a*45.0)-(ch-1)*2*pi()/6)*0.05/343.0 END AS tau FROM range(8) x(a), range(7) y(ch), range(9) z(f))"""),
    "agg08_masked_covariance": (agg08, f"{V}, {MASK}, {COV} SELECT utt, f, i, j, {r6('re')} AS re, {r6('im')} AS im FROM cov"),
    "la02_inverse": (la02, f"{V}, {MASK}, {COV}, {LOADED}, {INVERSE} SELECT utt, f, i, j, {r6('re')} AS re, {r6('im')} AS im FROM inv"),
    "la03_eigenvalues": (la03, f"{V}, {MASK}, {COV}, c2 AS ({TIMES.format(a='cov', b='cov')}), c3 AS ({TIMES.format(a='c2', b='cov')}), c4 AS ({TIMES.format(a='c2', b='c2')}) SELECT utt, f, round(a.p, 5) AS p1, round(b.p, 5) AS p2, round(c.p, 5) AS p3, round(d.p, 5) AS p4 FROM ({TRACE.format(a='cov')}) a JOIN ({TRACE.format(a='c2')}) b USING (utt, f) JOIN ({TRACE.format(a='c3')}) c USING (utt, f) JOIN ({TRACE.format(a='c4')}) d USING (utt, f)"),
    "la04_generalized_eigenvalues": (la04, f"{V}, {MASK}, {COV}, {LOADED}, {INVERSE}, m AS ({TIMES.format(a='inv', b='cov')}), m2 AS ({TIMES.format(a='m', b='m')}) SELECT utt, f, round(a.p, 5) AS p1, round(b.p, 5) AS p2 FROM ({TRACE.format(a='m')}) a JOIN ({TRACE.format(a='m2')}) b USING (utt, f)"),
    "la05_hermitian": (la05, f"{V}, {MASK}, {COV} SELECT a.utt, a.f, {r6('max(sqrt(power(a.re*(a.j+1)-b.re*(b.j+1),2)+power(a.im*(a.j+1)+b.im*(b.j+1),2)))/max(sqrt(a.re*a.re+a.im*a.im)*(a.j+1))')} AS err FROM cov a JOIN cov b ON a.utt=b.utt AND a.f=b.f AND a.i=b.j AND a.j=b.i GROUP BY a.utt, a.f"),
    "la07_rank_one": (la07, None),
    "la08_solve": (la08, f"{V}, {MASK}, {COV}, {LOADED}, {INVERSE}, m AS ({TIMES.format(a='inv', b='cov')}) SELECT utt, f, i, {r6('re')} AS re, {r6('im')} AS im FROM m WHERE j = 0"),
    "la09_log_determinant": (la09, None),
    "la09_rebuilt": (la09_rebuilt, None),
    "la12_pca": (la12, None),
    "la13_distances": (la13, f"SELECT 'linear' AS kind, i, j, {r6('abs(p-q)')} AS dist FROM (VALUES (0,0.0),(1,0.05),(2,0.1),(3,0.15)) a(i,p), (VALUES (0,0.0),(1,0.05),(2,0.1),(3,0.15)) b(j,q) UNION ALL SELECT 'circular', i, j, {r6('0.1*abs(sin(pi()*(i-j)/6))')} FROM range(6) x(i), range(6) y(j)"),
    "la14_diffuse_coherence": (la14, f"SELECT f, i, j, {r6('CASE WHEN x = 0 THEN 1 ELSE sin(pi()*x)/(pi()*x) END + CASE WHEN i = j THEN 0.1 ELSE 0 END')} AS re FROM (SELECT f, i, j, f*pi()*16000/8*abs(p-q)/343.0 AS x FROM range(9) z(f), (VALUES (0,0.0),(1,0.05),(2,0.1),(3,0.15)) a(i,p), (VALUES (0,0.0),(1,0.05),(2,0.1),(3,0.15)) b(j,q))"),
    "la16_dot_products": (la16, f"WITH {X.SPEAKERS} SELECT x.utt AS a, y.utt AS b, {r6('sum(x.x*y.x)')} AS dot FROM speakers x JOIN speakers y ON x.i = y.i WHERE y.utt % 20 = 0 GROUP BY ALL"),
    "bf01_apply_weights": (bf01, f"{S} " + MIX.format(k="", a=r6(RE), b=r6(IM), w="AND s.a = 4")),
    "bf02_fixed_beams": (bf02, f"{S} SELECT a AS beam, utt, t, f, re, im FROM (" + MIX.format(k="s.a, ", a=r6(RE), b=r6(IM), w="AND s.a = x.utt % 3 * 6") + ")"),
    "bf03_delay_and_sum": (bf03, f"{S} " + MIX.format(k="", a=r6(RE + "/4"), b=r6(IM + "/4"), w="AND s.a = 9")),
    "bf04_super_directive": (bf04, None),
    "bf04_super_directive_circular": (bf04_circular, None),
    "bf06_mvdr": (supervised("mvdr"), None),
    "bf07_mpdr": (supervised("mpdr"), None),
    "bf07_mpdr_whitened": (supervised("mpdr-whiten"), None),
    "bf08_pmwf": (supervised("pmwf-1"), None),
    "bf08_pmwf_rank1": (supervised("pmwf-eig"), None),
    "bf08_reference_channel": (bf08_ref, f"{V}, {MASK}, x AS (SELECT utt, ch, sum(m*(re*re+im*im))/greatest(sum((1-m)*(re*re+im*im)),1e-10) AS v FROM stft JOIN mask USING (utt, t, f) GROUP BY utt, ch) SELECT utt, ch AS ref FROM (SELECT *, row_number() OVER (PARTITION BY utt ORDER BY v DESC, ch) AS r FROM x) WHERE r = 1"),
    "bf09_gevd": (supervised("gevd"), None),
    "bf10_gevd_ban": (supervised("gevd", ban=True), None),
    "bf12_online_directions": (bf12, f"{S} " + MIX.format(k="", a=r6(RE + "/4"), b=r6(IM + "/4"), w="AND s.a = x.t // 3 * 6")),
    "bf13_blockwise_mvdr": (bf13, None),
    "bf14_beam_pattern": (bf14, f"WITH {GRID} SELECT a.a, a.f, {r6('sqrt(pow(sum(w.re*a.re+w.im*a.im)/4,2)+pow(sum(w.re*a.im-w.im*a.re)/4,2))')} AS gain FROM steer a JOIN steer w ON a.f=w.f AND a.ch=w.ch AND w.a=9 GROUP BY a.a, a.f"),
    "bf16_classic_to_wave": (bf16, None),
}
