"""Steering kernels against plain loops: cells cut by batches, channels that are missing, nulls, keys of any kind, empty tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessitura.operators import linalg as L
from tessitura.operators import spatial as P

BINS, SR, TOPO = 5, 16000, (0.0, 0.05, 0.1)
SPEC = "utt string, ch long, t long, f long, re double, im double"


@pytest.fixture(scope="module")
def cells():
    g = np.random.default_rng(3)
    return {(u, c, t, f): complex(*g.normal(size=2)) for u in ("a", "b") for c in range(3) for t in range(6) for f in range(BINS)}


def frame(spark, z):
    return spark.createDataFrame([(u, c, t, f, float(v.real), float(v.imag)) for (u, c, t, f), v in z.items()], SPEC)


@pytest.fixture(scope="module")
def small_batches(spark):
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    yield
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_response_power_over_cut_batches(spark, small_batches, cells):
    lost = {k: v for k, v in cells.items() if k[:3] != ("a", 1, 2)}  # frame 2 of a lacks channel 1
    got = {(r["utt"], r["t"], r["d"]): r["srp"] for r in P.srp_phat(frame(spark, lost), P.linear_delays(spark, TOPO, 7), BINS, SR, 3).collect()}
    tau = {(r["d"], r["i"], r["j"]): r["tau"] for r in P.linear_delays(spark, TOPO, 7).collect()}
    pairs = [(0, 1), (0, 2), (1, 2)]
    gcc = {}
    for u in "ab":
        for t in range(6):
            for i, j in pairs:
                for d in range(7):
                    both = [(np.angle(lost[u, i, t, f]) - np.angle(lost[u, j, t, f]), f) for f in range(BINS) if (u, i, t, f) in lost and (u, j, t, f) in lost]
                    gcc[u, t, i, j, d] = sum(np.cos(a + np.pi * SR / (BINS - 1) * f * tau[d, i, j]) for a, f in both) / BINS
    for u in "ab":
        most = {p: max(abs(gcc[u, t, *p, d]) for t in range(6) for d in range(7)) for p in pairs}
        for t in range(6):
            for d in range(7):
                assert abs(got.pop((u, t, d)) - sum(max(gcc[u, t, *p, d] / most[p], 0) for p in pairs) / 3) < 1e-9
    assert not got


def test_likelihood_and_directions_by_any_key(spark, small_batches, cells):
    steer = P.steering(spark, 5, BINS, SR, topo=TOPO)
    z = {(r["a"], r["ch"], r["f"]): complex(r["re"], r["im"]) for r in steer.collect()}
    x = frame(spark, cells)
    got = {(r["utt"], r["part"], r["a"]): r["ll"] for r in P.ml_likelihood(x.withColumn("part", F.when(F.col("t") > 2, 1)), steer, compression=0.5, keys=("utt", "part")).collect()}
    eps = P.EPSILON
    for u in "ab":
        for part, ts in ((None, range(3)), (1, range(3, 6))):
            for a in range(5):
                want = 0.0
                for t in ts:
                    for f in range(BINS):
                        v = [cells[u, c, t, f] for c in range(3)]
                        s = [z[a, c, f] for c in range(3)]
                        xx = sum(abs(w) ** 2 for w in v)
                        want -= np.log(max(1 - abs(np.vdot(s, v)) ** 2 / (3 * xx + eps), eps)) * xx**0.5
                assert abs(got.pop((u, part, a)) - want) < 1e-7
    assert not got
    score = {(r["utt"], r["a"]): r["score"] for r in P.directional_scores(x, steer, [(0, 2)]).collect()}
    summed = {(r["utt"], r["a"]): r["s"] for r in P.directional(x, steer, [(0, 2)]).groupBy("utt", "a").agg(F.sum("df").alias("s")).collect()}
    assert score.keys() == summed.keys() and all(abs(score[k] - summed[k]) < 1e-9 for k in score)


def test_nulls_add_nothing_and_no_rows_give_none(spark, cells):
    steer = P.steering(spark, 5, BINS, SR, topo=TOPO)
    x = frame(spark, cells)
    spoiled = x.withColumn("re", F.when((F.col("t") == 1) & (F.col("ch") == 2), None).otherwise(F.col("re")))
    near = lambda a, b: {r["a"]: r["ll"] for r in a.where("utt = 'a'").collect()}.keys() == {r["a"] for r in b.collect()} and all(abs(p["ll"] - q["ll"]) < 1e-9 for p, q in zip(a.orderBy("utt", "a").collect(), b.orderBy("utt", "a").collect(), strict=True))
    assert near(P.ml_likelihood(spoiled, steer), P.ml_likelihood(x.where("t <> 1"), steer))
    none = x.where("t < 0")
    assert P.ml_likelihood(none, steer).count() == P.directional(none, steer, [(0, 1)]).count() == P.srp_phat(none, P.linear_delays(spark, TOPO, 7), BINS, SR, 3).count() == 0
    with pytest.raises(ValueError):
        P.ml_likelihood(x, steer.where("a > 0"))


def test_two_covariances_equal_one_by_one(spark, cells):
    x = frame(spark, cells)
    m = x.where("ch = 0").select("utt", "t", "f", F.abs(F.sin(F.col("t") + F.col("f"))).alias("m"))
    other = m.where("t > 0").withColumn("m", F.col("m") * F.col("m"))
    for noise in (None, other):
        got = L.two_covariances(x, m, noise)
        s = L.packed(L.covariance(x, m), ["utt", "f"], "s")
        n = L.packed(L.covariance(x, m.withColumn("m", 1 - F.col("m")) if noise is None else noise), ["utt", "f"], "n")
        want = {(r["utt"], r["f"]): r for r in s.join(n, ["utt", "f"]).collect()}
        rows = got.collect()
        assert len(rows) == len(want) == 2 * BINS
        for r in rows:
            for c in ("s_re", "s_im", "n_re", "n_im"):
                assert np.allclose(r[c], want[r["utt"], r["f"]][c], atol=1e-12)
