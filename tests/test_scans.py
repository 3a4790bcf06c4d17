"""Prefix scans against plain loops, for blocks and fans of several sizes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessitura.operators import scans as C
from tessitura.operators import windows as W

RNG = np.random.default_rng(4)
SERIES = {k: [None if RNG.random() < 0.05 else float(v) for v in RNG.integers(-50, 50, n)] for k, n in ((1, 1), (2, 7), (3, 640), (4, 1000))}
SERIES[5] = [None, None, 3.0, None, 1.0]
SERIES[6] = [None, None]


def loop(kind, xs):
    out, s = [], None
    for v in xs:
        if v is not None:
            if s is None:
                s = v
            elif isinstance(kind, C.Exponential):
                s = kind.alpha * s + (1 - kind.alpha) * v
            else:
                a = 1 - (1 - kind.alpha) / kind.rise if v > s else kind.alpha
                s = a * s + (1 - a) * v
        out.append(s)
    return out


def voiced(xs, cache):
    out, c, beg = [], 0, -1
    for t, v in enumerate(xs):
        if v:
            c = min(c + 1, cache)
        elif v is not None and beg >= 0:
            c -= 1
        if beg < 0 and c >= cache:
            beg = max(t - cache, 0)
        elif beg >= 0 and c <= 0:
            out.append((beg, t))
            c, beg = 0, -1
    return out + [(beg, len(xs) - 1)] * (beg >= 0)


def frame(spark, series):
    return spark.createDataFrame([(k, t, x) for k, xs in series.items() for t, x in enumerate(xs)], "key long, t long, x double").repartition(4)


@pytest.mark.parametrize(("size", "fan"), [(4096, 256), (16, 4), (5, 2), (100, 3)])
@pytest.mark.parametrize("kind", [C.Exponential(0.9), C.Exponential(0.0), C.Tracking(0.7, 4.0), C.Tracking(0.98, 8.0)], ids=str)
def test_recurrences_like_a_loop(spark, kind, size, fan):
    got = {}
    for r in C.along(frame(spark, SERIES), ["key"], kind, size=size, fan=fan).collect():
        got.setdefault(r["key"], {})[r["t"]] = r["s"]
    for k, xs in SERIES.items():
        for t, want in enumerate(loop(kind, xs)):
            assert got[k][t] is None if want is None else got[k][t] == pytest.approx(want, abs=1e-9), (k, t)


@pytest.mark.parametrize(("size", "fan"), [(4096, 256), (16, 4), (3, 2)])
@pytest.mark.parametrize("cache", [1, 3, 6])
def test_segments_like_a_loop(spark, cache, size, fan):
    rng = np.random.default_rng(cache)
    series = {k: [bool(v) for v in np.repeat(rng.random(n) < 0.5, rng.integers(1, 9, n))] for k, n in ((1, 1), (2, 20), (3, 200))}
    df = spark.createDataFrame([(k, t, x) for k, xs in series.items() for t, x in enumerate(xs)], "key long, t long, active boolean")
    got = sorted(tuple(r) for r in C.segments(df, ["key"], cache, size=size, fan=fan).collect())
    assert got == sorted((k, *s) for k, xs in series.items() for s in voiced(xs, cache))


def test_one_long_series_is_many_tasks(spark):
    """A key of two million rows: no block is larger than SIZE, and the results are a loop's."""
    df = spark.range(2_000_000).select(F.lit(1).alias("key"), F.col("id").alias("t"), (F.pmod(F.xxhash64("id"), F.lit(1000)) / 10.0).alias("x"))
    x = np.array([r[0] for r in df.orderBy("t").select("x").collect()])
    for kind in (C.Exponential(0.99), C.Tracking(0.9, 5.0)):
        out = C.scanned(df, ["key"], kind)
        assert out.agg(F.max(F.size("ts"))).first()[0] <= C.SIZE and out.count() == -(-len(x) // C.SIZE)
        want = loop(kind, x.tolist())
        got = out.orderBy("blk").select(F.element_at("s", -1).alias("s"), F.element_at("ts", -1).alias("t")).collect()
        assert max(abs(r["s"] - want[r["t"]]) for r in got) < 1e-9


def test_piecewise_maps_compose():
    kind = C.Tracking(0.95, 3.0, -50.0, 50.0)
    x, y = RNG.integers(-50, 50, 30).astype(float), RNG.integers(-50, 50, 20).astype(float)
    f, g = ({"fresh": a, "p": p, "q": q} for a, p, q in (kind.table(x), kind.table(y)))
    p, q = kind.then(f, g)
    for s in np.linspace(-50, 50, 101):
        want = kind.run(np.append(x, y), s)[-1]
        assert kind.apply(g, kind.apply(f, s)) == pytest.approx(want, abs=1e-10) and np.interp(s, p, q) == pytest.approx(want, abs=1e-10)


def test_nothing_to_scan(spark):
    none = spark.createDataFrame([], "key long, t long, x double")
    assert C.along(none, ["key"], C.Tracking(0.7, 4.0)).count() == 0
    assert W.hysteresis(none.withColumn("active", F.col("x") > 0), ["key"], 3).count() == 0
