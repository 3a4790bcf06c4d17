"""Operators against plain Python, round trips and the edges of their inputs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessitura.operators import estimation as E
from tessitura.operators import linalg as L
from tessitura.operators import metrics as M
from tessitura.operators import relational as R
from tessitura.operators import transforms as T
from tessitura.operators import windows as W
from tessitura.sources import archives as A
from tessitura.sources import sinks as K
from tessitura.sources import tables as S

RNG = np.random.default_rng(3)


def wave(spark, n=3, size=200):
    return spark.createDataFrame([(i, RNG.standard_normal(size).tolist()) for i in range(n)], "utt long, x array<double>")


@pytest.mark.parametrize("config", [T.StftConfig(32, 16), T.StftConfig(32, 8, center=False), T.StftConfig(24, 12, pad="zero", window="hamming"), T.StftConfig(32, 16, window="sqrthann")])
def test_stft_round_trip(spark, config):
    w = wave(spark).cache()
    back = T.istft(T.stft(w, config), config, ["utt"], keep=w.select("utt", F.size("x").cast("long").alias("n"))).toPandas().set_index("utt")
    for r in w.collect():
        a, b = np.array(r["x"]), np.array(back.x[r["utt"]])
        inside = slice(32, 160)
        assert len(b) == len(a)
        assert np.allclose(a[inside], b[inside], atol=1e-8)


def test_stft_of_short_and_missing_waves(spark):
    w = spark.createDataFrame([(0, [1.0, 2.0]), (1, []), (2, None)], "utt long, x array<double>")
    got = T.stft(w, T.StftConfig(8, 4, center=False)).select("utt").distinct().collect()
    assert [r["utt"] for r in got] == [0]


def test_griffin_lim_comes_near(spark):
    c = T.StftConfig(32, 8)
    x = np.sin(np.arange(300) * 0.3)
    m = np.abs(T.analysed(x, c))
    df = spark.createDataFrame([(0, m.tolist())], "utt long, m array<array<double>>")
    y = np.array(T.griffin_lim(df, c, ["utt"], rounds=40).first()["x"])
    n = np.abs(T.analysed(y, c))
    k = min(len(m), len(n))
    assert np.linalg.norm(m[:k] - n[:k]) < 0.35 * np.linalg.norm(m[:k])


def test_high_pass_removes_the_mean(spark):
    x = T.high_pass(spark.createDataFrame([(0, [1.0] * 4000)], "utt long, x array<double>"), 16000).first()["x"]
    assert abs(x[-1]) < 0.01


def test_edit_distance(spark):
    def plain(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a):
            e = [i + 1]
            for j, y in enumerate(b):
                e.append(min(d[j + 1] + 1, e[j] + 1, d[j] + (x != y)))
            d = e
        return d[-1]

    rows = [([str(v) for v in RNG.integers(0, 4, RNG.integers(0, 7))], [str(v) for v in RNG.integers(0, 4, RNG.integers(0, 7))]) for _ in range(60)] + [([], []), (["a"], [])]
    df = M.word_errors(spark.createDataFrame(rows, "hyp array<string>, ref array<string>"), [])
    for r in df.collect():
        assert r["err"] == plain(r["hyp"], r["ref"])
        assert (r["wer"] is None) == (len(r["ref"]) == 0)


def test_strict_join_and_scripts_fail(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k long"), spark.createDataFrame([(1, 5)], "k long, v long")
    with pytest.raises(Exception, match="no such key"):
        R.strict_join(a, b, "k").collect()
    lines = lambda *x: spark.createDataFrame([(v,) for v in x], "value string")
    for bad, why in ((("a b c",), "wrong number"), (("a x", "a y"), "occurs twice"), (("a cat x |",), "wrong number")):
        with pytest.raises(Exception, match=why):
            S.parse_script(lines(*bad)).collect()
    with pytest.raises(Exception, match="commands"):
        S.parse_script(lines("a cat x |"), tokens=2, restrict=False).collect()
    assert S.parse_script(lines("", "  ")).count() == 0


def test_hysteresis_like_a_loop(spark):
    flags = [(k, t, bool(v)) for k in range(5) for t, v in enumerate(RNG.random(80) < 0.5)]

    def loop(xs, cache):
        c, opened, out = 0, None, []
        for t, v in enumerate(xs):
            if v:
                c = min(c + 1, cache)
            elif opened is not None:
                c -= 1
            if opened is None and c >= cache:
                opened = max(t - cache, 0)
            elif opened is not None and c <= 0:
                out.append((opened, t))
                c, opened = 0, None
        return out + ([(opened, len(xs) - 1)] if opened is not None else [])

    got = W.hysteresis(spark.createDataFrame(flags, "key long, t long, active boolean"), ["key"], 3).collect()
    want = [(k, *g) for k in range(5) for g in loop([v for q, _, v in flags if q == k], 3)]
    assert sorted((r["key"], r["beg"], r["end"]) for r in got) == sorted(want)


def test_chunks_differ_by_one(spark):
    got = R.chunked(spark.range(23).withColumnRenamed("id", "k"), "k", 5).groupBy("chunk").count().orderBy("chunk").collect()
    assert [r["count"] for r in got] == [5, 5, 5, 4, 4]


def test_exponential_integral():
    v = np.array([0.05, 0.5, 1.0, 2.0, 10.0])
    grid = np.arange(0, 12, 1e-5)
    want = [np.sum(np.exp(-x * np.exp(grid))) * 1e-5 for x in v]
    assert np.allclose(E.exponential_integral(v), want, rtol=1e-3)


def test_generalised_eigenvector_solves_the_problem():
    a = RNG.standard_normal((5, 4, 8)) + 1j * RNG.standard_normal((5, 4, 8))
    b = RNG.standard_normal((5, 4, 8)) + 1j * RNG.standard_normal((5, 4, 8))
    s, n = a @ a.conj().transpose(0, 2, 1), b @ b.conj().transpose(0, 2, 1)
    v = L.principal(s, n)
    top = np.linalg.eigvals(np.linalg.solve(n, s)).real.max(axis=1)
    rayleigh = np.einsum("fi,fij,fj->f", v.conj(), s, v).real / np.einsum("fi,fij,fj->f", v.conj(), n, v).real
    assert np.allclose(rayleigh, top, rtol=1e-6)


def test_dereverberation_removes_an_echo():
    s = RNG.standard_normal((1, 600)) + 1j * RNG.standard_normal((1, 600))
    y = s.copy()
    y[:, 3:] += 0.7 * s[:, :-3]
    out = E.dereverberated(y, taps=6, delay=3, context=1, rounds=3)
    assert np.linalg.norm(out - s) < 0.5 * np.linalg.norm(y - s)
    short = y[:, :5]
    assert E.dereverberated(short, 6, 3, 1, 2) is short


@pytest.mark.parametrize("improved", [False, True])
def test_noise_gain_lowers_noise_and_keeps_speech(improved):
    rng = np.random.default_rng(1)
    p = rng.exponential(1.0, (120, 20))
    p[60:80, 5:10] += 200
    g = E.suppressed(p, improved)
    assert g.min() > 0 and np.isfinite(g).all()
    assert g[62:78, 5:10].mean() > 2 * g[30:58].mean()


def test_wave_files_and_archives(spark, tmp_path):
    import struct

    x = (np.arange(-50, 50) / 64).tolist()
    files = K.encode_waves(spark.createDataFrame([(1, x)], "utt long, x array<double>"))
    K.export(files, str(tmp_path / "w"), "wav")
    back = S.read_waves(S.scan_folder(spark, str(tmp_path / "w"), "wav")).first()
    assert back["key"] == "1" and np.allclose(back["x"], x, atol=1 / 32768)
    with pytest.raises(Exception, match="sample rate"):
        S.read_waves(S.scan_folder(spark, str(tmp_path / "w"), "wav"), sr=8000).collect()
    m = np.arange(6, dtype="<f4").reshape(2, 3)
    record = b"k1 \0BFM " + struct.pack("<bibi", 4, 2, 4, 3) + m.tobytes() + b"k2 \0BFV " + struct.pack("<bi", 4, 3) + m[0].tobytes()
    (tmp_path / "a.ark").write_bytes(record)
    got = A.read_whole(spark, str(tmp_path / "a.ark")).orderBy("key").collect()
    assert [(r["key"], r["rows"], r["cols"], r["x"]) for r in got] == [("k1", 2, 3, m.ravel().tolist()), ("k2", 1, 3, m[0].tolist())]


def test_si_snr_of_equal_signals_is_high(spark):
    x = [(0, float(v), float(v) * 3 + 1) for v in RNG.standard_normal(500)]
    got = M.si_snr(spark.createDataFrame(x, "utt long, ref double, est double"), ["utt"]).first()["value"]
    assert got > 80 and not math.isnan(got)


def test_word_errors_of_whole_turns(spark, tmp_path):
    """met05 and agg05 on turns of more than twelve words against a plain table of distances."""
    from tessitura.plans import estimates

    def distance(a, b):
        last = list(range(len(b) + 1))
        for i, x in enumerate(a):
            now = [i + 1]
            for j, y in enumerate(b):
                now.append(min(now[-1] + 1, last[j + 1] + 1, last[j] + (x != y)))
            last = now
        return last[-1]

    texts = [" ".join(np.random.default_rng(k).choice(list("abcdef"), n)) for k, n in enumerate((5, 30, 41, 13, 25))]
    rows = [(1, k, "user" if k % 2 else "assistant", t) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    want = {k: (distance(texts[k].split(), texts[k + 1].split()), len(texts[k + 1].split())) for k in range(4)}
    assert {r["turn"]: (r["err"], r["len"]) for r in estimates.met05(spark, str(tmp_path)).collect()} == want
    rate = {r["cls"]: r["rate"] for r in estimates.agg05(spark, str(tmp_path)).collect()}
    for cls, turns in (("assistant", (0, 2)), ("user", (1, 3))):
        assert abs(rate[cls] - 100 * sum(want[k][0] for k in turns) / sum(want[k][1] for k in turns)) < 1e-5
