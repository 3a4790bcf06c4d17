"""Block-wise transforms against whole waves, assignment against enumeration, separation scores against dense least squares, and
the binned interval join against a loop."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessitura.operators import assignment as A
from tessitura.operators import blocks as B
from tessitura.operators import estimation as E
from tessitura.operators import metrics as M
from tessitura.operators import transforms as T
from tessitura.operators import windows as W

RNG = np.random.default_rng(12)
WAVES = {k: RNG.normal(size=n) for k, n in enumerate((1, 5, 15, 16, 17, 31, 32, 33, 64, 100, 257))}


@pytest.fixture(scope="module")
def waves(spark):
    return spark.createDataFrame([(k, x.tolist()) for k, x in WAVES.items()], "utt long, x array<double>").repartition(3).cache()


CONFIGS = [
    T.StftConfig(16, 8, False), T.StftConfig(16, 8, True), T.StftConfig(12, 5, True, True), T.StftConfig(12, 5, True, False),
    T.StftConfig(16, 4, True, pad="zero"), T.StftConfig(16, 16, False, window="rectangular"), T.StftConfig(16, 8, True, window="sqrthann"),
]


@pytest.mark.parametrize("size", [16, 17, 40, 1000])
@pytest.mark.parametrize("config", CONFIGS, ids=lambda c: f"{c.frame_len}-{c.frame_hop}-{c.center}-{c.power_of_two}-{c.pad}-{c.window}")
def test_frames_of_blocks_are_those_of_whole_waves(spark, waves, config, size):
    blocks = B.cut(waves, ["utt"], size)
    got = {(r["utt"], r["t"]): (r["re"], r["im"]) for r in B.stft_frames(blocks, config, ["utt"], size).collect()}
    want = {(k, t): (y.real, y.imag) for k, x in WAVES.items() for t, y in enumerate(T.analysed(x, config))}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-12) for k in want)


@pytest.mark.parametrize("exact", [False, True])
@pytest.mark.parametrize("size", [16, 23, 64])
@pytest.mark.parametrize("config", CONFIGS[:4], ids=lambda c: f"{c.frame_len}-{c.frame_hop}-{c.center}-{c.power_of_two}")
def test_synthesis_by_blocks_is_that_of_whole_waves(spark, waves, config, size, exact):
    keep = waves.select("utt", F.size("x").alias("n")) if exact else None
    frames = T.stft_frames(waves, config)
    out = B.istft_blocks(frames, config, ["utt"], size, keep)
    assert out.agg(F.max(F.size("x"))).first()[0] <= size
    got = {r["utt"]: r["x"] for r in B.gathered(out, ["utt"]).collect()}
    want = {k: T.synthesised(T.analysed(x, config), config, len(x) if exact else None) for k, x in WAVES.items()}
    assert got.keys() == {k for k, x in want.items() if len(x)} and all(np.allclose(got[k], want[k], atol=1e-12) for k in got)


def test_blocks_must_hold_a_frame(waves):
    with pytest.raises(ValueError, match="frame"):
        B.stft_frames(B.cut(waves, ["utt"], 8), CONFIGS[0], ["utt"], 8)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 6])
@pytest.mark.parametrize("ties", [False, True])
def test_assignment_by_enumeration(n, ties):
    cost = RNG.integers(0, 3, (60, n, n)).astype(float) if ties else RNG.normal(size=(60, n, n))
    got = A.assigned(cost)
    for c, columns in zip(cost, got, strict=True):
        totals = [(round(sum(c[i, j] for i, j in enumerate(p)), 9), p) for p in itertools.permutations(range(n))]
        assert tuple(columns) == min(totals)[1]
        assert A.rank(columns) == list(itertools.permutations(range(n))).index(tuple(columns))


def test_large_assignments_have_no_better_neighbour():
    """Prices prove optimality: no cost is below the sum of its prices, and those of the assignment meet it."""
    cost = RNG.normal(size=(3, 60, 60))
    column, u, v = A._solved(cost)
    slack = cost - u[:, :, None] - v[:, None, :]
    assert slack.min() > -1e-9 and np.abs(np.take_along_axis(slack, column[:, :, None], axis=2)).max() < 1e-9


def test_twelve_speakers(spark):
    scores = RNG.normal(size=(5, 12, 12))
    order = [RNG.permutation(12) for _ in range(5)]
    for k in range(5):
        scores[k, np.arange(12), order[k]] += 20
    rows = [(k, i, j, float(scores[k, i, j])) for k in range(5) for i in range(12) for j in range(12)]
    rows += [(9, i, j, None if i == j == 0 else 1.0) for i in range(12) for j in range(12)]
    got = {r["utt"]: r for r in M.best_permutation(spark.createDataFrame(rows, "utt long, est_spk long, ref_spk long, value double"), ["utt"], 12).collect()}
    for k in range(5):
        assert got[k]["p"] == A.rank(order[k]) and got[k]["value"] == pytest.approx(scores[k, np.arange(12), order[k]].mean())
    assert got[9]["value"] is None


def test_many_classes_are_aligned(spark):
    """Seven classes, whose masks every bin has in an order of its own."""
    base = RNG.random((7, 40)) ** 4
    orders = [RNG.permutation(7) for _ in range(6)]
    rows = [(1, k, t, f, float(base[orders[f][k], t] + 0.01 * RNG.random())) for f in range(6) for k in range(7) for t in range(40)]
    got = np.zeros((6, 7, 40))
    for r in E.aligned(spark.createDataFrame(rows, "utt long, k long, t long, f long, m double")).collect():
        got[r["f"], r["k"], r["t"]] = r["m"]
    assert np.abs(got - got[:1]).max() < 0.02


@pytest.mark.parametrize("taps", [1, 8, 32])
def test_separation_scores_like_dense_least_squares(spark, taps):
    n, refs = 300, RNG.normal(size=(3, 300))
    mix = np.array([[1, 0.3, 0.1], [0.2, 1, 0.3], [0.1, 0.2, 1]]) @ refs + 0.05 * RNG.normal(size=(3, n))
    est = np.stack([np.convolve(x, RNG.normal(size=4))[:n] for x in mix])
    df = spark.createDataFrame([(1, est.tolist(), refs.tolist()), (2, [], []), (3, [[]], [[]])], "utt long, ests array<array<double>>, refs array<array<double>>")
    got = {(r["est_spk"], r["ref_spk"]): (r["sdr"], r["sir"], r["sar"]) for r in M.separation_scores(df, taps).collect()}
    shifted = lambda x: np.stack([np.concatenate((np.zeros(k), x, np.zeros(taps - 1 - k))) for k in range(taps)])
    db = lambda a, b: 10 * np.log10(((a**2).sum() + M.EPS) / ((b**2).sum() + M.EPS))
    whole = np.concatenate([shifted(x) for x in refs])
    for i in range(3):
        e = np.append(est[i], np.zeros(taps - 1))
        every = np.linalg.lstsq(whole.T, e, rcond=None)[0] @ whole
        for j in range(3):
            s = shifted(refs[j])
            target = np.linalg.lstsq(s.T, e, rcond=None)[0] @ s
            assert np.allclose(got[i, j], (db(target, e - target), db(target, every - target), db(every, e - every)), atol=1e-6)
    assert len(got) == 9


def test_full_filters_on_longer_signals(spark):
    """512 taps: what a filter of the reference's makes is found again."""
    refs = RNG.normal(size=(2, 6000))
    est = np.stack([np.convolve(x, RNG.normal(size=400))[:6000] for x in refs])
    s = M.separation(est, refs, 512)
    assert s[0, 0, 0] > 15 and s[1, 1, 0] > 15 and s[0, 1, 0] < 0 and s[1, 0, 0] < 0


@pytest.mark.parametrize("width", [None, 0.7, 3.0, 1000.0])
def test_interval_join_like_a_loop(spark, width):
    rows = [(k, float(t), 10 * k + t) for k in range(3) for t in np.round(RNG.random(80) * 50, 2).tolist() + [0.0, 10.0]]
    cuts = [(k, float(b), float(b + n)) for k in range(4) for b, n in zip(RNG.integers(-5, 50, 12), [0, 1, 1, 2, 3, 5, 8, 20, 60, 1, 0, 2], strict=True)]
    df, seg = spark.createDataFrame(rows, "key long, t double, x double"), spark.createDataFrame(cuts, "key long, beg double, end double")
    got = sorted((r["key"], r["t"], r["x"], r["beg"], r["end"]) for r in W.within(df, seg, ["key"], width).collect())
    assert got == sorted((k, t, x, b, e) for k, t, x in rows for j, b, e in cuts if j == k and b <= t < e)
    assert W.within(df, seg.where("false"), ["key"], width).count() == 0
