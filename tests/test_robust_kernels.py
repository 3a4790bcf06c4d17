"""Matrices that can't be solved cost their own row only."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessitura.operators import beamforming as B
from tessitura.operators import estimation as E
from tessitura.operators import linalg as L
from tessitura.operators import metrics as M
from tessitura.operators import spatial as P
from tessitura.sources import places
from tessitura.sources import sinks as K
from tessitura.sources import tables as T


def rows(spark, stack):
    return spark.createDataFrame([(k, np.real(x).ravel().tolist(), np.imag(x).ravel().tolist()) for k, x in enumerate(stack)], "k long, r_re array<double>, r_im array<double>").coalesce(1)


def test_singular_and_nan_matrices_give_nulls(spark):
    rng = np.random.default_rng(1)
    stack = rng.normal(size=(5, 3, 3)) + 1j * rng.normal(size=(5, 3, 3))
    stack[1] = 0
    stack[3, 0, 0] = np.nan
    out = L.per_row(rows(spark, stack), ["k"], ["r"], L.inverse, "x")
    got = {r["k"]: r for r in out.collect()}
    assert got[1]["x_re"] is None and got[3]["x_im"] is None and L.unsolved(out, "x").first()["n"] == 2
    for k in (0, 2, 4):
        x = (np.array(got[k]["x_re"]) + 1j * np.array(got[k]["x_im"])).reshape(3, 3)
        assert np.allclose(x, np.linalg.inv(stack[k]))


def test_all_rows_unsolved(spark):
    out = L.per_row(rows(spark, np.zeros((2, 2, 2))), ["k"], ["r"], L.inverse, "x")
    assert [r["x_re"] for r in out.collect()] == [None, None]


def test_beamformer_of_a_nan_covariance_is_counted(spark):
    """One NaN in a bin's spectrum: that bin has no weights, the others have."""
    rng = np.random.default_rng(2)
    cells = [(0, c, t, f, float("nan") if (c, t, f) == (0, 0, 1) else float(rng.normal()), float(rng.normal())) for c in range(2) for t in range(9) for f in range(3)]
    spec = spark.createDataFrame(cells, "utt long, ch long, t long, f long, re double, im double")
    mask = spark.createDataFrame([(0, t, f, float(rng.random())) for t in range(9) for f in range(3)], "utt long, t long, f long, m double")
    assert {r["f"] for r in B.supervised(spec, mask, "mvdr").where("re IS NOT NULL").select("f").distinct().collect()} == {0, 2}


def test_no_local_folder_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(ValueError, match="checkpoint.dir"):
        places.scratch(Session(), "x")


def recordings(spark, channels, seed=3):
    """(spec, mask): recordings with these channels each, five frames, two bins."""
    rng = np.random.default_rng(seed)
    cells = [(u, c, t, f, float(rng.normal()), float(rng.normal())) for u, own in channels.items() for c in own for t in range(5) for f in range(2)]
    masks = [(u, t, f, float(rng.random())) for u in channels for t in range(5) for f in range(2)]
    return spark.createDataFrame(cells, "utt long, ch long, t long, f long, re double, im double"), spark.createDataFrame(masks, "utt long, t long, f long, m double")


@pytest.mark.parametrize("kind", ["mvdr", "mpdr-whiten", "pmwf-eig", "gevd"])
def test_weights_of_recordings_that_lack_channels(spark, kind):
    """Recordings of four, three, two and one channels in one batch: each is solved as if alone, under its own channels."""
    has = {0: (0, 1, 2, 3), 1: (0, 2, 3), 2: (0, 3), 3: (0,)}
    spec, mask = recordings(spark, has)
    spec, mask = spec.coalesce(1), mask.coalesce(1)
    got = {(r["utt"], r["f"], r["ch"]): complex(r["re"], r["im"]) for r in B.supervised(spec, mask, kind).collect()}
    assert set(got) == {(u, f, c) for u, own in has.items() for c in own for f in range(2)}
    covs = {(m, r["utt"], r["f"], r["i"], r["j"]): complex(r["re"], r["im"]) for m, x in (("s", mask), ("n", mask.selectExpr("utt", "t", "f", "1 - m AS m"))) for r in L.covariance(spec, x).collect()}
    for u, own in has.items():
        for f in range(2):
            s, n = (np.array([[[covs[m, u, f, i, j] for j in own] for i in own]]) for m in "sn")
            want = B.WEIGHTS[kind](s, n)[0]
            mine = np.array([got[u, f, c] for c in own])
            assert np.isclose(abs(np.vdot(want, mine)), np.linalg.norm(want) * np.linalg.norm(mine)) and np.isclose(np.linalg.norm(want), np.linalg.norm(mine), rtol=1e-6)


def test_online_weights_and_subspaces_of_recordings_that_lack_channels(spark):
    spec, mask = recordings(spark, {0: (0, 1, 2, 3), 1: (0, 2, 3), 2: (0,)})
    assert B.online(spec, mask, "mvdr", 3).count() == 3 * 5 * 2
    steer = P.steering(spark, 5, 2, 16000, topo=(0.0, 0.05, 0.1, 0.15)).select("a", "ch", "f", "re", "im")
    cov = L.covariance(spec, mask)
    got = {(r["utt"], r["a"]): r["e"] for r in P.music_scores(L.packed(cov, ["utt", "f"], "r"), steer).collect()}
    alone = P.music_scores(L.packed(cov.where("utt = 1"), ["utt", "f"], "r"), steer.where("ch <> 1"))
    assert len(got) == 15 and all(np.isclose(got[1, r["a"]], r["e"]) for r in alone.collect())
    assert all(abs(got[2, a]) < 1e-9 for a in range(5))


def test_generalised_eigenvalues_carry_no_load(spark):
    """Noise that can be factored is taken as it is; only the singular one is loaded."""
    rng = np.random.default_rng(5)
    a, b = (rng.normal(size=(6, 4, 9)) + 1j * rng.normal(size=(6, 4, 9)) for _ in "rn")
    r, n = (x @ x.conj().transpose(0, 2, 1) for x in (a, b))
    n[5] = n[5, :, :1] @ n[5, :, :1].conj().T
    got = L.generalized_eigenvalues(r, n)
    want = np.sort(np.linalg.eigvals(np.linalg.solve(n[:5], r[:5])).real, axis=1)
    assert np.allclose(got[:5], want, rtol=1e-12, atol=0) and np.isfinite(got[5]).all()
    v = L.principal(r, n)[:5, :, None]
    assert np.allclose(r[:5] @ v, want[:, -1:, None] * (n[:5] @ v), rtol=0, atol=1e-11)


@pytest.mark.parametrize("later", [None, 0.7])
def test_online_weights_follow_the_recursion_in_one_pass(spark, later):
    """Both covariances of every chunk against a plain recursion, in one plan without a second pass over the spectrum. Of one
    recording a channel ends early, in another no cell has a mask in the middle chunk."""
    spec, mask = recordings(spark, {0: (0, 1, 2), 1: (0, 1)})
    spec, mask = spec.where("utt = 1 OR ch < 2 OR t < 2"), mask.where("utt = 0 OR t NOT IN (2, 3)")
    block = F.floor(F.col("t") / 2)
    out = E.forgetting(L.two_sums(spec, mask, block=block), L.TWO, 0.8, later)
    got = {(r["utt"], r["chunk"], r["f"], r["i"], r["j"]): (complex(r["s_re"], r["s_im"]), complex(r["n_re"], r["n_im"])) for r in out.collect()}
    for k, m in enumerate((mask, mask.withColumn("m", 1 - F.col("m")))):
        want, state = {}, {}
        for r in L.covariance(spec, m, block=block).where("i <= j").orderBy("blk").collect():
            e, x = (r["utt"], r["f"], r["i"], r["j"]), complex(r["re"], r["im"])
            state[e] = 0.8 * state[e] + (0.2 if later is None else later) * x if e in state else x
            want[e[0], r["blk"], *e[1:]] = state[e]
        assert got.keys() == want.keys() and all(np.isclose(got[x][k], want[x]) for x in want)
    plan = B.online(spec, mask, "mvdr", 2)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Union") == 1
    assert B.online(spec.where("t < 0"), mask.where("t < 0"), "mvdr", 2).collect() == []


def test_matrices_that_are_not_square_give_nulls(spark):
    rows_ = [(0, [1.0, 0.0, 0.0, 2.0], [0.0] * 4), (1, [1.0, 2.0, 3.0], [0.0] * 3), (2, [4.0], [0.0]), (3, [], [])]
    df = spark.createDataFrame(rows_, "k long, r_re array<double>, r_im array<double>").coalesce(1)
    got = {r["k"]: r["x_re"] for r in L.per_row(df, ["k"], ["r"], L.inverse, "x").collect()}
    assert got == {0: [1.0, 0.0, 0.0, 0.5], 1: None, 2: [0.25], 3: None}


def test_likelihood_goes_over_the_channels_there_are(spark):
    spec, mask = recordings(spark, {0: (0, 1, 2, 3), 1: (0, 2, 3), 2: (0, 1)})
    steer = P.steering(spark, 5, 2, 16000, topo=(0.0, 0.05, 0.1, 0.15)).select("a", "ch", "f", "re", "im")
    whole = {(r["utt"], r["a"]): r["ll"] for r in P.ml_likelihood(spec.join(mask, ["utt", "t", "f"]), steer, mask="m").collect()}
    for u, own in ((1, "ch <> 1"), (2, "ch < 2")):
        alone = P.ml_likelihood(spec.where(f"utt = {u}").join(mask, ["utt", "t", "f"]), steer.where(own), mask="m").collect()
        assert len(alone) == 5 and all(np.isclose(whole[u, r["a"]], r["ll"]) for r in alone)


def test_dot_products_meet_in_blocks_and_lots(spark, monkeypatch):
    """More queries than a block and more rows than a lot, lengths that differ, and vectors that are null or hold a null."""
    for name, x in (("BLOCK", 5), ("ROWS", 7), ("PRODUCTS", 11)):
        monkeypatch.setattr(M, name, x)
    rng = np.random.default_rng(4)
    v = {k: None if k == 3 else [float(x) for x in rng.normal(size=2 if k % 9 == 5 else 3)] for k in range(31)}
    v[8][1] = None
    v[12] = []
    rows_ = spark.createDataFrame([(k, f"s{k}", x) for k, x in v.items()], "a long, name string, v array<double>")
    queries = spark.createDataFrame([(k, v[k]) for k in v if k % 2 == 0], "b long, w array<double>")
    out = M.dot_products(rows_, queries)
    got = {(r["a"], r["name"], r["b"]): r["dot"] for r in out.collect()}
    assert out.count() == len(got) == 31 * 16
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode(d_q" not in plan and "Join" not in plan
    for (a, name, b), dot in got.items():
        x, y = v[a], v[b]
        fits = x is not None and y is not None and None not in x and None not in y and len(x) == len(y)
        assert name == f"s{a}" and (np.isclose(dot, np.dot(x, y)) if fits else dot is None)


def test_dot_products_of_nothing(spark):
    none = spark.createDataFrame([], "a long, v array<double>")
    some = spark.createDataFrame([(1, [1.0])], "a long, v array<double>")
    asked = spark.createDataFrame([(2, [3.0])], "b long, w array<double>")
    assert M.dot_products(none, asked).collect() == [] and M.dot_products(some, asked.limit(0)).collect() == []
    assert [tuple(r) for r in M.dot_products(some, asked).collect()] == [(1, 2, 3.0)]


def shuffled(plan):
    """Rows that all exchanges of an executed plan wrote."""
    kind = plan.getClass().getSimpleName()
    inner = plan.executedPlan() if kind == "AdaptiveSparkPlanExec" else plan.plan() if kind.endswith("QueryStageExec") else None
    below = [inner] if inner is not None else [plan.children().apply(k) for k in range(plan.children().size())]
    return sum(shuffled(x) for x in below) + (plan.metrics().apply("shuffleRecordsWritten").value() if kind == "ShuffleExchangeExec" else 0)


def test_dot_products_write_each_vector_once(spark, monkeypatch):
    """However many parts the other side has; copies for each part made the disk grow with the square of the table."""
    for name, x in (("BLOCK", 5), ("ROWS", 7)):
        monkeypatch.setattr(M, name, x)
    rows_ = spark.range(120).selectExpr("id AS a", "array(double(id), 1D) AS v")
    queries = spark.range(60).selectExpr("id AS b", "array(2D, double(id)) AS w")
    out = M.dot_products(rows_, queries)
    assert {(r["a"], r["b"]): r["dot"] for r in out.collect()} == {(a, b): 2.0 * a + b for a in range(120) for b in range(60)}
    assert 0 < shuffled(out._jdf.queryExecution().executedPlan()) <= 120 + 60


def test_dot_products_of_single_precision(spark):
    """Vectors of floats travel as they are and are multiplied as doubles."""
    rng = np.random.default_rng(5)
    v = rng.normal(size=(20, 8)).astype(np.float32)
    rows_ = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)] + [(20, None), (21, [1.0])], "a long, v array<float>")
    got = {(r["a"], r["b"]): r["dot"] for r in M.dot_products(rows_, rows_.where("a < 4").selectExpr("a AS b", "v AS w")).collect()}
    assert len(got) == 22 * 4
    for (a, b), dot in got.items():
        assert dot is None if a > 19 else abs(dot - v[a].astype(float) @ v[b].astype(float)) < 1e-14


def test_files_are_decoded_in_pieces(spark, monkeypatch):
    """A batch of many files isn't decoded at once; a file larger than a piece is one."""
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array([b"x" * n for n in (3, 3, 3, 20, 0, 0, 9)], pa.binary())], ["k", "content"])
    monkeypatch.setattr(T, "PIECE", 7)
    assert [b.column(0).to_pylist() for b in T.pieces(batch)] == [[0, 1], [2], [3], [4, 5], [6]]
    assert list(T.pieces(batch.slice(0, 0))) == []
    arrays = spark.range(40).selectExpr("id AS utt", "transform(sequence(0, int(id)), i -> double(i + id)) AS x").coalesce(1)
    files = K.encode_arrays(arrays, "float64").selectExpr("string(utt) AS key", "'' AS path", "content")
    assert {int(r["key"]): r["x"] for r in T.read_arrays(files).collect()} == {k: [float(i + k) for i in range(k + 1)] for k in range(40)}
