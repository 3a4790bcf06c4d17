"""Mixture models that are stored and resumed, and the checks of simulation plans."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessitura.operators import estimation as E
from tessitura.operators import families as A
from tessitura.operators import simulation as S


@pytest.fixture(scope="module")
def spec(spark):
    rng = np.random.default_rng(9)
    rows = [(u, c, t, f, *rng.normal(size=2).tolist()) for u in range(3) for c in range(3) for t in range(20) for f in range(4)]
    return spark.createDataFrame(rows, "utt long, ch long, t long, f long, re double, im double").repartition(3).cache()


def table(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


def same(a, b, *columns, keys=("utt", "f")):
    a, b = table(a, *keys), table(b, *keys)
    return a.keys() == b.keys() and all(np.allclose(a[k][c], b[k][c], atol=1e-9) for k in a for c in columns)


@pytest.mark.parametrize(("family", "classes", "weights"), [("gaussian", 2, False), ("gaussian", 3, True), ("angular", 2, True)])
def test_five_and_five_rounds_are_ten(spark, spec, tmp_path, family, classes, weights):
    A.fitted(spec, family, classes, 5, weights=weights).write.parquet(str(tmp_path / "five"))
    five = spark.read.parquet(str(tmp_path / "five"))
    ten = A.fitted(spec, family, classes, 10, five, weights=weights)
    whole = A.fitted(spec, family, classes, 10, weights=weights)
    assert same(ten, whole, "alpha", "re", "im", "rounds") and not same(five, whole, "re")
    masks = E.mixture_masks(spec, classes, 10, family == "angular", weights)
    assert same(A.masks_of(spec, ten, family), masks, "m", keys=("utt", "f", "k", "t")) or classes != 2 or family != "gaussian"


def test_masks_of_the_stored_model_are_those_of_the_estimator(spark, spec):
    assert same(A.masks_of(spec, A.fitted(spec, rounds=6)), E.mixture_masks(spec, 2, 6), "m", keys=("utt", "f", "k", "t"))


def test_finished_bins_are_passed_over(spark, spec):
    """What has had its rounds isn't fitted again: a state that no fit would give stays. Bins without frames stay too."""
    odd = A.fitted(spec, rounds=3).withColumn("re", F.transform("re", lambda x: F.lit(7.0)))
    far = odd.limit(1).withColumn("utt", F.lit(99).cast("long")).withColumn("rounds", F.lit(1).cast("long"))
    stored = spark.createDataFrame(odd.where("utt = 0").unionByName(far).collect(), A.MODEL)
    out = table(A.fitted(spec, rounds=3, model=stored), "utt", "f")
    assert all(set(r["re"]) == {7.0} for (u, _), r in out.items() if u in (0, 99)) and len(out) == 13
    assert out[[k for k in out if k[0] == 99][0]]["rounds"] == 1
    assert all(set(r["re"]) != {7.0} for (u, _), r in out.items() if u in (1, 2))


def test_start_from_given_masks(spark, spec):
    first = E.mixture_masks(spec, 2, 4)
    y, gamma = np.zeros((3, 20), complex), np.zeros((2, 20))
    for r in spec.where("utt = 1 AND f = 2").collect():
        y[r["ch"], r["t"]] = r["re"] + 1j * r["im"]
    for r in first.where("utt = 1 AND f = 2").collect():
        gamma[r["k"], r["t"]] = r["m"]
    kind = A.FAMILIES["gaussian"]
    alpha, r = A.rounds_of(kind, y, np.full(2, 0.5), kind.start(y, 2, None)[0], gamma, 3, False)
    got = table(A.fitted(spec, rounds=3, masks=first), "utt", "f")[1, 2]
    assert np.allclose(got["re"], r.real.ravel()) and np.allclose(got["alpha"], alpha)


def test_a_family_of_ones_own(spark, spec):
    class Fixed(A.Gaussian):
        def update(self, y, gamma, r):
            return np.eye(len(y)) * gamma.sum()

    got = A.fitted(spec, Fixed(), 2, 1).collect()
    assert len(got) == 12 and all(np.count_nonzero(r["re"]) == 6 for r in got)


def test_plans_that_keep_to_the_rules(spark):
    rows = [
        (1, [1.0], [], [], [], [], [], [], [], [], []),
        (2, [1.0, 2.0], [1.0, 1.0], [3.0], [0.0, 5.0], [1.0], [1.0], [9.0], [2.0], [1.0], [10.0], ),
    ]
    names = ["speakers", "speaker_rirs", "sdrs", "speaker_begins", "noises", "noise_rirs", "noise_snrs", "noise_begins", "isotropic", "isotropic_snrs"]
    plan = spark.createDataFrame(rows, "utt long, " + ", ".join(f"{n} array<double>" for n in names))
    assert S.validated(plan).count() == 2 and {r["n"] for r in S.violations(plan).collect()} == {0}
    assert S.validated(plan.select("utt", F.slice("speakers", 1, 1).alias("speakers"))).count() == 2
    assert S.validated(plan.limit(0)).count() == 0


@pytest.mark.parametrize(("broken", "rule"), [
    ({"speaker_rirs": [1.0]}, "a response for every speaker"), ({"sdrs": []}, "ratios for more than one"), ({"sdrs": [1.0, 2.0]}, "a ratio for every speaker"),
    ({"speaker_begins": [1.0]}, "a beginning for every speaker"), ({"noises": [1.0, 2.0], "noise_rirs": [1.0], "noise_snrs": [1.0, 1.0]}, "a response for every noise"),
    ({"noises": [1.0]}, "a ratio for every noise"), ({"noises": [1.0, 2.0], "noise_snrs": [1.0]}, "a ratio for every noise"),
    ({"noises": [1.0], "noise_snrs": [1.0], "noise_begins": [1.0, 2.0]}, "a beginning for every noise"), ({"isotropic": [1.0]}, "isotropic"), ({"rir_channels": [4.0, 2.0]}, "channels"),
])
def test_each_rule_of_a_plan(spark, broken, rule):
    row = {"speakers": [1.0, 2.0], "sdrs": [3.0], **broken}
    plan = spark.createDataFrame([(5, *row.values())], "utt long, " + ", ".join(f"{n} array<double>" for n in row))
    with pytest.raises(Exception, match=rule):
        S.validated(plan)


def uneven(spark):
    """Bins of several sizes, one that lacks a cell, one without a number, more rows than an Arrow batch of the tests has."""
    rng = np.random.default_rng(4)
    rows = [(u, c, t, f, *rng.normal(size=2).tolist()) for u in range(5) for c in range(2 + u % 2) for t in range(6 + u) for f in range(3) if (u, c, t, f) != (2, 1, 3, 1)]
    rows += [(9, c, t, 0, float("nan"), 0.0) for c in range(2) for t in range(4)]
    y = {}
    for u, c, t, f, a, b in rows:
        y.setdefault((u, f), np.zeros((2 + u % 2 if u < 5 else 2, 6 + u if u < 5 else 4), complex))[c, t] = a + 1j * b
    return spark.createDataFrame(rows, "utt long, ch long, t long, f long, re double, im double").repartition(4), y


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("angular", [False, True])
def test_masks_are_made_in_batches_of_whole_bins(spark, small_batches, angular):
    """As one bin alone, however batches cut them; no Python group for each bin."""
    df, y = uneven(spark)
    masks = E.mixture_masks(df, 2, 4, angular, angular)
    assert "FlatMap" not in plan_of(masks)
    got = {}
    for r in masks.collect():
        got.setdefault((r["utt"], r["f"]), {})[r["k"], r["t"]] = r["m"]
    assert got.keys() == y.keys()
    for key, x in y.items():
        want = E.mixture(x if key != (9, 0) else x * np.nan, 2, 4, E._seed(key), angular, weights=angular)
        assert len(got[key]) == want.size and all(np.isclose(got[key][k, t], want[k, t], atol=1e-9, equal_nan=True) for k, t in got[key])


def test_models_are_fitted_in_batches_of_whole_bins(spark, small_batches, tmp_path):
    df, y = uneven(spark)
    df = df.where("utt <> 9")
    A.fitted(df.where("utt <> 1"), rounds=2).unionByName(A.fitted(df.where("utt = 1"), rounds=3)).write.parquet(str(tmp_path / "some"))
    whole, later = A.fitted(df, rounds=5), A.fitted(df, rounds=5, model=spark.read.parquet(str(tmp_path / "some")))
    assert "FlatMap" not in plan_of(whole) + plan_of(later) + plan_of(A.masks_of(df, whole))
    assert same(later, whole, "alpha", "re", "im", "rounds") and later.count() == len(y) - 1
    got = table(A.masks_of(df, later), "utt", "f", "k", "t")
    for key, x in y.items():
        want = E.mixture(x, 2, 5, None) if key != (9, 0) else np.zeros((0, 0))
        found = {k[2:]: r["m"] for k, r in got.items() if k[:2] == key}
        assert len(found) == want.size and all(abs(v - want[k]) < 1e-9 for k, v in found.items())


def test_a_bin_that_cannot_be_solved_leaves_the_others():
    def kernel(at):
        if at == slice(None) or at == 1:
            raise np.linalg.LinAlgError
        return (np.full(2, at),)

    found = A.attempted(A.FAMILIES["gaussian"], 3, kernel)
    assert found[1] is None and found[0][0][0] == 0 and found[2][0][0] == 2
