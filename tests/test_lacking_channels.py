"""Registered queries over recordings that lack channels, or are silent: every recording as if it were alone."""

import itertools

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import test_values as V

from tessitura.plans import catalog

Q, SQL = catalog.queries(), catalog.oracle_sql()
VECTORS = np.concatenate(V.WAVE)
#: The channels of eleven recordings; without channel 0 there is no mask, and no result.
HAS = {0: (0, 1, 2, 3), 1: (0, 2, 3), 2: (0, 1, 2, 3), 3: (0, 3), 4: (1, 2, 3), 5: (0, 1, 2), 6: (0,), 7: (0, 1, 2, 3), 8: (3,), 9: (0, 1, 2, 3), 10: (0, 1)}
MASKED = {u: own for u, own in HAS.items() if 0 in own}


def stored(folder, vectors):
    """A table of embeddings from {vec_id: vector}."""
    x = pa.array([np.asarray(v, dtype=np.float32) for v in vectors.values()], pa.list_(pa.float32()))
    pq.write_table(pa.table({"vec_id": pa.array(list(vectors), pa.int64()), "embedding": x, "label": pa.array([0] * len(vectors), pa.int32())}), f"{folder}/embeddings.parquet")
    return str(folder)


def by_sql(folder, name, keys):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    return con.execute(SQL[name]).df().set_index(keys).sort_index()


@pytest.fixture(scope="module")
def lacking(tmp_path_factory):
    return stored(tmp_path_factory.mktemp("lacking"), {4 * u + c: VECTORS[4 * u + c] for u, own in HAS.items() for c in own})


@pytest.fixture(scope="module")
def silent(tmp_path_factory):
    """Three recordings; the second has nothing but zeros."""
    return stored(tmp_path_factory.mktemp("silent"), {k: VECTORS[k] * (k // 4 != 1) for k in range(12)})


def result(spark, folder, name, *keys):
    """The query's result under its keys, each once."""
    found = Q[name](spark, folder).toPandas().set_index(list(keys)).sort_index()
    assert found.index.is_unique
    return found


def wanted(of, keys):
    """A table under these keys from {key: values}."""
    return pd.DataFrame.from_dict(of, orient="index").set_axis(pd.MultiIndex.from_tuples(of, names=keys), axis=0).sort_index()


def same(found, want, atol=1e-4):
    assert found.index.equals(want.index.set_names(found.index.names)) or list(found.index) == list(want.index)
    assert np.allclose(found.to_numpy(dtype=float), want.to_numpy(dtype=float), rtol=1e-4, atol=atol)


def spectra(u):
    """The recording's own channels: channels x frames x bins."""
    return V.X[u, list(HAS[u])]


def covariances(u, f, frames=slice(None)):
    return [V.cov(spectra(u)[:, frames, f], m[frames, f]) for m in (V.MASK, 1 - V.MASK)]


@pytest.mark.parametrize("name", ["bf07_mpdr", "bf08_pmwf", "bf08_pmwf_rank1"])
def test_power_of_beamformers(spark, lacking, name):
    want = {}
    for u, f in itertools.product(MASKED, range(V.BINS)):
        w = V.WEIGHTS[name](*covariances(u, f))
        want[u, f] = [(np.abs(w.conj() @ spectra(u)[:, :, f]) ** 2).sum()]
    same(result(spark, lacking, name, "utt", "f"), wanted(want, ["utt", "f"]), atol=1e-3)


@pytest.mark.parametrize("name", ["bf08_pmwf_rank1", "bf07_mpdr_whitened"])
def test_silent_recordings_have_no_power_and_lose_no_row(spark, silent, name):
    power = result(spark, silent, name, "utt", "f")["power"]
    assert len(power) == 3 * V.BINS and (power[1] == 0).all() and (power[[0, 2]] > 0).all()


def test_blockwise_beamformer_in_all_blocks(spark, lacking):
    want = {}
    for u, f, frames in itertools.product(MASKED, range(V.BINS), (slice(0, 4), slice(4, 7))):
        s, n = covariances(u, f, frames)
        y = V.distortionless(n, V.top(s)).conj() @ spectra(u)[:, frames, f]
        want |= {(u, frames.start + t, f): [abs(v)] for t, v in enumerate(y)}
    z = result(spark, lacking, "bf13_blockwise_mvdr", "utt", "t", "f")
    same(np.hypot(z[["re"]], z[["im"]].to_numpy()), wanted(want, ["utt", "t", "f"]))


def test_wave_of_adaptive_beamformer(spark, lacking):
    """Weights, mask and overlap-add by hand; the first sample has no window on it."""
    want = {}
    for u in MASKED:
        y = np.zeros((V.FRAMES, V.BINS), dtype=complex)
        for f in range(V.BINS):
            s, n = covariances(u, f)
            y[:, f] = V.MASK[:, f] * (V.distortionless(n, V.top(s)).conj() @ spectra(u)[:, :, f])
        x, weight = np.zeros(64), np.zeros(64)
        for t in range(V.FRAMES):
            x[8 * t : 8 * t + 16] += np.fft.irfft(y[t]) * V.WINDOW
            weight[8 * t : 8 * t + 16] += V.WINDOW**2
        want |= {(u, n): [x[n] / weight[n]] for n in range(1, 64)}
    found = result(spark, lacking, "bf15_adaptive_to_wave", "utt", "n")
    assert len(found) == 64 * len(MASKED)
    same(found[found.index.get_level_values("n") > 0], wanted(want, ["utt", "n"]))


def loaded(u, f):
    r = covariances(u, f)[0]
    return r + 0.5 * np.trace(r).real / 4 * np.eye(len(r))


def elements(m, u, f):
    return {(u, f, i, j): [m[a, b].real, m[a, b].imag] for a, i in enumerate(HAS[u]) for b, j in enumerate(HAS[u])}


def test_inverses_go_over_the_channels_there_are(spark, lacking):
    want = {}
    for u, f in itertools.product(MASKED, range(V.BINS)):
        want |= elements(np.linalg.inv(loaded(u, f)), u, f)
    same(result(spark, lacking, "la02_inverse", "utt", "f", "i", "j")[["re", "im"]], wanted(want, ["utt", "f", "i", "j"]))


def test_matrices_without_an_inverse_lose_no_row(spark, silent):
    keys = ["utt", "f", "i", "j"]
    found, want = result(spark, silent, "la02_inverse", *keys), by_sql(silent, "la02_inverse", keys)
    assert list(found.index) == list(want.index) and len(found) == 3 * V.BINS * 16 and found.loc[1].isna().all(axis=None)
    same(found.loc[[0, 2]], want.loc[[0, 2], found.columns])


def test_power_sums_of_eigenvalues_equal_their_sql(spark, lacking):
    keys = ["utt", "f"]
    found, want = result(spark, lacking, "la03_eigenvalues", *keys), by_sql(lacking, "la03_eigenvalues", keys)
    assert len(found) == len(MASKED) * V.BINS
    same(found, want[found.columns], atol=2e-5)


def test_rank_one_matrices_of_own_channels(spark, lacking):
    want = {}
    for u, f in itertools.product(MASKED, range(V.BINS)):
        want |= elements(V.rank_one(covariances(u, f)[0]), u, f)
    same(result(spark, lacking, "la07_rank_one", "utt", "f", "i", "j")[["re", "im"]], wanted(want, ["utt", "f", "i", "j"]))


def test_systems_are_solved_over_the_channels_there_are(spark, lacking):
    want = {}
    for u, f in itertools.product(MASKED, range(V.BINS)):
        x = np.linalg.solve(loaded(u, f), covariances(u, f)[0][:, 0])
        want |= {(u, f, i): [v.real, v.imag] for i, v in zip(HAS[u], x)}
    same(result(spark, lacking, "la08_solve", "utt", "f", "i")[["re", "im"]], wanted(want, ["utt", "f", "i"]))


def test_systems_without_a_solution_lose_no_row(spark, silent):
    keys = ["utt", "f", "i"]
    found, want = result(spark, silent, "la08_solve", *keys), by_sql(silent, "la08_solve", keys)
    assert list(found.index) == list(want.index) and len(found) == 3 * V.BINS * 4 and found.loc[1].isna().all(axis=None)
    same(found.loc[[0, 2]], want.loc[[0, 2], found.columns])


def test_log_determinants_of_own_channels(spark, lacking):
    want = {}
    for u, f in itertools.product(MASKED, range(V.BINS)):
        v = np.linalg.eigvalsh(covariances(u, f)[0])
        want[u, f] = [np.log(np.maximum(v / v[-1], V.EPS)).sum()]
    same(result(spark, lacking, "la09_log_determinant", "utt", "f"), wanted(want, ["utt", "f"]), atol=1e-3)


#: Steering vectors: directions x bins x channels.
STEER = np.exp(-1j * np.pi * 16000 / 8 * np.arange(V.BINS)[:, None] * np.cos(np.pi * np.arange(19) / 18)[:, None, None] * np.array([0, 0.05, 0.1, 0.15]) / 343)


def test_subspaces_of_own_channels(spark, lacking):
    best = result(spark, lacking, "sp12_music_ssl", "utt")["a"]
    assert list(best.index) == list(MASKED)
    for u, own in MASKED.items():
        e = np.zeros(19)
        for f in range(V.BINS):
            v, s = V.top(covariances(u, f)[0]), STEER[:, f, own]
            e += np.einsum("ai,ij,aj->a", s.conj(), np.eye(len(own)) - np.outer(v, v.conj()), s).real
        assert e[best[u]] < e.min() + 1e-4


def test_likelihoods_equal_their_sql(spark, lacking):
    keys = ["utt", "a"]
    found, want = result(spark, lacking, "sp10_ml_ssl", *keys), by_sql(lacking, "sp10_ml_ssl", keys)
    assert len(found) == len(MASKED) * 19
    same(found, want, atol=2e-6)
