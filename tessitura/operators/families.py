"""Mixture models of each bin's frames whose state is a table, so that a later run goes on where one ended.

A family says how an observation is prepared, how likely a class makes it and how a class is fitted to weighted observations. Known
families are in FAMILIES; others are registered by name or given as objects. A model is a row a bin: (utt, f, rounds, alpha, re,
im), with the classes' weights and their matrices in row-major order. `fitted` runs only the bins that have had fewer rounds than
wanted, from their stored state, from given masks, or from a start of the family's own; others are carried over unread.

Cells are dealt and sorted by bin, so that a task sees whole bins one after the other in Arrow batches; all bins of a batch that have
the same numbers of channels and frames are one stack for numpy. The families given here take stacks, which are leading axes of their
arrays. One of a user's own is called bin by bin.

Defined results: a bin that can't be solved keeps the state it had, or is left out if it had none; rows of the model without any
frames stay. Frames and channels that a bin lacks count as zeros, as elsewhere."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EPS = 1.1920929e-07


def quadratic(y: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """y^H R^-1 y of each frame and log det R; R with floored eigenvalues. y: channels x frames."""
    v, u = np.linalg.eigh((r + _turned(r)) / 2)
    v = np.maximum(v, EPS * np.maximum(v[..., -1:], EPS))
    z = _turned(u) @ y
    return ((np.abs(z) ** 2) / v[..., None]).sum(axis=-2), np.log(v).sum(axis=-1)


def _turned(x: np.ndarray) -> np.ndarray:
    return np.swapaxes(x, -1, -2).conj()


@dataclass(frozen=True)
class Gaussian:
    """Complex Gaussians with a scale for each frame. Two classes start as the mean covariance and white noise."""

    def prepared(self, y: np.ndarray) -> np.ndarray:
        return y

    def start(self, y: np.ndarray, classes: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray | None]:
        """(matrices, posteriors or None) of one bin."""
        white = np.eye(len(y), dtype=complex)
        if classes == 2:
            return np.stack([np.einsum("it,jt->ij", y, y.conj()) / max(y.shape[1], 1), white]), None
        g = rng.random((classes, y.shape[1]))
        return np.stack([white] * classes), g / g.sum(axis=0)

    def log_density(self, y: np.ndarray, r: np.ndarray) -> np.ndarray:
        q, logdet = quadratic(y, r)
        many = y.shape[-2]
        scale = np.maximum(q / many, EPS)
        return -logdet[..., None] - (many * np.log(scale) + q / scale)

    def update(self, y: np.ndarray, gamma: np.ndarray, r: np.ndarray) -> np.ndarray:
        w = gamma * y.shape[-2] / np.maximum(quadratic(y, r)[0], EPS)
        return (y * w[..., None, :]) @ _turned(y) / np.maximum(gamma.sum(axis=-1), EPS)[..., None, None]


@dataclass(frozen=True)
class Angular(Gaussian):
    """Complex angular central Gaussians of observations of length one, from random posteriors."""

    def prepared(self, y: np.ndarray) -> np.ndarray:
        return y / np.maximum(np.sqrt((np.abs(y) ** 2).sum(axis=-2, keepdims=True)), EPS)

    def start(self, y, classes, rng):
        g = rng.random((classes, y.shape[1]))
        return np.stack([np.eye(len(y), dtype=complex)] * classes), g / g.sum(axis=0)

    def log_density(self, y: np.ndarray, r: np.ndarray) -> np.ndarray:
        q, logdet = quadratic(y, r)
        return -logdet[..., None] - y.shape[-2] * np.log(np.maximum(q, EPS))


FAMILIES: dict[str, object] = {"gaussian": Gaussian(), "angular": Angular()}


def family_of(family):
    return FAMILIES[family] if isinstance(family, str) else family


def posteriors(family, y: np.ndarray, alpha: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Classes x frames of prepared observations."""
    like = np.stack([np.log(alpha[..., k] + EPS)[..., None] + family.log_density(y, r[..., k, :, :]) for k in range(alpha.shape[-1])], axis=-2)
    g = np.exp(like - like.max(axis=-2, keepdims=True))
    return g / g.sum(axis=-2, keepdims=True)


def rounds_of(family, y: np.ndarray, alpha: np.ndarray, r: np.ndarray, gamma: np.ndarray | None, rounds: int, weights: bool) -> tuple[np.ndarray, np.ndarray]:
    """(alpha, matrices) after so many rounds. gamma: posteriors that the first round takes instead of the state's."""
    for k in range(rounds):
        g = posteriors(family, y, alpha, r) if gamma is None or k else gamma
        r = np.stack([family.update(y, g[..., c, :], r[..., c, :, :]) for c in range(r.shape[-3])], axis=-3)
        alpha = g.mean(axis=-1) if weights else alpha
    return alpha, r


def attempted(family, many: int, kernel) -> list[tuple | None]:
    """What kernel(at) gives for each of so many bins: a tuple of arrays, or None where it can't be solved. at: what picks bins from
    their stacks, all at once or, for families of a user's own and where one bin can't be solved, one by one."""
    if type(family) in (Gaussian, Angular):
        try:
            return list(zip(*kernel(slice(None)), strict=True))
        except np.linalg.LinAlgError:
            pass
    found: list[tuple | None] = []
    for k in range(many):
        try:
            found.append(kernel(k))
        except np.linalg.LinAlgError:
            found.append(None)
    return found


def started(family, y: np.ndarray, classes: int, rngs: Iterable[np.random.Generator]) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """(prepared observations, matrices, posteriors or None) of a stack of bins, each from its own random numbers."""
    y = family.prepared(y) if type(family) in (Gaussian, Angular) else np.stack([family.prepared(x) for x in y])
    r, gamma = zip(*(family.start(x, classes, g) for x, g in zip(y, rngs, strict=True)), strict=True)
    return y, np.stack(r), None if gamma[0] is None else np.stack(gamma)


# ---------------------------------------------------------------- tables

MODEL = "utt long, f long, rounds long, alpha array<double>, re array<double>, im array<double>"


def by_bin(rows: DataFrame, *order: str) -> DataFrame:
    """rows, dealt by (utt, f) and sorted by it and `order`: what `whole_bins` reads."""
    return rows.repartition("utt", "f").sortWithinPartitions("utt", "f", *order)


def _changes(rows: pa.Table | pa.RecordBatch) -> np.ndarray:
    """The rows that begin a bin, but for the first row."""
    new = np.zeros(max(rows.num_rows - 1, 0), dtype=bool)
    for c in ("utt", "f"):
        gone, v = np.asarray(rows[c].is_null()), np.asarray(rows[c].fill_null(0))
        new |= (v[1:] != v[:-1]) | (gone[1:] != gone[:-1])
    return np.flatnonzero(new) + 1


def whole_bins(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(rows, where each bin begins) of sorted batches: a batch's last bin waits for what the next one has of it, so that no more than
    a batch and a bin are held."""
    held: list[pa.RecordBatch] = []

    def table():
        rows = pa.Table.from_batches(held)
        return rows, np.append(0, _changes(rows))

    for b in batches:
        if not b.num_rows:
            continue
        new = _changes(b)
        cut = int(new[-1]) if len(new) else 0
        if cut:
            held.append(b.slice(0, cut))
        elif held and not len(_changes(pa.Table.from_batches([held[-1].slice(held[-1].num_rows - 1), b.slice(0, 1)]))):
            held.append(b)
            continue
        if held:
            yield table()
        held = [b.slice(cut)]
    if held:
        yield table()


def stacked(cells: pa.Table, of: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bins, channels x frames of each, frame numbers of each) of cells(ch, t, re, im) sorted by bin, channel and frame: a stack for all
    bins of one size that have every channel in every frame, and one for each of the others. of: the number of each cell's bin."""
    if not len(of):
        return
    ch, t = np.asarray(cells["ch"]), np.asarray(cells["t"])
    z = np.asarray(cells["re"]) + 1j * np.asarray(cells["im"])
    first = np.append(0, np.flatnonzero(of[1:] != of[:-1]) + 1)
    many = np.diff(np.append(first, len(of)))
    for size in np.unique(many).tolist():
        at = first[many == size][:, None] + np.arange(size)
        channels = 1 + (ch[at][:, 1:] != ch[at][:, :-1]).sum(axis=1)
        for side in np.unique(channels).tolist():
            rows = at[channels == side]
            if size % side == 0:
                c, f = ch[rows].reshape(len(rows), side, -1), t[rows].reshape(len(rows), side, -1)
                full = (c == c[:, :, :1]).all(axis=(1, 2)) & (f == f[:, :1]).all(axis=(1, 2)) & (f[:, 0, 1:] != f[:, 0, :-1]).all(axis=1)
                if full.any():
                    yield of[rows[full, 0]], z[rows[full]].reshape(-1, side, size // side), f[full, 0]
                rows = rows[~full]
            for one in rows:
                cs, ts = np.unique(ch[one]), np.unique(t[one])
                y = np.zeros((1, len(cs), len(ts)), dtype=complex)
                y[0, np.searchsorted(cs, ch[one]), np.searchsorted(ts, t[one])] = z[one]
                yield of[one[:1]], y, ts[None]


def masks_table(keys: list[tuple], classes: int, ts: np.ndarray, m: np.ndarray) -> pa.Table:
    """(utt, f, k, t, m) of bins x classes x frames."""
    n, frames = ts.shape
    of = pa.array(np.repeat(np.arange(n), classes * frames))
    column = lambda c: pa.array([k[c] for k in keys], pa.int64()).take(of)
    k, t = np.tile(np.repeat(np.arange(classes), frames), n), np.repeat(ts[:, None], classes, axis=1).ravel()
    return pa.table({"utt": column(0), "f": column(1), "k": pa.array(k, pa.int64()), "t": pa.array(t, pa.int64()), "m": pa.array(m.ravel(), pa.float64())})


def _state(row: dict) -> tuple[np.ndarray, np.ndarray]:
    alpha = np.array(row["alpha"])
    r = np.array(row["re"]) + 1j * np.array(row["im"])
    side = int(round(np.sqrt(len(r) / len(alpha))))
    return alpha, r.reshape(len(alpha), side, side)


def _states(model: DataFrame) -> DataFrame:
    """The model's rows as rows beside the cells of their bins."""
    return model.select("utt", "f", F.lit(0).alias("kind"), "rounds", "alpha", F.col("re").alias("sre"), F.col("im").alias("sim"))


def _numbered(rows: pa.Table, first: np.ndarray) -> tuple[np.ndarray, list[tuple], np.ndarray]:
    """(the number of each row's bin, the bins' keys, the kind of each row)."""
    of = np.repeat(np.arange(len(first)), np.diff(np.append(first, rows.num_rows)))
    keys = list(zip(*(rows[c].take(pa.array(first)).to_pylist() for c in ("utt", "f")), strict=True))
    return of, keys, np.asarray(rows["kind"])


def _had(rows: pa.Table, of: np.ndarray, which: np.ndarray) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """(rounds, alpha, matrices) of the bins that have a state."""
    at = np.flatnonzero(which == 0)
    if not len(at):
        return {}
    known = rows.select(["rounds", "alpha", "sre", "sim"]).take(pa.array(at)).to_pylist()
    out: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}
    for k, x in zip(of[at].tolist(), known, strict=True):
        if x["alpha"] is not None and k not in out:
            out[k] = (x["rounds"], *_state({"alpha": x["alpha"], "re": x["sre"], "im": x["sim"]}))
    return out


def _models(rows: list[tuple]) -> pa.Table:
    utt, f, rounds, alpha, r = zip(*rows, strict=True) if rows else ((),) * 5
    many = pa.list_(pa.float64())
    return pa.table({"utt": pa.array(utt, pa.int64()), "f": pa.array(f, pa.int64()), "rounds": pa.array(rounds, pa.int64()), "alpha": pa.array(list(alpha), many), "re": pa.array([x.real.ravel() for x in r], many), "im": pa.array([x.imag.ravel() for x in r], many)})


def fitted(spec: DataFrame, family="gaussian", classes: int = 2, rounds: int = 20, model: DataFrame | None = None, masks: DataFrame | None = None, weights: bool = False, seed: int = 777) -> DataFrame:
    """The model of spec(utt, ch, t, f, re, im) after `rounds` rounds in all. model: what a former run stored. masks(utt, k, t, f, m):
    posteriors that bins without a state start from."""
    kind = family_of(family)
    done = None
    if model is not None:
        done = model.where(F.col("rounds") >= rounds)
        spec = spec.join(done.select("utt", "f"), ["utt", "f"], "left_anti")
    cells = spec.select("utt", "f", F.lit(2).alias("kind"), "ch", F.col("t").cast("long").alias("t"), "re", "im")
    if model is not None:
        cells = cells.unionByName(_states(model.where(F.col("rounds") < rounds)), allowMissingColumns=True)
    if masks is not None:
        given = masks.select("utt", "f", F.lit(1).alias("kind"), F.col("t").cast("long").alias("t"), F.col("k").cast("long").alias("k"), F.col("m").cast("double").alias("m"))
        cells = cells.unionByName(given.where("m IS NOT NULL"), allowMissingColumns=True)

    def posteriors_given(rows: pa.Table, ts: np.ndarray) -> np.ndarray:
        gamma = np.zeros((classes, len(ts)))
        for x in rows.select(["t", "k", "m"]).to_pylist():
            if x["t"] in ts:
                gamma[x["k"], np.searchsorted(ts, x["t"])] = x["m"]
        return gamma / np.maximum(gamma.sum(axis=0), EPS)

    def run(batches):
        for rows, first in whole_bins(batches):
            of, keys, which = _numbered(rows, first)
            had = _had(rows, of, which)
            at, starts = np.flatnonzero(which == 1), {}
            if len(at):
                starts = {int(k): rows.take(pa.array(at[of[at] == k])) for k in np.unique(of[at])}
            cell = np.flatnonzero(which == 2)
            done_here, seen = [], set()
            for bins, y, ts in stacked(rows.take(pa.array(cell)), of[cell]):
                seen.update(bins.tolist())
                # bins go on together that have had as many rounds, and begin in the same way
                before = np.array([had[k][0] if k in had else -2 if k in starts else -1 for k in bins.tolist()])
                for b in np.unique(before).tolist():
                    mine = np.flatnonzero(before == b)
                    names = bins[mine].tolist()
                    rngs = (np.random.default_rng(zlib.crc32(repr((seed, *keys[k])).encode())) for k in names)
                    x, r, gamma = started(kind, y[mine], classes, rngs)
                    alpha = np.full((len(mine), classes), 1.0 / classes)
                    if b >= 0:
                        alpha, r, gamma = np.stack([had[k][1] for k in names]), np.stack([had[k][2] for k in names]), None
                    elif b == -2:
                        gamma = np.stack([posteriors_given(starts[k], ts[j]) for k, j in zip(names, mine, strict=True)])
                    kernel = lambda at, x=x, alpha=alpha, r=r, gamma=gamma, b=b: rounds_of(kind, x[at], alpha[at], r[at], None if gamma is None else gamma[at], rounds - max(b, 0), weights)
                    for k, found in zip(names, attempted(kind, len(names), kernel), strict=True):
                        if found is not None:
                            done_here.append((*keys[k], rounds, *found))
                        elif k in had:
                            done_here.append((*keys[k], *had[k]))
            done_here += [(*keys[k], *had[k]) for k in had if k not in seen]
            yield from _models(done_here).to_batches()

    new = by_bin(cells, "kind", "ch", "t").mapInArrow(run, MODEL)
    return new if done is None else new.unionByName(done.select("utt", "f", "rounds", "alpha", "re", "im"))


def masks_of(spec: DataFrame, model: DataFrame, family="gaussian") -> DataFrame:
    """(utt, f, k, t, m): posteriors of spec's frames under a model; bins without a model give none."""
    kind = family_of(family)
    cells = spec.select("utt", "f", F.lit(2).alias("kind"), "ch", F.col("t").cast("long").alias("t"), "re", "im").unionByName(_states(model), allowMissingColumns=True)

    def run(batches):
        for rows, first in whole_bins(batches):
            of, keys, which = _numbered(rows, first)
            had = _had(rows, of, which)
            cell = np.flatnonzero(which == 2)
            for bins, y, ts in stacked(rows.take(pa.array(cell)), of[cell]):
                sizes = np.array([had[k][2].shape if k in had else (0, 0, 0) for k in bins.tolist()])
                for size in np.unique(sizes[:, 0]).tolist():
                    mine = np.flatnonzero(sizes[:, 0] == size)
                    if size:
                        names = bins[mine].tolist()
                        alpha, r = (np.stack([had[k][c] for k in names]) for c in (1, 2))
                        if type(kind) in (Gaussian, Angular):
                            m = posteriors(kind, kind.prepared(y[mine]), alpha, r)
                        else:
                            m = np.stack([posteriors(kind, kind.prepared(y[j]), a, x) for j, a, x in zip(mine, alpha, r, strict=True)])
                        yield from masks_table([keys[k] for k in names], size, ts[mine], m).to_batches()

    return by_bin(cells, "kind", "ch", "t").mapInArrow(run, "utt long, f long, k long, t long, m double")
