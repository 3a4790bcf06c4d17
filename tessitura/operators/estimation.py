"""Iterative estimators: mixture-model masks, dereverberation, blind separation and noise suppression.

Each is a small numpy kernel over one group of Spark's: one bin of an utterance where bins are independent (mixtures, WPE,
WPD), one utterance where they aren't (AuxIVA, permutation alignment, noise suppression). Random starts are seeded by the
group's key, so results don't depend on partitioning. A group that can't be solved gives one row of its key and nulls."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import families
from .assignment import assigned
from .linalg import covariance, principal, same_sizes

EPS = 1.1920929e-07


def _solid(spec: DataFrame, keys: list[str], kernel, out: str) -> DataFrame:
    """kernel(key, x channels x frames x bins, t values, f values) -> columns of `out`, for each group of keys."""
    names = [c.split()[0] for c in out.split(", ")]
    kinds_out = [{"long": pa.int64(), "double": pa.float64()}[c.split()[1]] for c in out.split(", ")][len(keys) :]

    def run(key, group):
        ch, t, f = (np.asarray(group.column(c)) for c in ("ch", "t", "f"))
        cs, ts, fs = np.unique(ch), np.unique(t), np.unique(f)
        x = np.zeros((len(cs), len(ts), len(fs)), dtype=complex)
        x[np.searchsorted(cs, ch), np.searchsorted(ts, t), np.searchsorted(fs, f)] = np.asarray(group.column("re")) + 1j * np.asarray(group.column("im"))
        plain = tuple(k.as_py() for k in key)
        try:
            columns = kernel(plain, x, ts, fs)
        except np.linalg.LinAlgError:
            columns = [[None]] * len(names[len(keys) :])
        n = len(columns[0])
        kinds = [group.schema.field(k).type for k in keys]
        return pa.table([*(pa.array([v] * n, t) for v, t in zip(plain, kinds, strict=True)), *(pa.array(c if isinstance(c, list) else np.asarray(c), k) for c, k in zip(columns, kinds_out, strict=True))], names=names)

    return spec.select(*dict.fromkeys([*keys, "ch", "t", "f", "re", "im"])).groupBy(*keys).applyInArrow(run, out)


def _long(t: np.ndarray, f: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Columns t, f and values of frames x bins."""
    tt, ff = np.meshgrid(t, f, indexing="ij")
    return [tt.ravel(), ff.ravel(), *(v.ravel() for v in values)]


def _seed(key: tuple, seed: int = 777) -> np.random.Generator:
    return np.random.default_rng(zlib.crc32(repr((seed, *key)).encode()))


def mixture(y: np.ndarray, classes: int, rounds: int, rng: np.random.Generator, angular: bool = False, start: np.ndarray | None = None, weights: bool = False) -> np.ndarray:
    """Posteriors classes x frames of a complex Gaussian mixture with time-varying scales, or of a complex angular central
    Gaussian mixture of normalised observations. y: channels x frames."""
    kind = families.FAMILIES["angular" if angular else "gaussian"]
    y = kind.prepared(y)
    r, gamma = kind.start(y, classes, rng)
    if start is not None:
        r, gamma = np.stack([np.eye(len(y), dtype=complex)] * classes), start
    alpha = np.full(classes, 1.0 / classes)
    if not rounds and gamma is not None:
        return gamma
    alpha, r = families.rounds_of(kind, y, alpha, r, gamma, rounds, weights)
    return families.posteriors(kind, y, alpha, r)


def mixture_masks(spec: DataFrame, classes: int = 2, rounds: int = 20, angular: bool = False, update_alpha: bool = False, seed: int = 777) -> DataFrame:
    """(utt, f, k, t, m): posteriors of each bin on its own. A task solves the whole bins of an Arrow batch as stacks."""
    kind = families.FAMILIES["angular" if angular else "gaussian"]

    def run(batches):
        for rows, first in families.whole_bins(batches):
            of = np.repeat(np.arange(len(first)), np.diff(np.append(first, rows.num_rows)))
            keys = list(zip(*(rows[c].take(pa.array(first)).to_pylist() for c in ("utt", "f")), strict=True))
            for bins, y, ts in families.stacked(rows, of):
                names = [keys[k] for k in bins.tolist()]
                y, r, gamma = families.started(kind, y, classes, (_seed(k, seed) for k in names))

                def kernel(at, y=y, r=r, gamma=gamma):
                    if not rounds and gamma is not None:
                        return (gamma[at],)
                    start = None if gamma is None else gamma[at]
                    alpha = np.full((*y[at].shape[:-2], classes), 1.0 / classes)
                    return (families.posteriors(kind, y[at], *families.rounds_of(kind, y[at], alpha, r[at], start, rounds, update_alpha)),)

                found = families.attempted(kind, len(names), kernel)
                good = [k for k, x in enumerate(found) if x is not None]
                if good:
                    yield from families.masks_table([names[k] for k in good], classes, ts[good], np.stack([found[k][0] for k in good])).to_batches()
                bad = [n for n, x in zip(names, found, strict=True) if x is None]
                if bad:
                    none = {c: pa.nulls(len(bad), pa.float64() if c == "m" else pa.int64()) for c in ("k", "t", "m")}
                    yield pa.RecordBatch.from_pydict({"utt": pa.array([n[0] for n in bad], pa.int64()), "f": pa.array([n[1] for n in bad], pa.int64()), **none})

    cells = spec.select("utt", "f", "ch", F.col("t").cast("long").alias("t"), "re", "im")
    return families.by_bin(cells, "ch", "t").mapInArrow(run, "utt long, f long, k long, t long, m double")


def aligned(masks: DataFrame, rounds: int = 10) -> DataFrame:
    """(utt, k, t, f, m): classes of all bins put in one order. Each bin takes the permutation whose masks correlate best with
    the mean over the other bins, found as an assignment, until none changes."""

    def run(key, group):
        k, t, f = (np.asarray(group.column(c)) for c in ("k", "t", "f"))
        ks, ts, fs = np.unique(k), np.unique(t), np.unique(f)
        m = np.zeros((len(fs), len(ks), len(ts)))
        m[np.searchsorted(fs, f), np.searchsorted(ks, k), np.searchsorted(ts, t)] = np.asarray(group.column("m"))
        unit = lambda z: z / np.maximum(np.sqrt((z * z).sum(axis=-1, keepdims=True)), EPS)
        for _ in range(rounds):
            moved = False
            for b in range(len(fs)):
                centre = unit(np.delete(m, b, axis=0).mean(axis=0)) if len(fs) > 1 else unit(m[b])
                score = unit(m[b]) @ centre.T
                best = assigned(-score.T[None])[0]
                if (best != np.arange(len(ks))).any():
                    m[b] = m[b][best]
                    moved = True
            if not moved:
                break
        kk, tt, ff = np.meshgrid(ks, ts, fs, indexing="ij")
        return pa.table([pa.array([key[0].as_py()] * m.size, pa.int64()), pa.array(kk.ravel()), pa.array(tt.ravel()), pa.array(ff.ravel()), pa.array(m.transpose(1, 2, 0).ravel())], names=["utt", "k", "t", "f", "m"])

    return masks.groupBy("utt").applyInArrow(run, "utt long, k long, t long, f long, m double")


def _power(y: np.ndarray, context: int) -> np.ndarray:
    """Mean power over channels, averaged over neighbouring frames. y: channels x frames."""
    p = (np.abs(y) ** 2).mean(axis=0)
    total = np.convolve(p, np.ones(2 * context + 1), "full")[context : context + len(p)]
    return np.maximum(total / np.convolve(np.ones(len(p)), np.ones(2 * context + 1), "full")[context : context + len(p)], EPS)


def _past(y: np.ndarray, taps: int, delay: int) -> np.ndarray:
    """Channels * taps x frames: y as it was delay, delay + 1, ... frames ago."""
    m, t = y.shape
    out = np.zeros((taps, m, t), dtype=complex)
    for k in range(taps):
        d = delay + k
        if d < t:
            out[k, :, d:] = y[:, : t - d]
    return out.reshape(taps * m, t)


def dereverberated(y: np.ndarray, taps: int, delay: int, context: int, rounds: int, power: np.ndarray | None = None) -> np.ndarray:
    """Weighted prediction error of one bin. y: channels x frames; short signals stay as they are."""
    if y.shape[1] <= taps + delay:
        return y
    past, out = _past(y, taps, delay), y
    for _ in range(rounds):
        w = 1 / (_power(out, context) if power is None else power)
        r = (past * w) @ past.conj().T
        g = np.linalg.solve(r + EPS * max(np.trace(r).real, EPS) * np.eye(len(r)), (past * w) @ y.conj().T)
        out = y - g.conj().T @ past
    return out


def wpe(spec: DataFrame, taps: int = 10, delay: int = 3, context: int = 1, rounds: int = 3) -> DataFrame:
    """(utt, f, ch, t, re, im) without late reverberation."""

    def kernel(key, x, t, f):
        y = dereverberated(x[:, :, 0], taps, delay, context, rounds)
        c, tt = np.meshgrid(np.arange(len(y)), t, indexing="ij")
        return [c.ravel(), tt.ravel(), y.real.ravel(), y.imag.ravel()]

    return _solid(spec, ["utt", "f"], kernel, "utt long, f long, ch long, t long, re double, im double")


def wpd(spec: DataFrame, taps: int = 10, delay: int = 3, context: int = 1, rounds: int = 3, mask_rounds: int = 20) -> DataFrame:
    """(utt, f, t, re, im, m): dereverberation, mixture mask and distortionless beamformer in turn, for each bin."""

    def kernel(key, x, t, f):
        y, rng, power, out, g = x[:, :, 0], _seed(key), None, None, None
        for _ in range(rounds):
            d = dereverberated(y, taps, delay, context, 1, power)
            g = mixture(d, 2, mask_rounds, rng)[0]
            rs = (d * g) @ d.conj().T / max(g.sum(), 1e-6)
            rn = (d * (1 - g)) @ d.conj().T / max((1 - g).sum(), 1e-6)
            v = principal(rs[None])[0]
            top = np.linalg.solve(rn + EPS * max(np.trace(rn).real, EPS) * np.eye(len(rn)), v)
            w = top / (v.conj() @ top)
            out = w.conj() @ d
            power = np.maximum(np.abs(out) ** 2, EPS)
        return [t, out.real, out.imag, g]

    return _solid(spec, ["utt", "f"], kernel, "utt long, f long, t long, re double, im double, m double")


def auxiva(spec: DataFrame, rounds: int = 20) -> DataFrame:
    """(utt, src, t, f, re, im): independent vector analysis by auxiliary functions; as many sources as channels."""

    def kernel(key, x, t, f):
        x = x.transpose(2, 0, 1)
        b, n, frames = x.shape
        w = np.stack([np.eye(n, dtype=complex)] * b)
        for _ in range(rounds):
            for s in range(n):
                y = w @ x
                weight = 1 / np.maximum(np.sqrt((np.abs(y[:, s]) ** 2).sum(axis=0)), EPS)
                v = np.einsum("t,bit,bjt->bij", weight, x, x.conj()) / frames
                v = v + EPS * np.trace(v, axis1=1, axis2=2).real[:, None, None] * np.eye(n)
                u = np.linalg.solve(w @ v, np.broadcast_to(np.eye(n)[:, s : s + 1], (b, n, 1)))[:, :, 0]
                u = u / np.sqrt(np.maximum(np.einsum("bi,bij,bj->b", u.conj(), v, u).real, EPS))[:, None]
                w[:, s] = u.conj()
        back = np.linalg.inv(w)  # scale of the first channel
        y = (w @ x) * back[:, 0, :, None]
        ss, tt, ff = np.meshgrid(np.arange(n), t, f, indexing="ij")
        z = y.transpose(1, 2, 0)
        return [ss.ravel(), tt.ravel(), ff.ravel(), z.real.ravel(), z.imag.ravel()]

    return _solid(spec, ["utt"], kernel, "utt long, src long, t long, f long, re double, im double")


def exponential_integral(v: np.ndarray) -> np.ndarray:
    """E1(v): its series up to 1, beyond it a continued fraction."""
    v = np.maximum(np.asarray(v, dtype=np.float64), 1e-10)
    small = np.minimum(v, 1.0)
    term, total = np.ones_like(v), -np.euler_gamma - np.log(small)
    for k in range(1, 25):
        term = term * -small / k
        total = total - term / k
    large = np.maximum(v, 1.0)
    tail = np.zeros_like(v)
    for k in range(60, 0, -1):
        tail = k / (1 + k / (large + tail))
    return np.where(v <= 1, total, np.exp(-large) / (large + tail))


def _across(p: np.ndarray, half: int) -> np.ndarray:
    """p summed over neighbouring bins with a periodic Hann window of 2 * half + 1 values; as many values as p has."""
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(2 * half + 1) / (2 * half + 1))
    return np.convolve(p, w, "full")[half : half + len(p)]


class Minimum:
    """The least value of each bin over a search window, renewed every `span` frames: the least of the last `keep` windows."""

    def __init__(self, start: np.ndarray, span: int, keep: int, offset: int = 0):
        self.low, self.window, self.past = start.copy(), start.copy(), []
        self.span, self.keep, self.offset = span, keep, offset

    def seen(self, x: np.ndarray) -> None:
        self.low, self.window = np.minimum(self.low, x), np.minimum(self.window, x)

    def renewed(self, t: int, x: np.ndarray) -> None:
        self.past = [*self.past, self.window][-self.keep * self.span :]
        if (t + 1) % self.span == self.offset:
            self.low = np.minimum.reduce(self.past[-self.keep :])
            self.window = x.copy()


class McraPresence:
    """Speech presence by minima-controlled recursive averaging, with the optimally modified estimator's absence from local,
    global and frame evidence. The defaults are the published constants (fixed values)."""

    bias, floor, span, begin = 1.0, 10 ** (-10 / 10), 125, 10
    level, delta, inertia, recall, widest = 0.9, 5.0, 0.2, 0.7, 0.95
    weak, strong, least_peak, most_peak, upto = 10 ** (-10 / 10), 10 ** (-5 / 10), 10 ** (0 / 10), 10 ** (10 / 10), 65

    def __init__(self, first: np.ndarray):
        self.t, self.s, self.low, self.kept = 0, first, first, first
        self.sure, self.zeta, self.before, self.peak = np.ones_like(first), np.ones_like(first), None, 0.0

    def _share(self, z):
        return np.clip(np.log(np.maximum(z, 1e-300) / self.weak) / math.log(self.strong / self.weak), 0.0, 1.0)

    def _frame(self, mean: float) -> float:
        rising, self.before = self.before is not None and mean > self.before, mean
        if mean <= self.weak:
            return 0.0
        if rising:
            self.peak = min(max(mean, self.least_peak), self.most_peak)
            return 1.0
        return float(self._share(mean / self.peak)) if self.peak > 0 else 1.0

    def of(self, p: np.ndarray, xi: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Presence for the noise level and for the gain."""
        if self.t:
            self.s = self.level * self.s + (1 - self.level) * _across(p, 1)
        if (self.t + 1) % self.span == self.begin:
            self.low, self.kept = np.minimum(self.kept, self.s), self.s
        else:
            self.low, self.kept = np.minimum(self.low, self.s), np.minimum(self.kept, self.s)
        self.t += 1
        self.sure = self.inertia * self.sure + (1 - self.inertia) * (self.s > self.delta * np.maximum(self.low, 1e-7))
        self.zeta = self.recall * self.zeta + (1 - self.recall) * xi
        frame = self._frame(float(self.zeta[: self.upto].mean()))
        absent = np.minimum(self.widest, 1 - self._share(_across(self.zeta, 1)) * frame * self._share(_across(self.zeta, 15)))
        return self.sure, 1 / (1 + absent / (1 - absent) * (1 + xi) * np.exp(-v))


class ImprovedPresence:
    """Speech presence by the improved form: minima of the smoothed power, and again of what is left without strong speech.
    The defaults are the published constants (fixed values)."""

    bias, floor, span, windows = 1.47, 10 ** (-10 / 10), 15, 8
    level, least_bias, strong, medium, near = 0.9, 1.66, 4.6, 3.0, 1.67

    def __init__(self, first: np.ndarray):
        local = _across(first, 1)
        self.t, self.s, self.quiet = 0, local, local
        self.all, self.rest = Minimum(local, self.span, self.windows), Minimum(local, self.span, self.windows)

    def of(self, p: np.ndarray, xi: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        local = _across(p, 1)
        if self.t:
            self.s = self.level * self.s + (1 - self.level) * local
            self.all.seen(self.s)
        low = self.least_bias * np.maximum(self.all.low, 1e-7)
        calm = ((p < self.strong * low) & (local < self.near * low)).astype(float)
        weight = _across(calm, 1)
        between = np.where(weight > 0, _across(p * calm, 1) / np.where(weight > 0, weight, 1.0), self.quiet)
        if self.t:
            self.quiet = self.level * self.quiet + (1 - self.level) * between
            self.rest.seen(self.quiet)
        low = self.least_bias * np.maximum(self.rest.low, 1e-7)
        ratio, steady = p / low, self.s < self.near * low
        absent = np.clip((self.medium - ratio) / (self.medium - 1), 0.0, 1.0)
        some = (ratio > 1) & (ratio < self.medium) & steady
        odds = np.where(some, absent / np.where(some, 1 - absent, 1.0), 0.0)
        present = np.where(some, 1 / (1 + odds * (1 + xi) * np.exp(-v)), ((ratio >= self.medium) & ~steady).astype(float))
        self.all.renewed(self.t, self.s)
        self.rest.renewed(self.t, self.quiet)
        self.t += 1
        return present, present


def suppressed(frames: np.ndarray, improved: bool = True, recall: float = 0.92, slow: float = 0.85, least_db: float = -18.0) -> np.ndarray:
    """Gains of power spectra, frames x bins: the log spectral amplitude gain to the power of speech presence, the floor to that
    of absence. One pass; the state is a few vectors whatever the length."""
    if not len(frames):
        return frames
    kind = ImprovedPresence if improved else McraPresence
    model, noise, last, least, out = kind(frames[0]), frames[0], 1.0, 10 ** (least_db / 10), []
    for p in frames:
        post = np.maximum(p / np.maximum(noise * model.bias, 1e-7), 1e-7)
        xi = np.maximum(recall * last**2 * post + (1 - recall) * np.maximum(post - 1, 0), least)
        v = post * xi / (1 + xi)
        last = xi / (1 + xi) * np.exp(0.5 * exponential_integral(v))
        for_noise, for_gain = model.of(p, xi, v)
        rate = slow + (1 - slow) * for_noise
        noise = rate * noise + (1 - rate) * p
        out.append(last**for_gain * model.floor ** (1 - for_gain))
    return np.stack(out)


def noise_gain(spec: DataFrame, improved: bool = True, **options) -> DataFrame:
    """(utt, t, f, m): gains of a single-channel spectrum, to be used as a mask."""

    def kernel(key, x, t, f):
        return _long(t, f, suppressed(np.abs(x[0]) ** 2, improved, **options))

    return _solid(spec, ["utt"], kernel, "utt long, t long, f long, m double")


def forgetting(c: DataFrame, values: tuple[str, ...], alpha: float, later: float | None = None) -> DataFrame:
    """(utt, chunk, f, i, j, values): elements of covariances (utt, blk, f, i, j, values) that forget from block to block, see
    online_covariances. The recursion runs along arrays of blocks, for all elements of an Arrow batch at once."""
    share = 1.0 - alpha if later is None else later

    @F.arrow_udf(f"array<struct<chunk:{c.schema['blk'].dataType.simpleString()},{','.join(f'{v}:double' for v in values)}>>")
    def run(z: pa.Array) -> pa.Array:
        flat, many = z.flatten(), z.value_lengths().to_numpy(zero_copy_only=False)
        bounds = np.append(0, np.cumsum(many))
        x = np.stack([flat.field(v).to_numpy(zero_copy_only=False) for v in values], axis=1)
        for rows in same_sizes([z]):
            at_ = bounds[rows]
            s = x[at_]
            for k in range(1, int(many[rows[0]])):
                now = x[at_ + k]
                # what isn't a number leaves the state as it is
                s = np.where(np.isnan(now), s, np.where(np.isnan(s), share / (1 - alpha) * now, alpha * s + share * now))
                x[at_ + k] = s
        parts = [flat.field("blk"), *(pa.array(np.ascontiguousarray(x[:, k])) for k in range(len(values)))]
        return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays(parts, ["chunk", *values]))

    chunks = c.groupBy("utt", "f", "i", "j").agg(F.array_sort(F.collect_list(F.struct("blk", *values))).alias("z"))
    return chunks.select("utt", "f", "i", "j", F.inline(run("z"))).select("utt", "chunk", "f", "i", "j", *values)


def online_covariances(spec: DataFrame, mask: DataFrame, chunk: int, alpha: float = 0.8, later: float | None = None) -> DataFrame:
    """(utt, chunk, f, i, j, re, im) that forget: R = alpha R + later * R_chunk from the second chunk on, and the first as it is.
    later: 1 - alpha by default. Chunks are summed by Spark."""
    return forgetting(covariance(spec, mask, block=F.floor(F.col("t") / chunk)), ("re", "im"), alpha, later)
