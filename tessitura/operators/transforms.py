"""Time-frequency transforms. wave(utt, ch, x array) in, frames out; no shuffle, as a wave is one row."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.signal import EPSILON, at, floored_log, polar
from .windows import impulse_answer


@dataclass(frozen=True)
class StftConfig:
    """Geometry of a short-time Fourier transform. center pads half a frame on both sides, by reflection or zeros."""

    frame_len: int = 512
    frame_hop: int = 256
    center: bool = True
    power_of_two: bool = True
    window: str = "hann"
    periodic: bool = True
    pad: str = "reflect"

    @property
    def n_fft(self) -> int:
        return 1 << (self.frame_len - 1).bit_length() if self.power_of_two else self.frame_len

    @property
    def bins(self) -> int:
        return self.n_fft // 2 + 1

    def frames(self, n: int) -> int:
        return (n + 2 * (self.n_fft // 2) * self.center - self.frame_len) // self.frame_hop + 1

    def samples(self, t: int) -> int:
        return (t - 1) * self.frame_hop + self.frame_len

    def weights(self) -> np.ndarray:
        turn = 2 * np.pi * np.arange(self.frame_len) / (self.frame_len if self.periodic else self.frame_len - 1)
        hann = 0.5 - 0.5 * np.cos(turn)
        return {"hann": hann, "sqrthann": np.sqrt(hann), "hamming": 0.54 - 0.46 * np.cos(turn), "blackman": 0.42 - 0.5 * np.cos(turn) + 0.08 * np.cos(2 * turn), "rectangular": np.ones(self.frame_len)}[self.window]


def analysed(x: np.ndarray, c: StftConfig) -> np.ndarray:
    """Frames x bins; short signals are padded to one frame."""
    if c.center:
        side = c.n_fft // 2
        x = np.pad(x, side, mode="reflect" if c.pad == "reflect" and len(x) > side else "constant")
    if len(x) < c.frame_len:
        x = np.pad(x, (0, c.frame_len - len(x)))
    return np.fft.rfft(np.lib.stride_tricks.sliding_window_view(x, c.frame_len)[:: c.frame_hop] * c.weights(), c.n_fft, axis=1)


def synthesised(y: np.ndarray, c: StftConfig, n: int | None = None) -> np.ndarray:
    """Overlap-add with the analysis window, divided by the sum of its squares."""
    w = c.weights()
    frames = np.fft.irfft(y, c.n_fft, axis=1)[:, : c.frame_len] * w
    x, d = np.zeros(c.samples(len(y))), np.zeros(c.samples(len(y)))
    for t in range(len(y)):
        x[t * c.frame_hop : t * c.frame_hop + c.frame_len] += frames[t]
        d[t * c.frame_hop : t * c.frame_hop + c.frame_len] += w * w
    x = np.where(d > 1e-10, x / np.where(d > 1e-10, d, 1), 0)
    if c.center:
        x = x[c.n_fft // 2 :]
        x = x if n is not None else x[: max(0, len(x) - c.n_fft // 2)]
    return x if n is None else np.pad(x[:n], (0, max(0, n - len(x[:n]))))


def stft_frames(wave: DataFrame, config: StftConfig, value: str = "x") -> DataFrame:
    """wave's other columns with t, re array and im array: one row for each frame."""
    keys = [f for f in wave.schema if f.name != value]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keys) + ", t long, re array<double>, im array<double>"

    def run(batches):
        for b in batches:
            rows, t, y = [], [], []
            for i, x in enumerate(b.column(b.num_columns - 1)):
                s = analysed(np.asarray(x.values, dtype=np.float64), config) if x.is_valid and len(x.values) else np.zeros((0, config.bins))
                rows += [i] * len(s)
                t += range(len(s))
                y.append(s)
            y = np.concatenate(y) if y else np.zeros((0, config.bins))
            bounds = pa.array(np.arange(len(y) + 1) * config.bins, pa.int32())
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(pa.array(rows, pa.int64())) for k in range(b.num_columns - 1)), pa.array(t, pa.int64()), pa.ListArray.from_arrays(bounds, pa.array(y.real.ravel())), pa.ListArray.from_arrays(bounds, pa.array(y.imag.ravel()))], [*(f.name for f in keys), "t", "re", "im"])

    return wave.select(*(f.name for f in keys), value).mapInArrow(run, schema)


def stft(wave: DataFrame, config: StftConfig, value: str = "x") -> DataFrame:
    """Long form: wave's other columns, t, f, re, im."""
    rest = [c for c in wave.columns if c != value]
    long = stft_frames(wave, config, value).select(*rest, "t", F.posexplode(F.arrays_zip("re", "im")).alias("f", "z"))
    return long.select(*rest, "t", F.col("f").cast("long").alias("f"), "z.re", "z.im")


def istft(spec: DataFrame, config: StftConfig, keys: list[str], keep: DataFrame | None = None, peak: str | None = None) -> DataFrame:
    """(keys, x array) from long-form spec. keep(keys, n): exact lengths. peak: column of spec whose value becomes the largest
    magnitude of the result. A wave is gathered in one task, as it is one row of the result."""
    frame = spec.groupBy(*keys, "t").agg(F.array_sort(F.collect_list(F.struct("f", "re", "im"))).alias("z"), *([F.first(peak).alias("peak")] if peak else []))
    whole = frame.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("t", "z"))).alias("y"), *([F.first("peak").alias("peak")] if peak else []))
    whole = whole.join(keep, keys) if keep is not None else whole.withColumn("n", F.lit(None).cast("long"))
    flat = whole.select(*keys, "n", *(["peak"] if peak else []), F.size("y").alias("frames"), F.flatten(F.transform("y", lambda t: F.transform(t["z"], lambda z: z["re"]))).alias("re"), F.flatten(F.transform("y", lambda t: F.transform(t["z"], lambda z: z["im"]))).alias("im"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spec.schema if f.name in keys)
    names = flat.columns

    def run(batches):
        for b in batches:
            col = dict(zip(names, b.columns, strict=True))
            out = []
            for i in range(b.num_rows):
                y = (np.asarray(col["re"][i].values) + 1j * np.asarray(col["im"][i].values)).reshape(col["frames"][i].as_py(), -1)
                x = synthesised(y, config, col["n"][i].as_py())
                if peak and (top := np.abs(x).max(initial=0)) > 0:
                    x = x * (col["peak"][i].as_py() / (top + EPSILON))
                out.append(x.tolist())
            yield pa.RecordBatch.from_arrays([*(col[k] for k in keys), pa.array(out, pa.list_(pa.float64()))], [*keys, "x"])

    return flat.mapInArrow(run, f"{fields}, x array<double>")


def spectrogram(spec: DataFrame, power: bool = False, log: bool = False) -> DataFrame:
    """spec with m: magnitude or power, floored log of it if asked."""
    z = at()
    m = z.power() if power else z.abs()
    return spec.withColumn("m", floored_log(m) if log else m).drop("re", "im")


def mel_weights(bands: int, config: StftConfig, sr: int, low: float = 0.0, high: float | None = None) -> list[tuple[int, int, float]]:
    """(b, f, w) of triangular filters that are evenly spaced on the mel scale 2595 log10(1 + hz / 700)."""
    mel = lambda hz: 2595 * np.log10(1 + hz / 700)
    edge = 700 * (10 ** (np.linspace(mel(low), mel(high or sr / 2), bands + 2) / 2595) - 1)
    hz = np.arange(config.bins) * sr / config.n_fft
    out = []
    for b in range(bands):
        up, down = (hz - edge[b]) / (edge[b + 1] - edge[b]), (edge[b + 2] - hz) / (edge[b + 2] - edge[b + 1])
        w = np.maximum(0, np.minimum(up, down))
        out += [(b, int(f), float(w[f])) for f in np.flatnonzero(w)]
    return out


def fbank(magnitude: DataFrame, weights: DataFrame, keys: list[str], log: bool = False) -> DataFrame:
    """(keys, t, b, m). weights(b, f, w): bands x bins rows, a constant of the geometry, so broadcast."""
    m = magnitude.join(F.broadcast(weights), "f").groupBy(*keys, "t", "b").agg(F.sum(F.col("w") * F.col("m")).alias("m"))
    return m.withColumn("m", floored_log(F.col("m"))) if log else m


def with_phase(magnitude: DataFrame, reference: DataFrame, keys: list[str], value: str = "m") -> DataFrame:
    """Spectra of this magnitude with the reference's phase."""
    z = polar(F.col(value), at("r_").angle())
    return magnitude.join(reference.select(*keys, "t", "f", F.col("re").alias("r_re"), F.col("im").alias("r_im")), [*keys, "t", "f"]).select(*keys, "t", "f", z.re.alias("re"), z.im.alias("im"))


def griffin_lim(magnitude: DataFrame, config: StftConfig, keys: list[str], rounds: int = 30) -> DataFrame:
    """(keys, x) whose magnitude comes near: phases start from a generator seeded by the key. magnitude(keys, m array of frames)."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in magnitude.schema if f.name in keys)

    def run(batches):
        for b in batches:
            out = []
            for i, m in enumerate(b.column(len(keys))):
                m = np.array(m.as_py(), dtype=np.float64)
                rng = np.random.default_rng(zlib.crc32(str([b.column(k)[i].as_py() for k in range(len(keys))]).encode()))
                y = m * np.exp(2j * np.pi * rng.random(m.shape))
                for _ in range(rounds):
                    again = analysed(synthesised(y, config), config)[: len(m)]
                    y = m * np.exp(1j * np.angle(again))
                out.append(synthesised(y, config).tolist())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], pa.array(out, pa.list_(pa.float64()))], [*keys, "x"])

    return magnitude.select(*keys, "m").mapInArrow(run, f"{fields}, x array<double>")


def masked(spec: DataFrame, mask: DataFrame, keys: list[str]) -> DataFrame:
    """spec times mask(keys, t, f, m)."""
    z = at().scaled(F.col("m"))
    return spec.join(mask, [*keys, "t", "f"]).withColumns({"re": z.re, "im": z.im}).drop("m")


def convolved(x: Column, h: Column) -> Column:
    """Array x convolved with array h, cut to the length of x, by the fast Fourier transform; null if either is."""

    @F.arrow_udf("array<double>")
    def run(xs: pa.Array, hs: pa.Array) -> pa.Array:
        plain = lambda v: np.asarray(v.values.to_numpy(zero_copy_only=False), dtype=np.float64)
        return pa.array([impulse_answer(plain(a), plain(b)) if a.is_valid and b.is_valid else None for a, b in zip(xs, hs, strict=True)], pa.list_(pa.float64()))

    return run(x, h)


def high_pass(wave: DataFrame, sr: int, cut: float = 100.0, value: str = "x") -> DataFrame:
    """Second-order recursive high-pass with a zero at 0 Hz and poles at the cut-off frequency, as the filter's answer to an
    impulse, which is cut where it is below the precision of doubles."""
    w = 2 * np.pi * cut / sr
    r = float(np.exp(-w))
    b1, b2, a1 = 2 * r * float(np.cos(w)), -r * r, -(1 + r)
    size = 4 + int(np.log(1e-18) / np.log(r))
    h, u, v = np.zeros(size), 0.0, 0.0
    for n in range(size):
        now = (1.0 if n == 0 else 0.0) + b1 * u + b2 * v
        h[n], u, v = now + a1 * u + r * v, now, u

    @F.arrow_udf("array<double>")
    def run(xs: pa.Array) -> pa.Array:
        return pa.array([impulse_answer(np.asarray(x.values.to_numpy(zero_copy_only=False), dtype=np.float64), h[: max(len(x.values), 1)]) if x.is_valid else None for x in xs], pa.list_(pa.float64()))

    return wave.withColumn(value, run(F.col(value)))
