"""Transforms of waves that are longer than a row or task: blocks(keys, blk, x) of `size` samples each, the last one shorter.

Analysis. A frame belongs to the block that holds its last sample, so a block needs the frame_len - 1 samples before it: each block
sends its last samples to the next. Padding at a wave's ends is made in its first and last block. Synthesis. A frame goes to the
one or two blocks that it overlaps; a block adds up its frames and divides by the sum of its frames' squared windows. Everything is
dealt by (keys, blk); of a whole wave only its length and its number of frames are known anywhere.

Defined results: equal to transforms.stft_frames and istft on whole waves, for any block size of frame_len or more; a wave without
samples has no blocks and no frames. A block that isn't there counts as zeros before the wave's other samples."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .transforms import StftConfig


def cut(wave: DataFrame, keys: list[str], size: int, value: str = "x") -> DataFrame:
    """(keys, blk, x) of whole waves (keys, x)."""
    many = F.ceil(F.size(value) / size).cast("long")
    at = wave.where(F.size(value) > 0).select(*keys, value, F.explode(F.sequence(F.lit(0).cast("long"), many - 1)).alias("blk"))
    return at.select(*keys, "blk", F.slice(value, (F.col("blk") * size + 1).cast("int"), F.lit(size)).alias("x"))


def gathered(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, x): whole waves again, for short ones."""
    z = F.array_sort(F.collect_list(F.struct("blk", "x")))
    return blocks.groupBy(*keys).agg(z.alias("z")).select(*keys, F.flatten(F.transform("z", lambda b: b["x"])).alias("x"))


def _fields(df: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for k in keys for f in df.schema if f.name == k)


def _floats(x: pa.Scalar) -> np.ndarray:
    return np.asarray(x.values.to_numpy(zero_copy_only=False), dtype=np.float64) if x.is_valid else np.zeros(0)


def _block_frames(x: np.ndarray, halo: np.ndarray, blk: int, n: int, size: int, c: StftConfig) -> tuple[int, np.ndarray]:
    """(first frame, spectra) of the frames whose last sample lies in a block; those that end in the padding behind a wave belong
    to its last block."""
    side, begin, last = c.n_fft // 2 * c.center, blk * size, blk * size + len(x) >= n
    halo = np.concatenate((np.zeros(max(0, min(begin, c.frame_len - 1) - len(halo))), halo))
    signal, at = np.concatenate((halo, x)), begin - len(halo)
    mirrored = c.pad == "reflect" and n > side
    before, behind = np.zeros(side), np.zeros(side)
    if side and mirrored:
        before, behind = signal[side:0:-1], signal[-2 : -2 - side : -1]
    if last:
        signal = np.concatenate((signal, behind, np.zeros(max(0, c.frame_len - n - 2 * side))))
    if blk == 0:
        signal, at = np.concatenate((before, signal)), -side
    first = max(0, -(-(begin - c.frame_len + 1 + side) // c.frame_hop)) if blk else 0
    end = max(c.frames(n), 1) if last else (begin + size - c.frame_len + side) // c.frame_hop + 1
    if end <= first:
        return first, np.zeros((0, c.bins), complex)
    views = np.lib.stride_tricks.sliding_window_view(signal, c.frame_len)[first * c.frame_hop - side - at :: c.frame_hop][: end - first]
    return first, np.fft.rfft(views * c.weights(), c.n_fft, axis=1)


def stft_frames(blocks: DataFrame, config: StftConfig, keys: list[str], size: int) -> DataFrame:
    """(keys, t, re array, im array), one row a frame."""
    if size < config.frame_len:
        raise ValueError("a block must hold a frame")
    halo = F.slice("x", F.greatest(F.size("x") - (config.frame_len - 2), F.lit(1)), F.lit(config.frame_len - 1))
    sent = blocks.select(*keys, "blk", "x", F.lit(None).cast("array<double>").alias("halo")).unionByName(blocks.select(*keys, (F.col("blk") + 1).alias("blk"), F.lit(None).cast("array<double>").alias("x"), halo.alias("halo")))
    met = sent.groupBy(*keys, "blk").agg(F.max("x").alias("x"), F.max("halo").alias("halo")).where("x IS NOT NULL")
    length = blocks.groupBy(*keys).agg(F.max(F.col("blk") * size + F.size("x")).alias("n"))
    rows = met.join(length, keys).select(*keys, "blk", "x", "halo", "n")

    def run(batches):
        for b in batches:
            owner, t, y = [], [], [np.zeros((0, config.bins), complex)]
            blk, x, halo, n = (b.column(len(keys) + k) for k in range(4))
            for i in range(b.num_rows):
                first, s = _block_frames(_floats(x[i]), _floats(halo[i]), blk[i].as_py(), n[i].as_py(), size, config)
                owner += [i] * len(s)
                t += range(first, first + len(s))
                y.append(s)
            y = np.concatenate(y)
            bounds = pa.array(np.arange(len(y) + 1) * config.bins, pa.int32())
            parts = (pa.ListArray.from_arrays(bounds, pa.array(np.ascontiguousarray(v).ravel())) for v in (y.real, y.imag))
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(pa.array(owner, pa.int64())) for k in range(len(keys))), pa.array(t, pa.int64()), *parts], [*keys, "t", "re", "im"])

    return rows.mapInArrow(run, f"{_fields(blocks, keys)}, t long, re array<double>, im array<double>")


def istft_blocks(frames: DataFrame, config: StftConfig, keys: list[str], size: int, keep: DataFrame | None = None) -> DataFrame:
    """blocks(keys, blk, x) of frames(keys, t, re, im). keep(keys, n): exact lengths."""
    if size < config.frame_len:
        raise ValueError("a block must hold a frame")
    side = config.n_fft // 2 * config.center
    begin = F.col("t") * config.frame_hop - side
    reach = F.sequence(F.floor(F.greatest(begin, F.lit(0)) / size), F.floor(F.greatest(begin + config.frame_len - 1, F.lit(0)) / size))
    dealt = frames.select(*keys, "t", "re", "im", F.explode(reach).alias("blk"))
    total = ((F.max("t") * config.frame_hop) + config.frame_len - 2 * side).alias("n")
    length = frames.groupBy(*keys).agg(total) if keep is None else keep.select(*keys, F.col("n").cast("long").alias("n"))
    z = F.array_sort(F.collect_list(F.struct("t", "re", "im")))  # frames of one block
    rows = dealt.groupBy(*keys, "blk").agg(z.alias("z")).join(length, keys)
    if keep is not None:  # samples beyond the last frame are zeros
        every = length.where("n > 0").select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / size))).alias("blk"), "n")
        rows = every.join(rows.drop("n"), [*keys, "blk"], "left")
    rows = rows.where(F.col("blk") * size < F.col("n")).select(*keys, "blk", "n", F.transform("z", lambda x: x["t"]).alias("ts"), F.flatten(F.transform("z", lambda x: x["re"])).alias("re"), F.flatten(F.transform("z", lambda x: x["im"])).alias("im"))

    def run(batches):
        w = config.weights()
        for b in batches:
            out = []
            blk, n, ts, re, im = (b.column(len(keys) + k) for k in range(5))
            for i in range(b.num_rows):
                at, many = blk[i].as_py() * size, min(size, n[i].as_py() - blk[i].as_py() * size)
                x, d = np.zeros(many), np.zeros(many)
                t = _floats(ts[i]).astype(np.int64)
                y = (_floats(re[i]) + 1j * _floats(im[i])).reshape(len(t), config.bins)
                parts = np.fft.irfft(y, config.n_fft, axis=1)[:, : config.frame_len] * w if len(t) else np.zeros((0, config.frame_len))
                for k, part in zip(t.tolist(), parts, strict=True):
                    from_ = k * config.frame_hop - side - at
                    lo, hi = max(0, from_), min(many, from_ + config.frame_len)
                    if lo < hi:
                        x[lo:hi] += part[lo - from_ : hi - from_]
                        d[lo:hi] += (w * w)[lo - from_ : hi - from_]
                out.append(np.where(d > 1e-10, x / np.where(d > 1e-10, d, 1), 0))
            bounds = np.concatenate(([0], np.cumsum([len(v) for v in out]))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keys) + 1], pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(out) if out else np.zeros(0)))], [*keys, "blk", "x"])

    return rows.mapInArrow(run, f"{_fields(frames, keys)}, blk long, x array<double>")
