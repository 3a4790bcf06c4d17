"""Scores of steering directions, added up inside Arrow kernels.

Cells come as one row with an array of their channels, dealt and sorted by key. A kernel scores all directions of a batch of cells by
matrix products and adds up each key's cells where they are, so that what leaves it is an array as long as the grid for each key of a
batch, never a row for each cell and direction. The grid is held by every task: its size is that of the array's geometry.

Defined results: a channel that a cell lacks takes no part in its pairs, and counts as zero in products; a cell with a null or a value
that isn't finite adds nothing; rows with a null key are one group."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def steering_array(steer: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(channels, vectors): the steering table (a, ch, f, re, im) as vectors[f, a, channel]. Angles and bins count from 0."""
    p = steer.select("a", "ch", "f", "re", "im").toPandas()
    channels, angles, bins = (np.unique(p[c]) for c in ("ch", "a", "f"))
    if len(p) != len(channels) * len(angles) * len(bins) or not len(p) or angles[-1] + 1 != len(angles) or bins[-1] + 1 != len(bins):
        raise ValueError("a steering table needs every angle, channel and bin once, angles and bins counted from 0")
    z = np.zeros((len(bins), len(angles), len(channels)), dtype=complex)
    z[p["f"], p["a"], np.searchsorted(channels, p["ch"])] = p["re"] + 1j * p["im"].to_numpy()
    return channels, z


def of_channels(b: pa.RecordBatch, names: tuple[str, ...], channels: np.ndarray) -> list[np.ndarray]:
    """Which of the channels each cell of a batch has, and a table of cells x channels for each field; zero where there is none."""
    z = b.column("z")
    flat, row = z.flatten(), np.repeat(np.arange(len(z)), z.value_lengths().to_numpy(zero_copy_only=False))
    ch = flat.field("ch").to_numpy(zero_copy_only=False)
    at = np.minimum(np.searchsorted(channels, ch), len(channels) - 1)
    known = channels[at] == ch
    there = np.zeros((len(z), len(channels)), dtype=bool)
    there[row[known], at[known]] = True
    out = [there]
    for n in names:
        v = np.zeros(there.shape)
        v[row[known], at[known]] = flat.field(n).to_numpy(zero_copy_only=False)[known]
        out.append(v)
    return out


def grouped(b, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The group of each row of a batch, counted by first appearance, and each group's first row."""
    frame = pd.DataFrame({k: b.column(k).to_pandas() for k in keys})
    ids = frame.groupby(keys, sort=False, dropna=False).ngroup().to_numpy()
    return ids, np.unique(ids, return_index=True)[1]


def lists(v: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * v.shape[1], pa.int32()), pa.array(np.ascontiguousarray(v, dtype=np.float64).ravel()))


def types(df: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)


def summed(cells: DataFrame, keys: list[str], kernel: Callable[[pa.RecordBatch], np.ndarray], out: str) -> DataFrame:
    """(keys, a, out): the sums by key of kernel(batch), a table of rows x directions. One small aggregate adds the batches' arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                ids, first = grouped(b, keys)
                order = np.argsort(ids, kind="stable")
                v = kernel(b)
                v[~np.isfinite(v).all(axis=1)] = 0.0
                total = np.add.reduceat(v[order], np.searchsorted(ids[order], np.arange(len(first))), axis=0)
                yield pa.RecordBatch.from_arrays([*(b.column(k).take(pa.array(first)) for k in keys), lists(total)], [*keys, "v"])

    parts = cells.sortWithinPartitions(*keys).mapInArrow(run, f"{types(cells, keys)}, v array<double>")
    return parts.select(*keys, F.posexplode("v").alias("a", out)).groupBy(*keys, "a").agg(F.sum(out).alias(out)).withColumn("a", F.col("a").cast("long"))


def each(cells: DataFrame, keys: list[str], kernel: Callable[[pa.RecordBatch], np.ndarray], axis: str, out: str) -> DataFrame:
    """(keys, axis, out): kernel(batch) as it is, for every row; rows of nothing but NaN are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v = kernel(b)
                kept = np.flatnonzero(~np.isnan(v).all(axis=1))
                yield pa.RecordBatch.from_arrays([*(b.column(k).take(pa.array(kept)) for k in keys), lists(v[kept])], [*keys, "v"])

    rows = cells.mapInArrow(run, f"{types(cells, keys)}, v array<double>").select(*keys, F.posexplode("v").alias(axis, out))
    return rows.withColumn(axis, F.col(axis).cast("long"))


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Sorted batches cut anew so that each group is whole: one that a batch's end cuts waits for the next batch."""
    rest: pa.Table | None = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        t = t if rest is None else pa.concat_tables([rest, t])
        cut = int(grouped(t, keys)[1][-1])
        if cut:
            yield t.slice(0, cut).combine_chunks().to_batches()[0]
        rest = t.slice(cut)
    if rest is not None:
        yield rest.combine_chunks().to_batches()[0]


def cross_correlations(cells: DataFrame, keys: list[str], pairs: list[tuple[int, int]], tau: np.ndarray, omega: np.ndarray) -> DataFrame:
    """(keys, g, peak): for each frame (a key's cells, with phases `angle`) the sums over bins of cos(phase difference + omega tau) of
    every pair and delay as one array, pair by pair, and each pair's largest magnitude. tau: pairs x delays; omega: one a bin."""
    channels = np.unique(np.array(pairs))
    side = [(int(np.searchsorted(channels, i)), int(np.searchsorted(channels, j))) for i, j in pairs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in whole_groups(batches, keys):
            ids, first = grouped(b, keys)
            there, angle = of_channels(b, ("angle",), channels)
            f = b.column("f").to_numpy(zero_copy_only=False)
            g = np.zeros((len(first), len(side), tau.shape[1]))
            for p, (i, j) in enumerate(side):
                z = np.exp(1j * (angle[:, i] - angle[:, j]))
                good = there[:, i] & there[:, j] & np.isfinite(z)
                seen = np.zeros((len(first), len(omega)), dtype=complex)
                np.add.at(seen, (ids[good], f[good]), z[good])
                g[:, p] = (seen @ np.exp(1j * np.outer(omega, tau[p]))).real
            peak = np.abs(g).max(axis=2)
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(pa.array(first)) for k in keys), lists(g.reshape(len(g), -1)), lists(peak)], [*keys, "g", "peak"])

    return cells.sortWithinPartitions(*keys).mapInArrow(run, f"{types(cells, keys)}, g array<double>, peak array<double>")
