"""Dense complex kernels on small matrices: one group of a key is a stack of matrices, at most bins x channels x channels.

Covariances are computed by Spark in long form cov(utt, f, i, j, re, im); kernels only solve and decompose."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.signal import at


def covariance(spec: DataFrame, mask: DataFrame | None = None, block: Column | None = None, least: float = 1e-6) -> DataFrame:
    """(utt, [blk,] f, i, j, re, im) = sum_t m x_i conj(x_j) / max(sum_t m, least). mask(utt, t, f, m); without one it is 1.
    The mask comes as one more row of its cell. Cells are dealt by (utt, f) once; a cell's products are made in its row, for
    i <= j only, and summed where they are."""
    rows = spec.select("utt", "t", "f", F.struct("ch", "re", "im").alias("z"), F.lit(None).cast("double").alias("m"))
    if mask is not None:
        rows = rows.unionByName(mask.select("utt", "t", "f", F.lit(None).cast(rows.schema["z"].dataType).alias("z"), F.col("m").cast("double").alias("m")))
    cell = rows.repartition("utt", "f").groupBy("utt", "t", "f").agg(F.array_sort(F.collect_list("z")).alias("z"), F.max("m").alias("m"))
    cell = cell.where("m IS NOT NULL") if mask is not None else cell.withColumn("m", F.lit(1.0))
    keys = ["utt", "f"] if block is None else ["utt", "blk", "f"]
    cell = cell if block is None else cell.withColumn("blk", block)
    pairs = F.flatten(F.transform("z", lambda a, k: F.transform(F.slice(F.col("z"), k + 1, F.size("z")), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    p = cell.select(*keys, "m", F.explode(pairs).alias("p")).select(*keys, "m", F.col("p.a.ch").alias("i"), F.col("p.b.ch").alias("j"), F.col("p.a.re").alias("re1"), F.col("p.a.im").alias("im1"), F.col("p.b.re").alias("re2"), F.col("p.b.im").alias("im2"))
    z = at(suffix="1") * at(suffix="2").conj()
    s = p.groupBy(*keys, "i", "j").agg(F.sum(F.col("m") * z.re).alias("re"), F.sum(F.col("m") * z.im).alias("im"), F.sum("m").alias("w"))
    s = s.select(*keys, "i", "j", *((F.col(c) / F.greatest("w", F.lit(least))).alias(c) for c in ("re", "im")))
    both = F.when(F.col("i") == F.col("j"), F.array(F.struct("i", "j", "re", "im"))).otherwise(F.array(F.struct("i", "j", "re", "im"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"), F.col("re"), (-F.col("im")).alias("im"))))
    return s.select(*keys, F.inline(both))


#: The columns of two covariances: by the mask, and by its complement.
TWO = ("s_re", "s_im", "n_re", "n_im")


def two_sums(spec: DataFrame, mask: DataFrame, noise: DataFrame | None = None, block: Column | None = None, least: float = 1e-6) -> DataFrame:
    """(utt, [blk,] f, i, j, s_re, s_im, n_re, n_im), i <= j: covariances by mask(utt, t, f, m) and by its complement, or by a mask of
    the noise. A cell's products are made once and summed under both weights; cells are dealt by (utt, f) once, for all that follows."""
    z = F.struct("ch", "re", "im")
    none = F.lit(None).cast("double")
    rows = spec.select("utt", "t", "f", z.alias("z"), none.alias("s"), none.alias("n"))
    void = F.lit(None).cast(rows.schema["z"].dataType)
    m = F.col("m").cast("double")
    rows = rows.unionByName(mask.select("utt", "t", "f", void.alias("z"), m.alias("s"), (1 - m if noise is None else none).alias("n")))
    if noise is not None:
        rows = rows.unionByName(noise.select("utt", "t", "f", void.alias("z"), none.alias("s"), m.alias("n")))
    cell = rows.repartition("utt", "f").groupBy("utt", "t", "f").agg(F.array_sort(F.collect_list("z")).alias("z"), F.max("s").alias("s"), F.max("n").alias("n"))
    keys = ["utt", "f"] if block is None else ["utt", "blk", "f"]
    cell = cell if block is None else cell.withColumn("blk", block)
    pairs = F.flatten(F.transform("z", lambda a, k: F.transform(F.slice(F.col("z"), k + 1, F.size("z")), lambda b: F.struct(a["ch"].alias("i"), b["ch"].alias("j"), (a["re"] * b["re"] + a["im"] * b["im"]).alias("re"), (a["im"] * b["re"] - a["re"] * b["im"]).alias("im")))))
    p = cell.select(*keys, "s", "n", F.inline(pairs))
    sums = p.groupBy(*keys, "i", "j").agg(*(F.sum(F.col(w) * F.col(c)).alias(f"{w}_{c}") for w in "sn" for c in ("re", "im")), F.sum("s").alias("ws"), F.sum("n").alias("wn"))
    scaled = {f"{w}_{c}": F.col(f"{w}_{c}") / F.greatest(f"w{w}", F.lit(least)) for w in "sn" for c in ("re", "im")}
    return sums.where("ws IS NOT NULL AND wn IS NOT NULL").select(*keys, "i", "j", *(scaled[k].alias(k) for k in TWO))


def two_packed(upper: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ch, s_re, s_im, n_re, n_im): two_sums as row-major arrays of whole matrices, with the channels of their rows."""
    here = F.struct("i", "j", *TWO)
    there = F.struct(F.col("j").alias("i"), F.col("i").alias("j"), *((-F.col(k) if k.endswith("im") else F.col(k)).alias(k) for k in TWO))
    both = upper.select(*keys, F.explode(F.when(F.col("i") == F.col("j"), F.array(here)).otherwise(F.array(here, there))).alias("x"))
    full = both.groupBy(*keys).agg(F.array_sort(F.collect_list("x")).alias("x"))
    return full.select(*keys, _channels("x").alias("ch"), *(F.col("x")[k].alias(k) for k in TWO))


def two_covariances(spec: DataFrame, mask: DataFrame, noise: DataFrame | None = None, block: Column | None = None, least: float = 1e-6) -> DataFrame:
    """(utt, [blk,] f, ch, s_re, s_im, n_re, n_im): two_sums, packed."""
    return two_packed(two_sums(spec, mask, noise, block, least), ["utt", "f"] if block is None else ["utt", "blk", "f"])


def hermitian_error(cov: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, err): largest difference between a matrix and its conjugate transpose, relative to its largest element."""
    b = cov.select(*keys, F.col("i").alias("j"), F.col("j").alias("i"), F.col("re").alias("re2"), F.col("im").alias("im2"))
    d = F.sqrt(F.pow(F.col("re") - F.col("re2"), 2) + F.pow(F.col("im") + F.col("im2"), 2))
    return cov.join(b, [*keys, "i", "j"]).groupBy(*keys).agg((F.max(d) / F.max(at().abs())).alias("err"))


def multiplied(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Complex matrix product of a and b in long form (keys, i, j, re, im): a join on the inner index and a sum."""
    x = a.select(*keys, "i", F.col("j").alias("k"), F.col("re").alias("re1"), F.col("im").alias("im1"))
    y = b.select(*keys, F.col("i").alias("k"), "j", F.col("re").alias("re2"), F.col("im").alias("im2"))
    z = at(suffix="1") * at(suffix="2")
    return x.join(y, [*keys, "k"]).groupBy(*keys, "i", "j").agg(F.sum(z.re).alias("re"), F.sum(z.im).alias("im"))


def diagonal_added(a: DataFrame, value: float) -> DataFrame:
    return a.withColumn("re", F.col("re") + F.when(F.col("i") == F.col("j"), value).otherwise(0.0))


def packed(cov: DataFrame, keys: list[str], name: str) -> DataFrame:
    """(keys, name_ch, name_re, name_im): each matrix as row-major arrays, and its channels in order. A channel that a recording
    lacks has no row or column."""
    z = F.array_sort(F.collect_list(F.struct("i", "j", "re", "im")))
    return cov.groupBy(*keys).agg(z.alias("z")).select(*keys, _channels("z").alias(f"{name}_ch"), F.transform("z", lambda x: x["re"]).alias(f"{name}_re"), F.transform("z", lambda x: x["im"]).alias(f"{name}_im"))


def _channels(z: str) -> Column:
    return F.array_distinct(F.transform(z, lambda x: x["i"]))


def matrices(column_re, column_im) -> np.ndarray:
    """Row-major arrays as a stack of square matrices, all of one size."""
    x = np.asarray(column_re.flatten()) + 1j * np.asarray(column_im.flatten())
    n = len(column_re)
    side = int(round(np.sqrt(len(x) / n))) if n else 0
    return x.reshape(n, side, side)


def same_sizes(columns: list) -> list[np.ndarray]:
    """The rows of a batch by the lengths of these arrays: for each combination that occurs, its rows."""
    lengths = np.stack([c.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) for c in columns], axis=1)
    kinds, kind = np.unique(lengths, axis=0, return_inverse=True)
    return [np.flatnonzero(kind.ravel() == k) for k in range(len(kinds))]


def _square(column) -> bool:
    many = len(column[0].values) if column[0].is_valid else 0
    return many > 0 and round(np.sqrt(many)) ** 2 == many


def _each(kernel, stacks: list[np.ndarray]) -> np.ndarray:
    """The kernel's result for each row, flattened; not a number where it has none. All at once, or one by one if one can't be solved."""
    many = len(stacks[0])
    good = np.logical_and.reduce([np.isfinite(x).all(axis=(1, 2)) for x in stacks])
    safe = [np.where(good[:, None, None], x, np.eye(x.shape[1], x.shape[2])) for x in stacks]
    try:
        y = np.array(kernel(*safe), dtype=complex).reshape(many, -1)
    except np.linalg.LinAlgError:
        found: list[np.ndarray | None] = []
        for k in range(many):
            try:
                found.append(np.asarray(kernel(*(x[k : k + 1] for x in safe))).ravel())
            except np.linalg.LinAlgError:
                found.append(None)
        size = next((len(x) for x in found if x is not None), 1)
        y = np.stack([np.full(size, np.nan) if x is None else x for x in found]).astype(complex)
    y[~good] = np.nan
    return y


def by_channel(df: DataFrame, keys: list[str], ch: str, out: str) -> DataFrame:
    """(keys, ch, re, im): the elements of vectors out_re, out_im as rows, under the channels that array `ch` names."""
    long = df.select(*keys, F.explode(F.arrays_zip(F.col(ch).alias("c"), F.col(f"{out}_re").alias("re"), F.col(f"{out}_im").alias("im"))).alias("z"))
    return long.select(*keys, F.col("z.c").cast("long").alias("ch"), F.col("z.re").alias("re"), F.col("z.im").alias("im"))


def unsolved(df: DataFrame, out: str) -> DataFrame:
    """(n): how many rows of what `per_row` gave have no result."""
    return df.agg(F.count_if(F.col(f"{out}_re").isNull()).alias("n"))


def per_row(df: DataFrame, keys: list[str], inputs: list[str], kernel, out: str, size: str = "vector") -> DataFrame:
    """keys, out_re, out_im: kernel(stack of each input's matrices) -> stack of vectors or matrices, flattened. All rows of an
    Arrow batch whose matrices have one size are solved in one call; no shuffle. A row whose matrices hold anything but finite
    numbers or aren't square, or that the kernel can't solve, gives nulls; `unsolved` counts them. The others of its batch aren't
    affected."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in keys)
    columns = [*keys, *(f"{x}_{p}" for x in inputs for p in ("re", "im"))]

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            col = dict(zip(columns, b.columns, strict=True))
            width, found = np.zeros(b.num_rows, dtype=np.int64), []
            for rows in same_sizes([col[f"{x}_re"] for x in inputs]):
                of = {c: col[c].take(pa.array(rows)) for c in columns[len(keys) :]}
                if all(_square(of[f"{x}_re"]) for x in inputs):
                    y = _each(kernel, [matrices(of[f"{x}_re"], of[f"{x}_im"]) for x in inputs])
                    good = np.isfinite(y).all(axis=1)
                    width[rows[good]] = y.shape[1]
                    found.append((rows[good], y[good]))
            bounds = np.append(0, np.cumsum(width))
            flat = np.zeros(bounds[-1], dtype=complex)
            for rows, y in found:
                flat[bounds[rows][:, None] + np.arange(y.shape[1])] = y
            parts = [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(np.ascontiguousarray(v)), mask=pa.array(width == 0)) for v in (flat.real, flat.imag)]
            yield pa.RecordBatch.from_arrays([*(col[k] for k in keys), *parts], [*keys, f"{out}_re", f"{out}_im"])

    return df.select(*columns).mapInArrow(run, f"{fields}, {out}_re array<double>, {out}_im array<double>")


def loaded(r: np.ndarray, share: float = 1e-10) -> np.ndarray:
    """A stack with a little of its trace on the diagonals, so that singular ones can be solved."""
    n = r.shape[-1]
    return r + (share * np.trace(r, axis1=1, axis2=2).real / n + 1e-15)[:, None, None] * np.eye(n)


def whitening(noise: np.ndarray, share: float = 1e-10) -> np.ndarray:
    """Inverse Cholesky factors. Only matrices that are singular, or nearly so, get a load; the others are factored as they are."""
    v = np.linalg.eigvalsh(noise)
    near = v[:, 0] <= share * v[:, -1]
    return np.linalg.inv(np.linalg.cholesky(np.where(near[:, None, None], loaded(noise, share), noise)))


def inverse(r: np.ndarray) -> np.ndarray:
    return np.linalg.inv(r)


def solved(r: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x of r x = b for each matrix of a stack."""
    return np.linalg.solve(r, b)


def eigenvalues(r: np.ndarray) -> np.ndarray:
    return np.linalg.eigvalsh((r + r.conj().transpose(0, 2, 1)) / 2)


def principal(r: np.ndarray, noise: np.ndarray | None = None) -> np.ndarray:
    """The eigenvector of the largest (generalised) eigenvalue; the generalised problem is whitened by a Cholesky factor."""
    if noise is None:
        return np.linalg.eigh(r)[1][:, :, -1]
    low = whitening(noise)
    v = np.linalg.eigh(low @ r @ low.conj().transpose(0, 2, 1))[1][:, :, -1]
    return (low.conj().transpose(0, 2, 1) @ v[:, :, None])[:, :, 0]


def generalized_eigenvalues(r: np.ndarray, noise: np.ndarray) -> np.ndarray:
    low = whitening(noise)
    return np.linalg.eigvalsh(low @ r @ low.conj().transpose(0, 2, 1))


def rank_one(r: np.ndarray, noise: np.ndarray | None = None) -> np.ndarray:
    """Rank-one approximation with the matrix's trace."""
    v = principal(r, noise)
    v = v if noise is None else (noise @ v[:, :, None])[:, :, 0]
    out = v[:, :, None] * v[:, None, :].conj()
    return out * (np.trace(r, axis1=1, axis2=2) / np.maximum(np.trace(out, axis1=1, axis2=2).real, 1e-15))[:, None, None]


def rebuilt(r: np.ndarray, inverted: bool = False, floor: float = 1.1920929e-07) -> np.ndarray:
    """Hermitian matrices scaled to a largest eigenvalue of 1, with eigenvalues floored, put together again; or their inverses."""
    v, u = np.linalg.eigh((r + r.conj().transpose(0, 2, 1)) / 2)
    v = np.maximum(v / np.maximum(v[:, -1:], floor), floor)
    return (u * (1 / v if inverted else v)[:, None, :]) @ u.conj().transpose(0, 2, 1)


def log_determinant(r: np.ndarray, floor: float = 1.1920929e-07) -> np.ndarray:
    """Of the matrix scaled to a largest eigenvalue of 1, eigenvalues floored."""
    v = eigenvalues(r)
    return np.log(np.maximum(v / np.maximum(v[:, -1:], 1e-15), floor)).sum(axis=1)[:, None]
