"""Recurrences over series (keys, t, x) of any length, as segmented prefix scans.

A series is dealt into blocks of SIZE steps of t, which many tasks read. What a block does to the state that enters it is a map
of states; maps are composed, FAN at a time and in levels, until every block knows the state that enters it; then each block is
run alone. No task holds more than a block, or FAN maps. A map is small for each of the recurrences here:

- Exponential: affine, two numbers.
- Tracking: its rate depends on the data (rises follow more slowly than falls), so its map is monotone and piecewise linear, with
  a knot for each state that meets a value exactly. The maps contract: after some hundred steps all states are one number, and
  from there on a block is followed value by value (that part is sequential, but for one number of one block).
- Hysteresis: a table of at most 2 * cache states.

Defined results: t is whole; a series begins with its least t and may have gaps. A null x leaves the state as it is; before the
first other value the result is null. Keys aren't null. Rows of a series that share t are taken in the order of x.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SIZE, FAN = 4096, 256
_MAP = "struct<fresh:double,p:array<double>,q:array<double>>"


def affine(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All prefixes of the composition of s -> a[i] s + b[i], in log2(n) array steps. a[i] = 0 starts anew."""
    a, b, far = a.copy(), b.copy(), 1
    while far < len(a):
        b[far:] += a[far:] * b[:-far]
        a[far:] = a[far:] * a[:-far]
        far *= 2
    return a, b


@dataclass(frozen=True)
class Exponential:
    """s = alpha s + (1 - alpha) x, from the first value."""

    alpha: float

    def _steps(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        none = np.isnan(x)
        return np.where(none, 1.0, self.alpha), np.where(none, 0.0, (1 - self.alpha) * x)

    def run(self, x: np.ndarray, start: float | None) -> np.ndarray:
        a, b = self._steps(x)
        out = np.full(len(x), np.nan)
        first = 0
        if start is None:
            found = np.flatnonzero(~np.isnan(x))
            if not len(found):
                return out
            first, start = int(found[0]), x[found[0]]
            a[first], b[first] = 1.0, 0.0
        a, b = affine(a[first:], b[first:])
        out[first:] = a * start + b
        return out

    def table(self, x: np.ndarray) -> tuple:
        a, b = affine(*self._steps(x))
        fresh = self.run(x, None)[-1]
        return None if np.isnan(fresh) else float(fresh), [float(a[-1])], [float(b[-1])]

    def apply(self, m: dict, s: float) -> float:
        return m["p"][0] * s + m["q"][0]

    def then(self, f: dict, g: dict) -> tuple[list, list]:
        return [g["p"][0] * f["p"][0]], [g["p"][0] * f["q"][0] + g["q"][0]]


@dataclass(frozen=True)
class Tracking:
    """s follows x: s = a s + (1 - a) x with a = alpha where x falls below s, and 1 - (1 - alpha) / rise where it is above. All
    values lie between low and high."""

    alpha: float
    rise: float
    low: float = 0.0
    high: float = 0.0

    def within(self, low: float, high: float) -> Tracking:
        return Tracking(self.alpha, self.rise, low, high)

    def _follow(self, x: list[float], s: float) -> list[float]:
        up, out = 1 - (1 - self.alpha) / self.rise, []
        for v in x:
            if v == v:
                a = up if v > s else self.alpha
                s = a * s + (1 - a) * v
            out.append(s)
        return out

    def run(self, x: np.ndarray, start: float | None) -> np.ndarray:
        out = np.full(len(x), np.nan)
        first = 0
        if start is None:
            found = np.flatnonzero(~np.isnan(x))
            if not len(found):
                return out
            first = int(found[0])
            start, out[first] = float(x[first]), x[first]
            first += 1
        out[first:] = self._follow(x[first:].tolist(), start)
        return out

    def table(self, x: np.ndarray) -> tuple:
        up, down = 1 - (1 - self.alpha) / self.rise, self.alpha
        p = q = np.unique([self.low, self.high])
        for k, v in enumerate(x):
            if len(q) == 1:
                q = np.array(self._follow(x[k:].tolist(), float(q[0]))[-1:])
                break
            if v != v:
                continue
            if q[0] < v < q[-1]:
                j = int(np.searchsorted(q, v))
                if q[j] != v:
                    p, q = np.insert(p, j, np.interp(v, q, p)), np.insert(q, j, v)
            q = np.where(v > q, up * q + (1 - up) * v, down * q + (1 - down) * v)
            new = np.append(True, q[1:] > q[:-1])
            p, q = p[new], q[new]
        fresh = self.run(x, None)[-1]
        return None if np.isnan(fresh) else float(fresh), p.tolist(), q.tolist()

    def apply(self, m: dict, s: float) -> float:
        return float(np.interp(s, m["p"], m["q"]))

    def then(self, f: dict, g: dict) -> tuple[list, list]:
        inner = np.array([v for v in g["p"] if f["q"][0] < v < f["q"][-1]])
        p = np.unique(np.concatenate([f["p"], np.interp(inner, f["q"], f["p"])]))
        q = np.interp(np.interp(p, f["p"], f["q"]), g["p"], g["q"])
        new = np.append(True, q[1:] > q[:-1])
        return p[new].tolist(), q[new].tolist()


@dataclass(frozen=True)
class Hysteresis:
    """States c < cache: outside a segment with counter c; cache - 1 + c: inside one with counter c. x: 1 for active frames. The
    result is 1 where a segment opens, -1 where one closes, and 0."""

    cache: int

    def _tables(self, x: np.ndarray) -> np.ndarray:
        n, c = self.cache, np.arange(self.cache)
        on = np.concatenate([np.where(c + 1 >= n, 2 * n - 1, c + 1), np.minimum(n + c + 1, 2 * n - 1)])
        off = np.concatenate([c, np.where(c == 0, 0, n + c - 1)])
        rest = np.arange(2 * n)
        return np.where(np.isnan(x)[:, None], rest, np.where((x > 0)[:, None], on, off))

    def run(self, x: np.ndarray, start: float | None) -> np.ndarray:
        t, far, first = self._tables(x), 1, int(start or 0)
        while far < len(t):
            t[far:] = np.take_along_axis(t[far:], t[:-far], axis=1)
            far *= 2
        inside = np.append(first, t[:, first]) >= self.cache
        return np.diff(inside.astype(np.float64))

    def table(self, x: np.ndarray) -> tuple:
        t = self._tables(x)
        while len(t) > 1:
            odd = t[-1:] if len(t) % 2 else t[:0]
            t = np.concatenate([np.take_along_axis(t[1::2], t[: len(t) - len(odd) : 2], axis=1), odd])
        return float(t[0, 0]), [], t[0].astype(np.float64).tolist()

    def apply(self, m: dict, s: float) -> float:
        return m["q"][int(s)]

    def then(self, f: dict, g: dict) -> tuple[list, list]:
        return [], [g["q"][int(s)] for s in f["q"]]


# ---------------------------------------------------------------- blocks and their maps

def _numbers(xs: pa.Array) -> list[np.ndarray]:
    return [np.asarray(x.values.to_numpy(zero_copy_only=False), dtype=np.float64) for x in xs]


def _tables(kind, xs: Column) -> Column:
    @F.arrow_udf(_MAP)
    def run(column: pa.Array) -> pa.Array:
        made = [kind.table(x) for x in _numbers(column)]
        return pa.array([{"fresh": a, "p": p, "q": q} for a, p, q in made], pa.struct([("fresh", pa.float64()), ("p", pa.list_(pa.float64())), ("q", pa.list_(pa.float64()))]))

    return run(xs)


def _after(kind, m: dict, s: float | None) -> float | None:
    return m["fresh"] if s is None else kind.apply(m, s)


def _composed(kind, maps: Column) -> Column:
    @F.arrow_udf(_MAP)
    def run(column: pa.Array) -> pa.Array:
        out = []
        for row in column.to_pylist():
            f = row[0]["m"]
            for g in (x["m"] for x in row[1:]):
                p, q = kind.then(f, g)
                f = {"fresh": _after(kind, g, f["fresh"]), "p": p, "q": q}
            out.append(f)
        return pa.array(out, pa.struct([("fresh", pa.float64()), ("p", pa.list_(pa.float64())), ("q", pa.list_(pa.float64()))]))

    return run(maps)


def _entering(kind, maps: Column, start: Column) -> Column:
    """The state that enters each of a row's blocks."""

    @F.arrow_udf("array<double>")
    def run(column: pa.Array, first: pa.Array) -> pa.Array:
        out = []
        for row, s in zip(column.to_pylist(), first.to_pylist(), strict=True):
            states = []
            for x in row:
                states.append(s)
                s = _after(kind, x["m"], s)
            out.append(states)
        return pa.array(out, pa.list_(pa.float64()))

    return run(maps, start)


def _carried(maps: DataFrame, keys: list[str], kind, blocks: int, fan: int) -> DataFrame:
    """(keys, blk, start) of maps(keys, blk, m), of which a key has blocks 0 to blocks - 1."""
    more = maps.withColumn("sup", F.floor(F.col("blk") / fan)).groupBy(*keys, "sup").agg(F.array_sort(F.collect_list(F.struct("blk", "m"))).alias("maps"))
    if blocks > fan:
        above = _carried(more.select(*keys, F.col("sup").alias("blk"), _composed(kind, F.col("maps")).alias("m")), keys, kind, -(-blocks // fan), fan)
        more = more.join(above.withColumnRenamed("blk", "sup"), [*keys, "sup"], "left")
    else:
        more = more.withColumn("start", F.lit(None).cast("double"))
    zipped = F.arrays_zip(F.transform("maps", lambda x: x["blk"]).alias("blk"), _entering(kind, F.col("maps"), F.col("start")).alias("start"))
    return more.select(*keys, F.inline(zipped)).toDF(*keys, "blk", "start")


def scanned(df: DataFrame, keys: list[str], kind, x: str = "x", size: int = SIZE, fan: int = FAN) -> DataFrame:
    """(keys, blk, ts, s): the recurrence's results in blocks, ts and s being arrays of equal length."""
    low, high, last, begin = df.agg(F.min(F.col(x).cast("double")), F.max(F.col(x).cast("double")), F.max("t"), F.min("t")).first()
    if isinstance(kind, Tracking):
        kind = kind.within(low or 0.0, high or 0.0)
    rows = df.select(*keys, F.floor((F.col("t") - F.lit(begin or 0)) / size).alias("blk"), "t", F.col(x).cast("double").alias("x"))
    blocks = rows.groupBy(*keys, "blk").agg(F.array_sort(F.collect_list(F.struct("t", "x"))).alias("z"))
    blocks = blocks.select(*keys, "blk", F.transform("z", lambda z: z["t"]).alias("ts"), F.transform("z", lambda z: z["x"]).alias("xs"))

    @F.arrow_udf("array<double>")
    def run(column: pa.Array, first: pa.Array) -> pa.Array:
        return pa.array([[None if v != v else v for v in kind.run(a, s).tolist()] for a, s in zip(_numbers(column), first.to_pylist(), strict=True)], pa.list_(pa.float64()))

    many = (last - begin) // size + 1 if last is not None else 1
    if many == 1:
        return blocks.select(*keys, "blk", "ts", run("xs", F.lit(None).cast("double")).alias("s"))
    starts = _carried(blocks.select(*keys, "blk", _tables(kind, F.col("xs")).alias("m")), keys, kind, many, fan)
    return blocks.join(starts, [*keys, "blk"], "left").select(*keys, "blk", "ts", run("xs", "start").alias("s"))


def along(df: DataFrame, keys: list[str], kind, x: str = "x", size: int = SIZE, fan: int = FAN) -> DataFrame:
    """(keys, t, s): the recurrence's result at each row."""
    out = scanned(df, keys, kind, x, size, fan)
    return out.select(*keys, F.inline(F.arrays_zip(F.col("ts").alias("t"), "s")))


def segments(df: DataFrame, keys: list[str], cache: int, active: str = "active", size: int = SIZE, fan: int = FAN) -> DataFrame:
    """(keys, beg, end) of voice segments, see windows.hysteresis. A block pairs its own marks; only an opening without a close
    and a close without an opening, at most one each, meet those of other blocks."""
    if cache < 1:
        raise ValueError("a segment needs a cache of one frame at least")
    marks = scanned(df.withColumn("w_on", F.col(active).cast("double")), keys, Hysteresis(cache), "w_on", size, fan)
    m = F.filter(F.arrays_zip(F.col("ts").alias("t"), F.col("s").alias("s")), lambda x: x["s"] != 0)
    marks = marks.select(*keys, F.element_at("ts", -1).alias("w_last"), m.alias("m"))
    pairs = F.transform("m", lambda x, i: F.when(x["s"] > 0, F.struct(x["t"].alias("at"), F.get(F.col("m"), i + 1)["t"].alias("end"))).when(i == 0, F.struct(F.lit(None).cast("long").alias("at"), x["t"].alias("end"))))
    found = marks.select(*keys, F.explode(F.filter(pairs, lambda x: x.isNotNull())).alias("g")).select(*keys, "g.at", "g.end")
    ends = marks.groupBy(*keys).agg(F.max("w_last").alias("w_last"))
    rest = found.where("at IS NULL OR end IS NULL").withColumn("w_next", F.lead("end").over(Window.partitionBy(*keys).orderBy(F.coalesce("at", "end")))).where("at IS NOT NULL")
    rest = rest.join(ends, keys).select(*keys, "at", F.coalesce("w_next", "w_last").alias("end"))
    beg = F.greatest(F.col("at") - cache, F.lit(0)).cast("long").alias("beg")
    return found.where("at IS NOT NULL AND end IS NOT NULL").unionByName(rest).select(*keys, beg, F.col("end").cast("long").alias("end"))
