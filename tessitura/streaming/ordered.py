"""Recurrences in event time over streams whose rows come out of order.

Keys share the state of one of BUCKETS buckets: list states of the rows that the watermark has not passed, and of what the recurrence of
each key has come to. What a micro-batch brings a bucket is kept as blocks of Arrow bytes, so that the state costs a step for each bucket
of a batch and not for each row or key; what is left of blocks when the watermark has passed their first rows, no more than what may come
late, is kept by rows. A task holds one bucket at once.
A timer at the earliest waiting row wakes the bucket when the watermark passes it; all rows up to the watermark are then final, are
put in order and folded, and leave the state. So the result doesn't depend on how the rows were cut into micro-batches. Rows
that come later than the watermark allows are dropped by Spark. `ended` also folds what still waits when a stream has ended.

A fold is an object with `rows` and `state` (schemas of what waits, its columns' first being the event time, and of what is kept),
`out` (schema of the results, without the key), `step(state or None, frame in order) -> (state, results)` with results as a
list of tuples, and `close(state) -> results` for the end of a stream."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import TimestampType

from ..operators.scans import Exponential, Hysteresis, Tracking
from ..sources.places import scratch

BUCKETS = 1024
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _order(schema: str) -> list[str]:
    """The columns that rows are put in order by: all but arrays."""
    return [c.split()[0] for c in schema.split(", ") if not c.split()[1].startswith("array")]


def _plain(frame: pd.DataFrame, columns: list[str]) -> list[tuple]:
    """Rows of the frame as the state's store takes them."""
    plain = lambda v: [float(x) for x in v] if isinstance(v, np.ndarray) else v.to_pydatetime() if isinstance(v, pd.Timestamp) else None if v is pd.NaT else v
    return [tuple(map(plain, r)) for r in frame[columns].astype(object).itertuples(index=False, name=None)]


def _block(frame: pd.DataFrame) -> bytes:
    rows, out = pa.RecordBatch.from_pandas(frame, preserve_index=False).replace_schema_metadata(), pa.BufferOutputStream()
    with pa.ipc.new_stream(out, rows.schema) as w:
        w.write_batch(rows)
    return out.getvalue().to_pybytes()


def _rows(blocks: list[bytes], plain: pd.DataFrame) -> pd.DataFrame:
    """The rows of blocks and those kept one by one."""
    parts = [pa.ipc.open_stream(b).read_all().to_pandas() for b in blocks]
    parts = parts + [plain] if len(plain) or not parts else parts
    return parts[0] if len(parts) == 1 else pd.concat(parts, ignore_index=True)


def _by_key(frame: pd.DataFrame, fold) -> Iterator[tuple[str | None, pd.DataFrame]]:
    """(key as a string, its rows in order)."""
    frame = frame.sort_values(["of", *_order(fold.rows)], ignore_index=True)
    cuts = (np.flatnonzero(np.diff(pd.factorize(frame["of"], use_na_sentinel=False)[0])) + 1).tolist()
    for a, b in zip([0, *cuts], [*cuts, len(frame)], strict=True):
        of, part = frame["of"].iloc[a], frame.iloc[a:b].drop(columns="of")
        part.index = pd.RangeIndex(len(part))
        yield None if pd.isna(of) else of, part


class InOrder(StatefulProcessor):
    """Buffers a bucket's rows until the watermark has passed them, then folds each key's in the order of their columns."""

    def __init__(self, fold):
        self.fold, self.ts = fold, _names(fold.rows)[0]
        self.columns, self.results = ["of", *_names(fold.rows)], ["of", *_names(fold.out)]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.blocks = handle.getListState("blocks", "block binary")
        self.waiting = handle.getListState("waiting", f"of string, {self.fold.rows}")
        self.kept = handle.getListState("kept", f"of string, {self.fold.state}")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = []
        for new in rows:
            self.blocks.appendValue((_block(new[self.columns]),))
            first.append(int(_ms(new[self.ts]).min()))
        self.handle.registerTimer(min(first))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        till = timerValues.getCurrentWatermarkInMs()
        blocks = [bytes(r[0]) for r in self.blocks.get()]
        plain = pd.DataFrame(list(self.waiting.get()), columns=self.columns)
        if not blocks and plain.empty:
            return
        frame = _rows(blocks, plain)
        final = _ms(frame[self.ts]) <= till
        if final.any():
            states, made = {r[0]: tuple(r[1:]) for r in self.kept.get()}, []
            for of, part in _by_key(frame[final], self.fold):
                state, new = self.fold.step(states.get(of), part)
                states[of] = tuple(state)
                made += [(of, *r) for r in new]
            self.kept.put([(of, *state) for of, state in states.items()])
            if made:
                yield pd.DataFrame(made, columns=self.results)
        if blocks:
            self.blocks.clear()
        if not final.all():
            rest = frame[~final]
            self.waiting.put(_plain(rest, self.columns))
            self.handle.registerTimer(int(_ms(rest[self.ts]).min()))
        elif len(plain):
            self.waiting.clear()

    def close(self) -> None:
        pass


def _ms(instants: pd.Series) -> np.ndarray:
    return pd.to_datetime(instants).to_numpy().astype("datetime64[us]").astype(np.int64) // 1000


def ordered(stream: DataFrame, key: str, fold, late: str) -> DataFrame:
    """The stream of the fold's results, (key, *out), as rows become final. late: how far behind the newest a row may come."""
    ts, kind = _names(fold.rows)[0], stream.schema[key].dataType.simpleString()
    rows = stream.withWatermark(ts, late).select(F.pmod(F.xxhash64(key), F.lit(BUCKETS)).alias("bucket"), F.col(key).cast("string").alias("of"), *_names(fold.rows))
    out = rows.groupBy("bucket").transformWithStateInPandas(InOrder(fold), outputStructType=f"of string, {fold.out}", outputMode="Append", timeMode="EventTime")
    return out.select(F.col("of").cast(kind).alias(key), *_names(fold.out))


def ended(spark: SparkSession, stream: DataFrame, key: str, fold, late: str) -> DataFrame:
    """(key, *out) of all that the stream holds now: what became final, and then what still waited and what the fold's end adds."""
    path, setting = scratch(spark, "ordered"), "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, ROCKS)
    try:
        out = ordered(stream, key, fold, late)
        q = out.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
        q.awaitTermination()
        state = lambda name: spark.read.format("statestore").option("stateVarName", name).load(f"{path}/state")
        kept = state("kept").select("key.bucket", "list_element.of", F.col("list_element").alias("kept"))
        waiting = state("waiting").select("key.bucket", "list_element.*")
        blocks = state("blocks").select("key.bucket", "list_element.block")
    finally:
        spark.conf.unset(setting) if before is None else spark.conf.set(setting, before)
    columns, results = ["of", *_names(fold.rows)], ["of", *_names(fold.out)]
    ts = columns[1]

    def finish(bucket, states: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        known = {s["of"]: tuple(s[c] for c in _names(fold.state)) for s in states["kept"]}
        parts, made = {}, []
        if len(rows):
            whole = rows["block"].notna()
            plain = rows[~whole]
            # rows were stored from the worker's local times, and are read as such again
            plain = plain.assign(**{ts: [None if pd.isna(v) else TimestampType().fromInternal(int(v)) for v in plain[ts]]})
            parts = dict(_by_key(_rows([bytes(b) for b in rows.loc[whole, "block"]], plain[columns]), fold))
        for of in dict.fromkeys([*known, *parts]):
            state, new = fold.step(known.get(of), parts[of]) if of in parts else (known[of], [])
            made += [(of, *r) for r in new + fold.close(state)]
        return pd.DataFrame(made, columns=results)

    # the reader needs the store's provider at run time, so all are stored before the setting is gone
    stored = lambda df, name: (df.write.parquet(f"{path}/{name}"), spark.read.schema(df.schema).parquet(f"{path}/{name}"))[1]
    spark.conf.set(setting, ROCKS)
    try:
        kept, waiting, blocks = stored(kept, "kept"), stored(waiting.withColumn(ts, F.unix_micros(ts)), "waiting"), stored(blocks, "blocks")
    finally:
        spark.conf.unset(setting) if before is None else spark.conf.set(setting, before)
    waiting = waiting.unionByName(blocks, allowMissingColumns=True)
    rest = kept.groupBy("bucket").cogroup(waiting.groupBy("bucket")).applyInPandas(finish, f"of string, {fold.out}")
    rest = rest.select(F.col("of").cast(out.schema[key].dataType).alias(key), *_names(fold.out))
    return spark.read.schema(out.schema).parquet(f"{path}/out").unionByName(rest)



# ---------------------------------------------------------------- folds

@dataclass(frozen=True)
class Followed:
    """(t, s) of a recurrence of operators.scans along a key's rows: t counts them from 0."""

    kind: Exponential | Tracking
    rows: str = "ts timestamp, event_id long, value double"
    state: str = "t long, s double"
    out: str = "t long, s double"

    def step(self, state, frame):
        t, s = state if state is not None else (0, None)
        found = self.kind.run(frame["value"].to_numpy(dtype=np.float64), None if s is None or s != s else s)
        made = [(t + k, None if v != v else v) for k, v in enumerate(found.tolist())]
        return (t + len(made), made[-1][1]), made

    def close(self, state):
        return []


@dataclass(frozen=True)
class Segmented:
    """(beg, end) of voice segments, see operators.windows.hysteresis; frames are active whose event_type is in `active`."""

    cache: int
    active: tuple[str, ...]
    rows: str = "ts timestamp, event_id long, event_type string"
    state: str = "t long, at long, open long"
    out: str = "beg long, end long"

    def step(self, state, frame):
        t, at, opened = state if state is not None else (0, 0, -1)
        kind = Hysteresis(self.cache)
        x = frame["event_type"].isin(self.active).to_numpy(dtype=np.float64)
        marks, made = kind.run(x, at), []
        for k in np.flatnonzero(marks).tolist():
            if marks[k] > 0:
                opened = max(t + k - self.cache, 0)
            else:
                made.append((opened, t + k))
                opened = -1
        return (t + len(x), int(kind.table(x)[2][int(at)]), opened), made

    def close(self, state):
        return [(state[2], state[0] - 1)] if state is not None and state[2] >= 0 else []


@dataclass(frozen=True)
class Covariances:
    """(chunk, re, im): covariances that forget, of each bin of a key's frames, when a chunk of frames is whole. A frame is m (a
    mask value a bin) and re, im (bins times channels); results are bins times channels times channels. The state holds the
    matrices of the last chunk, and the sums of the one that is open."""

    chunk: int
    alpha: float
    bins: int
    later: float | None = None
    least: float = 1e-6
    rows: str = "ts timestamp, t long, m array<double>, re array<double>, im array<double>"
    state: str = "chunk long, re array<double>, im array<double>, sum_re array<double>, sum_im array<double>, weight array<double>"
    out: str = "chunk long, re array<double>, im array<double>"

    def _closed(self, r, s, w):
        now = s / np.maximum(w, self.least)[:, None, None]
        return now if r is None else self.alpha * r + (1 - self.alpha if self.later is None else self.later) * now

    def step(self, state, frame):
        chunk, r, s, w = -1, None, None, None
        if state is not None:
            chunk = int(state[0])
            r, s = (None if re is None or len(re) == 0 else (np.array(re) + 1j * np.array(im)).reshape(self.bins, -1) for re, im in (state[1:3], state[3:5]))
            side = int(round(np.sqrt(s.shape[1])))
            r, s = (x if x is None else x.reshape(self.bins, side, side) for x in (r, s))
            w = np.array(state[5])
        made = []
        for t, m, re, im in frame[["t", "m", "re", "im"]].itertuples(index=False):
            x = (np.array(re) + 1j * np.array(im)).reshape(self.bins, -1)
            if t // self.chunk != chunk:
                if s is not None:
                    r = self._closed(r, s, w)
                    made.append((chunk, r.real.ravel().tolist(), r.imag.ravel().tolist()))
                chunk, s, w = t // self.chunk, np.zeros((self.bins, x.shape[1], x.shape[1]), complex), np.zeros(self.bins)
            m = np.array(m)
            s = s + m[:, None, None] * (x[:, :, None] * x[:, None, :].conj())
            w = w + m
        none: list[float] = []
        flat = lambda x: (none, none) if x is None else (x.real.ravel().tolist(), x.imag.ravel().tolist())
        return (int(chunk), *flat(r), *flat(s), w.tolist()), made

    def close(self, state):
        if state is None:
            return []
        r, s = ((np.array(a) + 1j * np.array(b)) if a is not None and len(a) else None for a, b in (state[1:3], state[3:5]))
        shape = (self.bins, int(round(np.sqrt(len(s) // self.bins))), -1)
        r = self._closed(None if r is None else r.reshape(shape), s.reshape(shape), np.array(state[5]))
        return [(int(state[0]), r.real.ravel().tolist(), r.imag.ravel().tolist())]


def frames(spec: DataFrame, mask: DataFrame) -> DataFrame:
    """(utt, ts, t, m, re, im) of spec(utt, ch, t, f, re, im) and mask(utt, t, f, m): a row a frame, its cells by bin and channel. A
    second a frame, from 1: what isn't after 1970 is late for a new watermark."""
    cell = spec.join(mask, ["utt", "t", "f"]).groupBy("utt", "t").agg(F.array_sort(F.collect_list(F.struct("f", "ch", "re", "im", "m"))).alias("z"))
    m = F.transform(F.filter("z", lambda x: x["ch"] == F.col("z")[0]["ch"]), lambda x: x["m"].cast("double"))
    return cell.select("utt", F.timestamp_seconds(F.col("t") + 1).alias("ts"), F.col("t").cast("long").alias("t"), m.alias("m"), F.transform("z", lambda x: x["re"]).alias("re"), F.transform("z", lambda x: x["im"]).alias("im"))


def unpacked(out: DataFrame, bins: int) -> DataFrame:
    """(utt, chunk, f, i, j, re, im) of what Covariances gives."""
    side = F.sqrt(F.size("re") / bins).cast("int")
    at = out.select("utt", "chunk", side.alias("n"), F.posexplode(F.arrays_zip("re", "im")).alias("k", "z"))
    return at.select("utt", "chunk", *(x.cast("long").alias(name) for name, x in (("f", F.floor(F.col("k") / (F.col("n") * F.col("n")))), ("i", F.floor(F.col("k") / F.col("n")) % F.col("n")), ("j", F.col("k") % F.col("n")))), "z.re", "z.im")
