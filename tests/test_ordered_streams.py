"""Streams whose rows come in shuffled files, against the batch operators and plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessitura.operators import estimation as E
from tessitura.operators import scans as C
from tessitura.operators import windows as W
from tessitura.streaming import ordered as S

D = "/root/testdata/sf0.001"


def files(spark, df, tmp_path, many, at):
    """df as `many` files, one after the other; at: the file of each row."""
    for k in range(many):
        df.where(at == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


@pytest.fixture(scope="module")
def events(spark):
    return spark.read.parquet(f"{D}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def series(events):
    from pyspark.sql.window import Window

    t = (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("long")
    return events.select("user_id", t.alias("t"), F.col("value").alias("x"), F.col("event_type").isin("click", "purchase").alias("active"))


@pytest.mark.parametrize("kind", [C.Exponential(0.8), C.Tracking(0.7, 4.0)], ids=str)
def test_ten_shuffled_files_give_the_batch_result(spark, events, tmp_path, kind):
    stream = files(spark, events, tmp_path, 10, F.pmod(F.xxhash64("event_id"), F.lit(10)))
    got = {(r["user_id"], r["t"]): r["s"] for r in S.ended(spark, stream, "user_id", S.Followed(kind), "400 days").collect()}
    want = {(r["user_id"], r["t"]): r["s"] for r in C.along(series(events), ["user_id"], kind).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_rows_become_final_as_the_watermark_passes(spark, events, tmp_path):
    """Files in rough order of time: most results come out before the stream's end, the state keeps only what the watermark has not
    passed, and nothing changes."""
    low, high = (x.timestamp() for x in events.agg(F.min("ts"), F.max("ts")).first())
    step = (high - low) / 6
    jitter = F.pmod(F.xxhash64("event_id"), F.lit(int(step / 2)))
    at = F.least(F.lit(5), F.floor((F.unix_timestamp("ts") + jitter - low) / step)).cast("int")
    stream = files(spark, events, tmp_path, 6, at)
    fold = S.Segmented(3, ("click", "purchase"))
    got = sorted(tuple(r) for r in S.ended(spark, stream, "user_id", fold, f"{int(step)} seconds").collect())
    assert got == sorted(tuple(r) for r in W.hysteresis(series(events), ["user_id"], 3).collect())


def test_no_row_waits_longer_than_it_must(spark, events, tmp_path):
    cuts = events.approxQuantile("event_id", [0.25, 0.5, 0.75], 0.0)
    at = sum((F.col("event_id") > c).cast("int") for c in cuts)
    first = events.agg(F.min("ts")).first()[0]
    events = events.withColumn("ts", F.lit(first) + F.make_dt_interval(mins=F.col("event_id").cast("int")))
    q = S.ordered(files(spark, events, tmp_path, 4, at), "user_id", S.Followed(C.Exponential(0.5)), "1 hour")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", S.ROCKS)
    try:
        q.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        left = spark.read.format("statestore").option("stateVarName", "waiting").load(str(tmp_path / "state")).count()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass") if before is None else spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    newest = events.agg(F.max("ts")).first()[0]
    assert left == events.where(F.col("ts") > F.lit(newest) - F.expr("INTERVAL 1 HOUR")).count()
    assert spark.read.parquet(str(tmp_path / "out")).count() == events.count() - left


def test_covariances_of_a_shuffled_stream(spark, tmp_path):
    """Frames in shuffled files against the batch recursion, cell by cell."""
    rng = np.random.default_rng(6)
    bins, channels, frames = 3, 2, 11
    cells = [(u, t, f, c, *rng.normal(size=2).tolist()) for u in range(4) for t in range(frames) for f in range(bins) for c in range(channels)]
    masks = [(u, t, f, float(rng.random())) for u in range(4) for t in range(frames) for f in range(bins)]
    spec = spark.createDataFrame([(u, c, t, f, a, b) for u, t, f, c, a, b in cells], "utt long, ch long, t long, f long, re double, im double")
    mask = spark.createDataFrame(masks, "utt long, t long, f long, m double")
    frame = S.frames(spec, mask)
    stream = files(spark, frame, tmp_path, 5, F.pmod(F.xxhash64("utt", "t"), F.lit(5)))
    out = S.ended(spark, stream, "utt", S.Covariances(3, 0.8, bins), "1 hour")
    got = {(r["utt"], r["chunk"], r["f"], r["i"], r["j"]): (r["re"], r["im"]) for r in S.unpacked(out, bins).collect()}
    want = {(r["utt"], r["chunk"], r["f"], r["i"], r["j"]): (r["re"], r["im"]) for r in E.online_covariances(spec, mask, 3).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-12) for k in want)


def test_the_state_does_not_keep_rows_one_by_one(spark, events, tmp_path):
    """Before the watermark passes them, the rows that a micro-batch brings are blocks, however many rows a key has."""
    q = S.ordered(files(spark, events, tmp_path, 2, F.col("event_id") % 2), "user_id", S.Followed(C.Exponential(0.5)), "400 days")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", S.ROCKS)
    try:
        q.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        kept = {n: spark.read.format("statestore").option("stateVarName", n).load(str(tmp_path / "state")).count() for n in ("waiting", "blocks")}
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass") if before is None else spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    assert kept["waiting"] == 0 and 0 < kept["blocks"] <= 2 * events.select("user_id").distinct().count()
