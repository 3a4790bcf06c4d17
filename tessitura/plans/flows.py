"""Queries of streams, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import scans as C
from ..sources import sinks as K
from ..sources import tables as T
from ..sources.places import scratch
from ..streaming import online as O
from ..streaming import ordered as N
from . import estimates
from . import fixtures as X
from .estimates import mask, spec
from .fixtures import SAMPLES, SERIES, r6
from .keyed import SEGMENTS, TRACKED, scaled_round


def instant(c):
    return F.unix_timestamp(c).alias("at")


def st01(spark, d):
    w = O.drained(spark, O.tumbling(O.event_stream(spark, d), "1 day"), "complete")
    return w.select(instant(F.col("window.start")), "n", F.round("x", 4).alias("x"))


def st02(spark, d):
    w = O.drained(spark, O.hopping(O.event_stream(spark, d), "2 days", "1 day"), "complete")
    return w.select(instant(F.col("window.start")), "n", F.round("x", 4).alias("x"))


def followed(kind):
    """Each user's values in event time, whatever the order that files and batches give them in."""
    return lambda spark, d: N.ended(spark, O.event_stream(spark, d), "user_id", N.Followed(kind), "1 hour").withColumnRenamed("user_id", "key")


def st03(spark, d):
    return followed(C.Exponential(0.73519))(spark, d).select("key", "t", F.round("s", 6).alias("s"))


def st03_covariances(spark, d):
    """Frames that come in three files, in rough order of time only."""
    frame, folder = N.frames(spec(spark, d), mask(spark, d)), scratch(spark, "frames")
    at = F.least(F.lit(2), F.floor((F.col("t") + F.col("utt") % 2) / 3))
    for k in range(3):
        frame.where(at == k).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(frame.schema).parquet(folder)
    out = N.unpacked(N.ended(spark, stream, "utt", N.Covariances(3, 0.8, X.BINS), "2 seconds"), X.BINS)
    return out.select("utt", "chunk", "f", "i", "j", F.round("re", 6).alias("re"), F.round("im", 6).alias("im"))


def st04(spark, d):
    return followed(C.Tracking(0.7, 4.0))(spark, d).select("key", "t", scaled_round(F.col("s")).alias("s"))


def st05(spark, d):
    s = N.ended(spark, O.event_stream(spark, d), "user_id", N.Segmented(3, ("click", "purchase")), "1 hour")
    return s.withColumnRenamed("user_id", "key")


def st05_sessions(spark, d):
    w = O.drained(spark, O.sessions(O.event_stream(spark, d), "6 hours"), "complete")
    return w.select("user_id", instant(F.col("window.start")), "n")


def src02(spark, d):
    p = X.read(spark, d, "pages")
    return T.parse_script(p.select(F.concat(F.lit(" "), F.col("page_id").cast("string"), F.lit(" \t"), "url", F.lit(" ")).alias("value")))


def src03(spark, d):
    p = X.read(spark, d, "pages")
    s = T.parse_script(p.select(F.concat_ws(" ", F.col("page_id").cast("string"), F.lit("a b"), "url").alias("value")), tokens=4)
    return s.select("key", F.size("value").cast("long").alias("n"), F.element_at("value", 3).alias("last"))


def src07(spark, d):
    cuts = spark.createDataFrame([(0, 0.0, 0.001), (1, 0.001, 0.0025)], "seg long, beg double, end double").join(X.wave(spark, d).select("utt").distinct())
    s = T.segments(X.wave(spark, d), cuts, X.SR)
    return s.select("seg", "utt", "ch", F.size("x").cast("long").alias("n"), F.round(F.aggregate("x", F.lit(0.0), lambda a, x: a + x), 6).alias("x"))


def src13(spark, d):
    p = X.read(spark, d, "part").select(F.col("p_partkey").alias("k"), (F.col("p_partkey") * 37 % 256).alias("u"))
    return p.select("k", F.round(T.decompressed(F.col("u"), F.lit(-1.0), F.lit(0.5), F.lit(2.0), F.lit(7.0)), 6).alias("x"))


def src14(spark, d):
    """Waves written as files' bytes and read again: 16-bit steps."""
    w = X.wave(spark, d).select((F.col("utt") * 4 + F.col("ch")).alias("utt"), "x")
    files = K.encode_waves(w).select(F.floor(F.col("utt") / 4).cast("string").alias("key"), F.format_string("%d-%d", F.floor(F.col("utt") / 4), F.col("utt") % 4).alias("path"), "content")
    x = T.read_waves(files, 16000).select(F.col("key").cast("long").alias("utt"), F.col("ch").cast("long").alias("ch"), F.posexplode("x").alias("n", "x"))
    return x.select("utt", "ch", F.col("n").cast("long").alias("n"), F.round(F.col("x") * 32768, 0).cast("long").alias("x"))


def src08(spark, d):
    w = X.wave(spark, d).select((F.col("utt") * 4 + F.col("ch")).alias("utt"), "x")
    files = K.encode_arrays(w, "float64").select(F.col("utt").cast("string").alias("key"), F.lit("").alias("path"), "content")
    return T.read_arrays(files).select(F.col("key").cast("long").alias("utt"), F.col("cols").cast("long").alias("n"), F.round(F.aggregate("x", F.lit(0.0), lambda a, x: a + x), 6).alias("x"))


def src11(spark, d):
    w = X.wave(spark, d).select((F.col("utt") * 4 + F.col("ch")).alias("utt"), "x")
    files = K.encode_arrays(w, "float64").select(F.col("utt").cast("string").alias("key"), F.lit("").alias("path"), F.expr("substr(content, length(content) - 511, 512)").alias("content"))
    return T.read_raw(files, "float64", 64).select(F.col("key").cast("long").alias("utt"), F.round(F.aggregate("x", F.lit(0.0), lambda a, x: a + x), 6).alias("x"))


def src16(spark, d):
    w = X.read(spark, d, "documents")
    one = lambda k: w.where(F.col("doc_id") % (k + 2) == 0).select(F.col("doc_id").alias("key"), F.col("source").alias("value"))
    return T.channels_of([one(0), one(1), one(2)]).select("key", F.col("ch").cast("long").alias("ch"), "value")


def src18(spark, d):
    return X.wave(spark, d).groupBy("utt").agg(F.max(F.size("x")).cast("long").alias("samples"), F.round(F.max(F.size("x")) / X.SR, 6).alias("seconds"))


def src20(spark, d):
    r = X.read(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("room"))
    spk = F.array(*(F.struct(F.array(F.lit(1.0), F.col("room") * 0.5).alias("pos"), (F.col("room") * 30.0 + k).alias("doa"), F.lit(1.5).alias("dst"), F.format_string("spk%d.wav", F.lit(k)).alias("loc")) for k in (1, 2)))
    full = r.select("room", F.lit(0.4).alias("beta"), F.array(F.array(F.lit(0.0)), F.array(F.lit(0.1))).alias("receiver_location"), F.array(F.lit(5.0)).alias("room_size"), F.array(F.lit(0.0)).alias("receiver_geometric"), spk.alias("spk"))
    text = full.select("room", F.to_json(F.struct("beta", "receiver_location", "room_size", "receiver_geometric", "spk")).alias("value"))
    return T.room_speakers(text)


def snk08(spark, d):
    return K.report_lines(X.rows(spark, d).groupBy("utt").agg(F.avg("x").alias("m")), "utt", F.round("m", 3))


def snk09(spark, d):
    docs, done = X.read(spark, d, "documents").select(F.col("doc_id").alias("utt")), X.read(spark, d, "labels").select(F.col("doc_id").alias("utt"))
    return K.unwritten(docs, done, "utt")


def viz05(spark, d):
    """A wide matrix in panels of 16 columns, log10, by its largest value."""
    x = X.samples(spark, d)
    return x.select("utt", "ch", F.floor(F.col("n") / 16).alias("panel"), (F.col("n") % 16).alias("f"), F.round(F.log10(F.abs("x") + 1e-6), 6).alias("x"))


V = f"WITH {SAMPLES} "
QUERIES = {
    "st01_tumbling_stream": (st01, "SELECT epoch(date_trunc('day', ts))::BIGINT AS at, count(*) AS n, round(sum(value), 4) + 0.0 AS x FROM events GROUP BY 1"),
    "st02_hopping_stream": (st02, "SELECT epoch(date_trunc('day', ts) - to_days(k::INT))::BIGINT AS at, count(*) AS n, round(sum(value), 4) + 0.0 AS x FROM events, range(2) r(k) GROUP BY 1"),
    "st03_forgetting_stream": (st03, f"WITH {SERIES} SELECT a.key, a.t, {r6('sum(CASE WHEN b.t = 0 THEN b.x ELSE (1 - 0.73519) * b.x END * 0.73519 ** (a.t - b.t))')} AS s FROM series a JOIN series b ON a.key = b.key AND b.t <= a.t GROUP BY a.key, a.t"),
    "st03_covariance_stream": (st03_covariances, estimates.QUERIES["bf11_online_covariance"][1]),
    "st04_noise_stream": (st04, TRACKED),
    "st05_segment_stream": (st05, SEGMENTS),
    "st05_sessions": (st05_sessions, "SELECT user_id, floor(min(epoch(ts)))::BIGINT AS at, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, g"),
    "src02_script": (src02, "SELECT page_id::VARCHAR AS key, url AS value FROM pages"),
    "src03_script_tokens": (src03, "SELECT page_id::VARCHAR AS key, 3::BIGINT AS n, url AS last FROM pages"),
    "src07_segments": (src07, f"{V} SELECT seg, utt, ch, count(*) AS n, {r6('sum(x)')} AS x FROM samples JOIN (VALUES (0::BIGINT, 0, 16), (1::BIGINT, 16, 40)) c(seg, b, e) ON n >= b AND n < e GROUP BY ALL"),
    "src08_npy_round_trip": (src08, f"{V} SELECT utt * 4 + ch AS utt, count(*) AS n, {r6('sum(x)')} AS x FROM samples GROUP BY ALL"),
    "src11_raw_binary": (src11, f"{V} SELECT utt * 4 + ch AS utt, {r6('sum(x)')} AS x FROM samples GROUP BY ALL"),
    "src13_decompression": (src13, f"SELECT k, {r6('CASE WHEN u <= 64 THEN -1+1.5*u/64 WHEN u <= 192 THEN 0.5+1.5*(u-64)/128 ELSE 2.0+5.0*(u-192)/63 END')} AS x FROM (SELECT p_partkey AS k, p_partkey*37%256 AS u FROM part)"),
    "src14_wave_round_trip": (src14, f"{V} SELECT utt, ch, n, least(greatest(round_even(x*32768, 0), -32768), 32767)::BIGINT AS x FROM samples"),
    "src16_channel_scripts": (src16, "WITH c AS (SELECT doc_id AS key, k AS ch, source AS value FROM documents, range(3) r(k) WHERE doc_id % (k + 2) = 0) SELECT * FROM c WHERE key IN (SELECT key FROM c GROUP BY key HAVING count(*) > 1)"),
    "src18_durations": (src18, f"{V} SELECT utt, max(n) + 1 AS samples, {r6('(max(n) + 1) / 16000')} AS seconds FROM samples GROUP BY utt"),
    "src20_room_json": (src20, "SELECT r_regionkey::BIGINT AS room, 0.4::DOUBLE AS beta, 2::BIGINT AS mics, k AS src, 'spk' || (k + 1) || '.wav' AS loc, (r_regionkey * 30 + k + 1)::DOUBLE AS doa, 1.5::DOUBLE AS dst FROM region, range(2) x(k)"),
    "snk08_report_lines": (snk08, "SELECT l_orderkey || chr(9) || printf('%.3f', round(avg(l_quantity), 3)) AS value FROM lineitem GROUP BY l_orderkey"),
    "snk09_unwritten": (snk09, "SELECT doc_id AS utt FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"),
    "viz05_panels": (viz05, f"{V} SELECT utt, ch, n // 16 AS panel, n % 16 AS f, {r6('log10(abs(x)+1e-6)')} AS x FROM samples"),
}
