"""Inputs of the registered queries, derived from the driver's tables, each as a DataFrame and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: STFT geometry of the registered queries.
LEN, HOP, BINS = 16, 8, 9
TOPO = (0.0, 0.05, 0.1, 0.15)
SR, SPEED, ANGLES = 16000, 343.0, 19


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def wave(spark: SparkSession, d: str) -> DataFrame:
    """wave(utt, ch, x): four vectors are the channels of one utterance."""
    e = read(spark, d, "embeddings")
    return e.select(F.floor(F.col("vec_id") / 4).alias("utt"), (F.col("vec_id") % 4).alias("ch"), F.col("embedding").cast("array<double>").alias("x"))


def samples(spark: SparkSession, d: str) -> DataFrame:
    return wave(spark, d).select("utt", "ch", F.posexplode("x").alias("n", "x")).withColumn("n", F.col("n").cast("long"))


def pair(spark: SparkSession, d: str) -> DataFrame:
    """(utt, n, clean, noisy)."""
    s = wave(spark, d)
    a, b = s.where("ch = 0").select("utt", F.col("x").alias("a")), s.where("ch = 1").select("utt", F.col("x").alias("b"))
    return a.join(b, "utt").select("utt", "a", F.zip_with("a", "b", lambda p, q: p + 0.5 * q).alias("y"))


def series(spark: SparkSession, d: str) -> DataFrame:
    """(key, t, x, kind, ts) of events: t counts a user's events from 0."""
    e = read(spark, d, "events")
    return e.select(F.col("user_id").alias("key"), (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("long").alias("t"), F.col("value").alias("x"), F.col("event_type").alias("kind"), "ts")


def rows(spark: SparkSession, d: str) -> DataFrame:
    """(utt, t, x) of lineitem: t counts an order's lines from 1."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return read(spark, d, "lineitem").select(F.col("l_orderkey").alias("utt"), F.row_number().over(order).cast("long").alias("t"), F.col("l_quantity").alias("x"))


def speakers(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("utt"), F.col("label").cast("long").alias("spk"), F.col("embedding").cast("array<double>").alias("v"))


def transcripts(spark: SparkSession, d: str) -> DataFrame:
    """(utt, hyp, ref, cls): a turn against the next turn of its conversation, all tokens of each."""
    c = read(spark, d, "conversations")
    tokens = F.split(F.btrim("text"), "\\s+")
    a = c.select("conv_id", F.col("turn").alias("turn"), tokens.alias("hyp"), F.col("role").alias("cls"))
    b = c.select("conv_id", (F.col("turn") - 1).alias("turn"), tokens.alias("ref"))
    return a.join(b, ["conv_id", "turn"]).select("conv_id", "turn", "hyp", "ref", "cls")


SAMPLES = "samples AS (SELECT vec_id // 4 AS utt, vec_id % 4 AS ch, unnest(range(64)) AS n, unnest(embedding)::DOUBLE AS x FROM embeddings)"
PAIR = "pair AS (SELECT a.utt, a.n, a.x AS clean, a.x + 0.5 * b.x AS noisy FROM samples a JOIN samples b ON a.utt = b.utt AND a.n = b.n AND a.ch = 0 AND b.ch = 1)"
SERIES = "series AS (SELECT user_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t, value AS x, event_type AS kind, ts FROM events)"
ROWS = "rows_ AS (SELECT l_orderkey AS utt, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS t, l_quantity AS x FROM lineitem)"
SPEAKERS = "speakers AS (SELECT vec_id AS utt, label::BIGINT AS spk, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings)"


def stft_sql(source: str, keys: str, name: str, value: str = "x", window: str = f"(0.5 - 0.5 * cos(2 * pi() * k / {LEN}))") -> str:
    """A CTE (keys, t, f, re, im) of the frames of source(keys, n, value)."""
    return f"""{name} AS (SELECT {keys}, t, f, sum({value} * {window} * cos(2 * pi() * f * k / {LEN})) AS re, -sum({value} * {window} * sin(2 * pi() * f * k / {LEN})) AS im
  FROM (SELECT s.*, t, n - t * {HOP} AS k FROM {source} s, range(7) r(t) WHERE n >= t * {HOP} AND n < t * {HOP} + {LEN}) x, range({BINS}) b(f) GROUP BY {keys}, t, f)"""


STFT = stft_sql("samples", "utt, ch", "stft")
#: The steering grid of a linear array: (a, ch, f, deg, re, im).
GRID = f"""steer AS (SELECT a, ch, f, a * 180.0 / {ANGLES - 1} AS deg, cos(pi() * {SR} / {BINS - 1} * f * cos(radians(a * 180.0 / {ANGLES - 1})) * topo / {SPEED}) AS re,
  -sin(pi() * {SR} / {BINS - 1} * f * cos(radians(a * 180.0 / {ANGLES - 1})) * topo / {SPEED}) AS im
  FROM range({ANGLES}) x(a), range({BINS}) y(f), (VALUES (0, 0.0), (1, 0.05), (2, 0.1), (3, 0.15)) m(ch, topo))"""


def r6(x: str) -> str:
    """Rounded as both engines do, without a negative zero."""
    return f"(round({x}, 6) + 0.0)"
