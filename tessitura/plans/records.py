"""Queries of archives, extended-raw files and wave headers: written to the shared folder, read again, value by value."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import archive_source as S
from ..sources import archives as A
from ..sources import sinks as K
from ..sources import tables as T
from ..sources.places import scratch
from . import fixtures as X
from .fixtures import SAMPLES, STFT, r6
from .spectral import spec


def records(spark, d, rows=4):
    """(key, rows, cols, x): the vectors as 4 x 16 matrices, or as vectors for rows 0 and 1."""
    return X.wave(spark, d).select(F.format_string("%d-%d", "utt", "ch").alias("key"), F.lit(rows).alias("rows"), F.lit(64 // max(rows, 1)).alias("cols"), "x")


def values(df):
    """(key, n, x) of read records."""
    return df.select("key", F.posexplode("x").alias("n", "x")).select("key", F.col("n").cast("long").alias("n"), F.round("x", 6).alias("x"))


def src05(spark, d):
    folder = scratch(spark, "archives")
    A.write_archives(records(spark, d), folder, "FM")
    return values(A.read_whole(spark, folder))


def udf02(spark, d):
    """Written and read by the data source, by tasks of 4 kB each."""
    folder = scratch(spark, "archives")
    S.registered(spark)
    records(spark, d).write.format("archives").option("token", "DM").mode("append").save(folder)
    return values(S.read_split(spark, folder, 4096))


def src10(spark, d):
    return values(A.read_at(A.write_archives(records(spark, d, 1), scratch(spark, "archives"), "DV")))


def src12(spark, d):
    folder = scratch(spark, "raw")
    A.write_archives(records(spark, d), folder, "rawd")
    return values(A.read_whole(spark, folder, "raw"))


def snk05(spark, d):
    return values(A.read_at(A.write_archives(records(spark, d, 0), scratch(spark, "raw"), "rawf"), "raw"))


def src15(spark, d):
    """The same records by script and by archive, one doubled on the way."""
    folder = scratch(spark, "archives")
    A.write_archives(records(spark, d), folder, "DM")
    twice = A.table(spark, f"scp:{folder}/index", value=lambda x: F.transform(x, lambda v: 2 * v))
    return values(twice).withColumn("how", F.lit("scp")).unionByName(values(A.table(spark, f"ark:{folder}")).withColumn("how", F.lit("ark")))


def src17(spark, d):
    """Spectra as complex matrices, frames by bins."""
    z = F.array_sort(F.collect_list(F.struct("t", "f", "re", "im")))
    m = spec(spark, d).groupBy("utt", "ch").agg(z.alias("z"), (F.max("t") + 1).cast("int").alias("rows"), (F.max("f") + 1).cast("int").alias("cols"))
    m = m.select(F.format_string("%d-%d", "utt", "ch").alias("key"), "rows", "cols", F.flatten(F.transform("z", lambda x: F.array(x["re"], x["im"]))).alias("x"))
    back = A.read_at(A.write_archives(m, scratch(spark, "complex"), "DCM")).where("complex")
    n = F.floor(F.col("n") / 2)
    long = back.select("key", "cols", F.posexplode("x").alias("n", "x")).select("key", F.floor(n / F.col("cols")).alias("t"), (n % F.col("cols")).alias("f"), (F.col("n") % 2).alias("p"), "x")
    return long.groupBy("key", "t", "f").agg(F.round(F.max(F.when(F.col("p") == 0, F.col("x"))), 6).alias("re"), F.round(F.max(F.when(F.col("p") == 1, F.col("x"))), 6).alias("im"))


def snk10(spark, d):
    """Archive to array files, and those to an archive of doubles."""
    read = A.read_at(A.write_archives(records(spark, d, 1), scratch(spark, "archives"), "FM"))
    files = K.encode_arrays(read.select(F.col("key").alias("utt"), "x"), "float32")
    again = T.read_arrays(files.select(F.col("utt").alias("key"), F.lit("").alias("path"), "content"))
    return values(A.read_at(A.write_archives(again.select("key", "rows", "cols", "x"), scratch(spark, "archives"), "DM")))


def src18(spark, d):
    """Durations of wave files from their headers."""
    w = X.wave(spark, d).select(F.format_string("%d-%d", "utt", "ch").alias("utt"), F.slice("x", 1, (F.col("utt") % 60 + 1).cast("int")).alias("x"))
    h = A.wave_headers(K.export(K.encode_waves(w), scratch(spark, "waves"), "wav"))
    return h.select("key", F.col("sr").cast("long").alias("sr"), F.col("channels").cast("long").alias("channels"), "samples", F.round(F.col("samples") / F.col("sr"), 6).alias("seconds"))


def src06(spark, d):
    """Samples 10 to 29 of each wave file."""
    w = X.wave(spark, d).select(F.format_string("%d-%d", "utt", "ch").alias("utt"), "x")
    files = K.encode_waves(w).select(F.col("utt").alias("key"), F.lit("").alias("path"), "content")
    x = T.read_waves(files, 16000, beg=10, end=30).select("key", F.posexplode("x").alias("n", "x"))
    return x.select("key", F.col("n").cast("long").alias("n"), F.round(F.col("x") * 32768, 0).cast("long").alias("x"))


def src19(spark, d):
    """A script for each of four speakers; speaker k lacks every (k + 2)th utterance, so others than all are left out."""
    w = X.wave(spark, d)
    lines = [w.where((F.col("ch") == k) & (F.col("utt") % (k + 2) != 0)).select(F.format_string("u%d spk%d/u%d.wav", "utt", "ch", "utt").alias("value")) for k in range(4)]
    return T.speakers_of([T.parse_script(x) for x in lines])


def snk07(spark, d):
    return K.config_json(X.read(spark, d, "supplier"), "s_suppkey", "s_name", "s_nationkey")


V = f"WITH {SAMPLES}"
KEY = "utt || '-' || ch"
BACK = f"{V} SELECT {KEY} AS key, n, {r6('x')} AS x FROM samples"
QUERIES = {
    "src05_sequential_archives": (src05, BACK),
    "src10_random_access": (src10, BACK),
    "udf02_archive_source": (udf02, BACK),
    "src12_extended_raw": (src12, BACK),
    "snk05_extended_raw_vectors": (snk05, BACK),
    "src15_table_specifiers": (src15, f"{V} SELECT {KEY} AS key, n, {r6('x * k')} AS x, how FROM samples, (VALUES ('scp', 2), ('ark', 1)) v(how, k)"),
    "src17_complex_matrices": (src17, f"{V}, {STFT} SELECT {KEY} AS key, t, f, {r6('re')} AS re, {r6('im')} AS im FROM stft"),
    "snk10_conversions": (snk10, BACK),
    "src18_wave_headers": (src18, f"{V} SELECT {KEY} AS key, 16000::BIGINT AS sr, 1::BIGINT AS channels, count(*) AS samples, {r6('count(*) / 16000')} AS seconds FROM samples WHERE n <= utt % 60 GROUP BY utt, ch"),
    "src19_speaker_scripts": (src19, "SELECT 'u' || vec_id // 4 AS key, vec_id % 4 AS spk, 'spk' || vec_id % 4 || '/u' || vec_id // 4 || '.wav' AS value FROM embeddings WHERE (vec_id // 4) % 2 <> 0 AND (vec_id // 4) % 3 <> 0 AND (vec_id // 4) % 5 <> 0"),
    "snk07_config_json": (snk07, "SELECT to_json({'s_suppkey': s_suppkey, 's_name': s_name, 's_nationkey': s_nationkey})::VARCHAR AS value FROM supplier"),
    "src06_wave_range": (src06, f"{V} SELECT {KEY} AS key, n - 10 AS n, least(greatest(round_even(x*32768, 0), -32768), 32767)::BIGINT AS x FROM samples WHERE n BETWEEN 10 AND 29"),
}
