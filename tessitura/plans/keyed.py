"""Queries of windows, keyed collections, reports and sets."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import signal as S
from ..operators import relational as R
from ..operators import scans as C
from ..operators import windows as W
from . import fixtures as X
from .fixtures import ROWS, SAMPLES, SERIES, r6

WS = f"WITH {SERIES} "


def s(spark, d):
    return X.series(spark, d).select("key", "t", "x", "kind")


def flags(spark, d):
    return s(spark, d).withColumn("active", F.col("kind").isin("click", "purchase"))


def exploded(df, keys, *arrays, rounded=lambda c: F.round(c, 6)):
    return df.select(*keys, F.posexplode(F.arrays_zip(*arrays)).alias("t", "z")).select(*keys, F.col("t").cast("long").alias("t"), *(rounded(F.col(f"z.{a}")).alias(a) for a in arrays))


def scaled_round(c):
    """Rounded to six places in binary, as SQL does it here: folds of short decimal numbers end in exact ties."""
    return F.round(c * 1e6) / 1e6


def win01(spark, d):
    return W.taps(s(spark, d).drop("kind"), ["key"], 3, 2)


def win02(spark, d):
    x = s(spark, d)
    return x.select("key", "t", F.round(W.moving_average(x, ["key"], 2, floor=1e-6), 6).alias("m"))


def win03(spark, d):
    return W.clamped_average(s(spark, d), ["key"], 2).select("key", "t", F.round("s", 6).alias("m"))


def win04(spark, d):
    return C.along(s(spark, d), ["key"], C.Exponential(0.73519)).select("key", "t", F.round("s", 6).alias("s"))


def win05(spark, d):
    return C.along(s(spark, d), ["key"], C.Tracking(0.7, 4.0)).select("key", "t", scaled_round(F.col("s")).alias("s"))


def win06(spark, d):
    return W.running_minimum(s(spark, d), ["key"], 5, 3).select("key", "t", "low")


def win08(spark, d):
    x = X.samples(spark, d).withColumnRenamed("n", "f")
    return W.neighbours(x, ["utt", "ch"], [0.25, 0.5, 0.25]).select("utt", "ch", "f", F.round("s", 6).alias("m"))


def win09(spark, d):
    n = F.count("*").over(Window.partitionBy("key"))
    b = s(spark, d).withColumn("block", W.tumbling(F.col("t"), 10)).withColumn("merged", W.tumbling_merged(F.col("t"), n, 10))
    return b.groupBy("key", "block", "merged").agg(F.count("*").alias("n"), F.round(F.avg("x"), 6).alias("m"))


def win10(spark, d):
    return W.hopping(s(spark, d), 8, 5).groupBy("key", "chunk").agg(F.count("*").alias("n"), F.min("t").alias("lo"), F.max("t").alias("hi"))


def win11(spark, d):
    return W.hysteresis(flags(spark, d), ["key"], 3)


def win11_islands(spark, d):
    return W.islands(flags(spark, d), ["key"], F.col("active"))


def win12(spark, d):
    return W.gaps(win11_islands(spark, d), ["key"])


def win13(spark, d):
    g = win11_islands(spark, d).withColumn("end", F.col("end") + 1)
    return W.within(s(spark, d), g, ["key"]).groupBy("key", "beg", "end").agg(F.round(F.sum("x"), 6).alias("x"), F.count("*").alias("n"))


def win14(spark, d):
    w = X.wave(spark, d).select("utt", "ch", W.repeated_to(F.col("x"), 150).alias("x"))
    return exploded(w, ["utt", "ch"], "x")


def docs(spark, d):
    return X.read(spark, d, "documents").select(F.col("doc_id").alias("utt"), "lang", F.col("n_chars").cast("double").alias("x"))


def labels(spark, d):
    return X.read(spark, d, "labels").select(F.col("doc_id").alias("utt"), F.col("quality").cast("long").alias("q"))


def rel01(spark, d):
    return R.ordinal(docs(spark, d), "utt").select("utt", "pos", "x")


def rel02(spark, d):
    return R.sample_keys(docs(spark, d), "utt", 20).select("utt")


def rel03(spark, d):
    return docs(spark, d).join(labels(spark, d), "utt").select("utt", "lang", "x", "q")


def rel03_report(spark, d):
    return R.join_report(docs(spark, d), labels(spark, d), "utt")


def rel04(spark, d):
    return R.strict_join(labels(spark, d), docs(spark, d), "utt").select("utt", "q", "x")


def rel05(spark, d):
    a, b, c = docs(spark, d), labels(spark, d), docs(spark, d).where("lang <> 'en'")
    return R.common_keys([a, b, c], "utt")


def rel06(spark, d):
    a = docs(spark, d)
    return R.semi(a, labels(spark, d), "utt").select("utt", F.lit("in").alias("side")).unionByName(R.semi(a, labels(spark, d), "utt", exclude=True).select("utt", F.lit("out").alias("side")))


def rel08(spark, d):
    return R.chunked(docs(spark, d).select("utt"), "utt", 7)


def rel09(spark, d):
    return R.chunked_by_speaker(X.speakers(spark, d).select("utt", "spk"), "spk", 3)


def rel10(spark, d):
    a = docs(spark, d).select("utt", "lang")
    parts = [a.where(F.col("lang") == x) for x in ("de", "en", "es", "fr")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy("utt")


def rel11(spark, d):
    return R.stacked(X.rows(spark, d).withColumn("t", F.col("t") - 1), ["utt"]).select("utt", "t", "row", "x")


def rel12(spark, d):
    x = X.samples(spark, d).withColumnRenamed("n", "f")
    return R.beside([x.where(f"ch = {c}").select("utt", "f", F.round("x", 6).alias("x")) for c in range(3)], 64)


def rel13(spark, d):
    gain = spark.createDataFrame([(c, 1.0 / (c + 1)) for c in range(4)], "ch long, g double")
    return X.samples(spark, d).join(F.broadcast(gain), "ch").select("utt", "ch", "n", F.round(F.col("x") * F.col("g"), 6).alias("x"))


def rel15(spark, d):
    p = R.microphone_pairs(X.samples(spark, d), ["utt", "n"], ["x"])
    return p.groupBy("utt", "i", "j").agg(F.round(F.sum(F.col("x1") * F.col("x2")), 6).alias("xx"))


def rel16(spark, d):
    a = docs(spark, d).select("utt")
    m = labels(spark, d).select("utt", (F.col("q") * 90.0).alias("doa"))
    return R.lookup(a, m, "utt", "doa", 45.0)


def rel17(spark, d):
    x = X.read(spark, d, "part").select(F.col("p_partkey").alias("k"), (F.col("p_size") * 9.0 - 20).alias("doa"))
    return x.select("k", S.valid_doa(F.col("doa"), "linear").alias("linear"), S.valid_doa(F.col("doa"), "circular").alias("circular"))


def rel18(spark, d):
    v = X.speakers(spark, d)
    lists = v.groupBy("spk").agg(F.collect_list("utt").alias("utts"))
    one = lists.select("spk", F.explode("utts").alias("utt")).join(v.select("utt", "v"), "utt")
    return one.groupBy("spk").agg(F.count("*").alias("n"), F.round(F.sum(F.element_at("v", 1)), 6).alias("s"))


def rel20(spark, d):
    x = X.samples(spark, d).select("utt", F.col("ch").alias("i"), F.col("n").alias("j"), F.round("x", 6).alias("re"), F.round(-F.col("x"), 6).alias("im"))
    return R.transposed(x, hermitian=True).select("utt", "i", "j", "re", "im")


def rel21(spark, d):
    return X.samples(spark, d).where("n BETWEEN 10 AND 19 AND ch < 2").select("utt", "ch", (F.col("n") - 10).alias("n"), F.round("x", 6).alias("x"))


def rel22(spark, d):
    a = X.wave(spark, d)
    x, y = a.where("ch = 0").select("utt", F.posexplode(F.slice("x", 1, 40)).alias("n", "x")), a.where("ch = 1").select("utt", F.posexplode("x").alias("n", "y"))
    return x.join(y, ["utt", "n"]).groupBy("utt").agg(F.count("*").alias("n"), F.round(F.sum(F.col("x") * F.col("y")), 6).alias("xy"))


def agg01(spark, d):
    x = X.samples(spark, d)
    return x.groupBy("utt").agg(F.round(F.max(F.abs("x")), 6).alias("maxabs"), (F.max("n") + 1).alias("nsamps"), F.round((F.max("n") + 1) / X.SR, 6).alias("duration"), F.round(F.avg(F.when(F.col("ch") == 0, F.col("x") * F.col("x"))), 6).alias("power"))


def agg02(spark, d):
    p = X.samples(spark, d).groupBy("utt").agg(S.decibel(F.avg(F.col("x") * F.col("x"))).alias("db"))
    r = p.rollup("utt").agg(F.avg("db").alias("m"), F.min("db").alias("lo"), F.max("db").alias("hi"))
    return r.select(F.coalesce("utt", F.lit(-1).cast("long")).alias("utt"), *(F.round(c, 6).alias(c) for c in ("m", "lo", "hi")))


def agg03(spark, d):
    x = X.rows(spark, d)
    last = F.max_by("x", F.struct("t", "x"))
    return x.groupBy("utt").agg(F.round(F.avg("x"), 6).alias("mean"), F.sum("x").alias("total"), F.max(F.when(F.col("t") == 1, F.col("x"))).alias("first"), last.alias("last"))


def agg04(spark, d):
    a = docs(spark, d).join(labels(spark, d).select("utt", F.col("q").cast("string").alias("cls")), "utt", "left")
    return R.class_report(a, "cls", F.col("x")).select("cls", "n", F.round("mean", 6).alias("mean"))


def agg06(spark, d):
    v = X.speakers(spark, d)
    size = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, z: a + z * z))
    x = v.withColumn("size", size).select("spk", F.posexplode(F.transform("v", lambda z: z / F.col("size"))).alias("i", "x"))
    return x.groupBy("spk", F.col("i").cast("long").alias("i")).agg(F.round(F.avg("x"), 6).alias("m"))


def agg07(spark, d):
    w = Window.partitionBy("utt", "ch")
    x = X.samples(spark, d)
    return x.select("utt", "ch", "n", F.round((F.col("x") - F.avg("x").over(w)) / F.stddev_pop("x").over(w), 6).alias("x"))


def agg09(spark, d):
    x = X.samples(spark, d)
    return x.select("utt", "ch", "n", *(F.round(F.col("x") / F.max(F.abs("x")).over(Window.partitionBy(*k)), 6).alias(n) for n, k in (("whole", ["utt"]), ("by_row", ["utt", "ch"]), ("by_column", ["utt", "n"]))))


def agg12(spark, d):
    v = X.speakers(spark, d)
    m = v.groupBy("spk").agg(F.transform(F.array_sort(F.collect_list(F.struct("utt", F.element_at("v", 1).alias("x")))), lambda z: z["x"]).alias("m"))
    return m.select("spk", F.size("m").cast("long").alias("n"), F.round(F.element_at("m", 1), 6).alias("first"), F.round(F.element_at("m", -1), 6).alias("last"))


def agg14(spark, d):
    x = X.samples(spark, d)
    return x.groupBy("utt").agg(F.round(F.sum("x"), 6).alias("total"), F.round(F.sum(F.when(F.col("ch") == F.col("n"), F.col("x")).otherwise(0.0)), 6).alias("trace"), F.count_if(F.isnan("x")).alias("nans"))


def top04(spark, d):
    return X.rows(spark, d).orderBy("utt", "t").limit(25)


def top01(spark, d):
    return R.first_best(X.rows(spark, d), ["utt"], "x", "t").select("utt", "t", "x")


def set02(spark, d):
    return docs(spark, d).select("utt").intersect(labels(spark, d).select("utt"))


def set03(spark, d):
    return docs(spark, d).select("utt").exceptAll(labels(spark, d).select("utt"))


def set04(spark, d):
    a, b = docs(spark, d).agg(F.count("*").alias("a")), labels(spark, d).agg(F.countDistinct("utt").alias("b"))
    return a.join(b).select("a", "b", (F.col("a") == F.col("b")).alias("same"))


def fn_scalar(spark, d):
    x = s(spark, d)
    v = F.col("x")
    return x.select("key", "t", F.round(S.sigmoid(v, 0.02, 200.0), 6).alias("sigmoid"), F.round(S.compressed(v), 6).alias("compressed"), F.round(S.wrapped(v), 6).alias("wrapped"), F.round(S.decibel(v), 6).alias("db"), F.round(S.floored_log(v), 6).alias("ln"), S.next_power(v + 2).alias("pow2"), F.round(S.sinc(v / 100), 6).alias("sinc"), F.round(S.snr_gain(v, v + 1, F.lit(5.0)), 6).alias("gain"), S.milliseconds(v, 16000).alias("samples"))


def fn_complex(spark, d):
    p = X.samples(spark, d)
    a, b = p.where("ch < 2").groupBy("utt", "n").pivot("ch", [0, 1]).agg(F.first("x")).toDF("utt", "n", "are", "aim"), p.where("ch > 1").groupBy("utt", "n").pivot("ch", [2, 3]).agg(F.first("x")).toDF("utt", "n", "bre", "bim")
    x = a.join(b, ["utt", "n"])
    u, v = S.Complex(F.col("are"), F.col("aim")), S.Complex(F.col("bre"), F.col("bim"))
    out = {"abs": u.abs(), "angle": u.angle(), "mul_re": (u * v.conj()).re, "mul_im": (u * v.conj()).im, "div_re": u.divided(v, S.EPSILON).re, "div_im": u.divided(v, S.EPSILON).im, "exp_re": S.cis(u.re).re, "polar_im": S.polar(u.abs(), v.angle()).im}
    return x.select("utt", "n", *(F.round(c, 6).alias(k) for k, c in out.items()))


def fn_strings(spark, d):
    p = X.read(spark, d, "pages")
    return p.select("page_id", S.file_key(F.element_at(F.split("url", "[?#]"), 1)).alias("stem"), F.size(S.numbers(F.lit("0,0.2,0.4,0.8"))).cast("long").alias("n"), F.element_at(S.pairs(F.lit("0,3;1,4;2,5")), 2)["j"].cast("long").alias("j"))


def fn_rooms(spark, d):
    p = X.read(spark, d, "part").select(F.col("p_partkey").alias("k"), (F.col("p_size") / 10 + 3).alias("x"), (F.col("p_retailprice") % 5 + 3).alias("y"))
    rt = S.sabine_rt60(F.col("x"), F.col("y"), F.lit(3.0), F.lit(0.4))
    return p.select("k", F.round(rt, 6).alias("rt60"), F.round(S.absorption_for(F.col("x"), F.col("y"), F.lit(3.0), F.lit(0.4)), 6).alias("absorption"), F.round(S.directivity(F.col("x"), F.col("y"), F.lit(1.0), "cardioid", 0.5, 0.1), 6).alias("gain"), F.round(S.circular_delay(F.col("x") * 10, F.lit(2), 6, 0.07) * 1e6, 6).alias("delay"))


DL = "WITH a AS (SELECT doc_id AS utt, lang, n_chars::DOUBLE AS x FROM documents), b AS (SELECT doc_id AS utt, quality::BIGINT AS q FROM labels)"
V = f"WITH {SAMPLES} "
ISL = f"{WS}, isl AS (SELECT key, min(t) AS beg, max(t) AS \"end\" FROM (SELECT *, t - row_number() OVER (PARTITION BY key ORDER BY t) AS g FROM series WHERE kind IN ('click', 'purchase')) GROUP BY key, g)"
#: Folds as recursive queries: a step a frame, all keys at once.
TRACKED = f"""WITH RECURSIVE {SERIES.replace(' AS (', ' AS MATERIALIZED (', 1)}, r AS (SELECT key, t, x AS s FROM series WHERE t = 0 UNION ALL SELECT n.key, n.t, CASE WHEN n.x > r.s THEN up * r.s + (1 - up) * n.x ELSE down * r.s + (1 - down) * n.x END
  FROM r CROSS JOIN (SELECT 0.7::DOUBLE AS down, 1 - (1 - 0.7::DOUBLE) / 4 AS up) k JOIN series n ON n.key = r.key AND n.t = r.t + 1) SELECT key, t, {r6('s')} AS s FROM r"""
SEGMENTS = f"""WITH RECURSIVE {SERIES.replace(' AS (', ' AS MATERIALIZED (', 1)}, a AS MATERIALIZED (SELECT key, t, kind IN ('click', 'purchase') AS active FROM series),
r AS (SELECT key, -1::BIGINT AS t, 0 AS c, -1::BIGINT AS opened, -1::BIGINT AS beg FROM a WHERE t = 0 UNION ALL
  SELECT key, t, CASE WHEN opened >= 0 AND d <= 0 THEN 0 ELSE d END, CASE WHEN opened < 0 AND d >= 3 THEN greatest(t - 3, 0) WHEN opened >= 0 AND d <= 0 THEN -1 ELSE opened END, CASE WHEN opened >= 0 AND d <= 0 THEN opened ELSE -1 END
  FROM (SELECT n.key, n.t, r.opened, CASE WHEN n.active THEN least(r.c + 1, 3) WHEN r.opened >= 0 THEN r.c - 1 ELSE r.c END AS d FROM r JOIN a n ON n.key = r.key AND n.t = r.t + 1))
SELECT key, beg, t AS "end" FROM r WHERE beg >= 0 UNION ALL SELECT key, opened, t FROM r WHERE opened >= 0 AND (key, t) IN (SELECT key, max(t) FROM a GROUP BY key)"""
QUERIES = {
    "win01_taps": (win01, WS + "SELECT key, t, x, " + ", ".join(f"lag(x, {2 + k}, 0) OVER (PARTITION BY key ORDER BY t) AS tap{k}" for k in range(3)) + " FROM series"),
    "win02_moving_average": (win02, f"{WS} SELECT key, t, {r6('greatest(avg(x) OVER (PARTITION BY key ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 1e-6)')} AS m FROM series"),
    "win03_clamped_average": (win03, f"{WS}, n AS (SELECT key, max(t) AS last FROM series GROUP BY key) SELECT s.key, s.t, {r6('sum(o.x) / 5')} AS m FROM series s JOIN n USING (key), range(-2, 3) r(c), series o WHERE o.key = s.key AND o.t = least(greatest(s.t + c, 0), last) GROUP BY s.key, s.t"),
    "win04_exponential_smoothing": (win04, f"{WS} SELECT a.key, a.t, {r6('sum(CASE WHEN b.t = 0 THEN b.x ELSE (1 - 0.73519) * b.x END * 0.73519 ** (a.t - b.t))')} AS s FROM series a JOIN series b ON a.key = b.key AND b.t <= a.t GROUP BY a.key, a.t"),
    "win05_noise_tracking": (win05, TRACKED),
    "win06_running_minimum": (win06, f"{WS} SELECT a.key, a.t, min(b.x) AS low FROM series a JOIN series b ON a.key = b.key AND b.t <= a.t AND b.t // 5 > a.t // 5 - 3 GROUP BY a.key, a.t"),
    "win08_frequency_smoothing": (win08, f"{V} SELECT utt, ch, n AS f, {r6('0.5*x + 0.25*(lag(x, 1, 0) OVER w + lead(x, 1, 0) OVER w)')} AS m FROM samples WINDOW w AS (PARTITION BY utt, ch ORDER BY n)"),
    "win09_tumbling_blocks": (win09, f"{WS}, b AS (SELECT *, t // 10 AS block, least(t // 10, greatest(count(*) OVER (PARTITION BY key) // 10 - 1, 0)) AS merged FROM series) SELECT key, block, merged, count(*) AS n, {r6('avg(x)')} AS m FROM b GROUP BY key, block, merged"),
    "win10_hopping_lookback": (win10, f"{WS}, c AS (SELECT key, unnest(range(max(t) // 8 + 1)) AS chunk FROM series GROUP BY key) SELECT key, chunk, count(*) AS n, min(t) AS lo, max(t) AS hi FROM c JOIN series s USING (key) WHERE t >= greatest(chunk * 8 - 5, 0) AND t < chunk * 8 + 8 GROUP BY key, chunk"),
    "win11_hysteresis_segments": (win11, SEGMENTS),
    "win11_islands": (win11_islands, f"{ISL} SELECT * FROM isl"),
    "win12_gaps": (win12, f"{ISL}, g AS (SELECT key, lag(\"end\", 1, 0) OVER (PARTITION BY key ORDER BY beg) AS b, beg AS e FROM isl) SELECT key, b AS beg, e AS \"end\" FROM g WHERE b < e"),
    "win13_segment_frames": (win13, f"{ISL} SELECT s.key, beg, \"end\" + 1 AS \"end\", {r6('sum(x)')} AS x, count(*) AS n FROM series s JOIN isl g ON s.key = g.key AND t BETWEEN beg AND \"end\" GROUP BY ALL"),
    "win14_repeat_pad": (win14, f"{V} SELECT utt, ch, t, {r6('x')} AS x FROM samples JOIN range(150) r(t) ON n = t % 64"),
    "rel01_ordinal_lookup": (rel01, f"{DL} SELECT utt, row_number() OVER (ORDER BY utt) - 1 AS pos, x FROM a"),
    "rel02_sample_keys": (rel02, None),
    "rel03_inner_join": (rel03, f"{DL} SELECT utt, lang, x, q FROM a JOIN b USING (utt)"),
    "rel03_skip_report": (rel03_report, f"{DL} SELECT count(b.utt) AS done, count(*) - count(b.utt) AS skipped FROM a LEFT JOIN b USING (utt)"),
    "rel04_strict_join": (rel04, f"{DL} SELECT utt, q, x FROM b JOIN a USING (utt)"),
    "rel05_common_keys": (rel05, f"{DL} SELECT utt FROM a WHERE lang <> 'en' AND utt IN (SELECT utt FROM b)"),
    "rel06_filter_by_ids": (rel06, f"{DL} SELECT utt, CASE WHEN utt IN (SELECT utt FROM b) THEN 'in' ELSE 'out' END AS side FROM a"),
    "rel08_equal_chunks": (rel08, f"{DL} SELECT utt, ntile(7) OVER (ORDER BY utt) AS chunk FROM a"),
    "rel09_speaker_chunks": (rel09, "WITH s AS (SELECT label::BIGINT AS spk, count(*) AS n FROM embeddings GROUP BY 1), e AS (SELECT *, sum(n) OVER (ORDER BY spk) AS e, sum(n) OVER () AS total FROM s) SELECT v.vec_id AS utt, spk, least(floor((e - n / 2) * 3 / total), 2)::BIGINT + 1 AS chunk FROM embeddings v JOIN e ON v.label = e.spk"),
    "rel10_union_sorted": (rel10, f"{DL} SELECT utt, lang FROM a"),
    "rel11_vertical_stack": (rel11, f"WITH {ROWS} SELECT utt, t - 1 AS t, row_number() OVER (ORDER BY utt, t) - 1 AS row, x FROM rows_"),
    "rel12_horizontal_stack": (rel12, f"{V} SELECT utt, n + ch * 64 AS f, {r6('x')} AS x FROM samples WHERE ch < 3"),
    "rel13_broadcast_constant": (rel13, f"{V} SELECT utt, ch, n, {r6('x / (ch + 1)')} AS x FROM samples"),
    "rel15_channel_pairs": (rel15, f"{V} SELECT a.utt, a.ch AS i, b.ch AS j, {r6('sum(a.x*b.x)')} AS xx FROM samples a JOIN samples b ON a.utt = b.utt AND a.n = b.n AND a.ch < b.ch GROUP BY ALL"),
    "rel16_map_lookup": (rel16, f"{DL} SELECT utt, coalesce(q * 90.0, 45.0)::DOUBLE AS doa FROM a LEFT JOIN b USING (utt)"),
    "rel17_doa_validity": (rel17, "SELECT p_partkey AS k, p_size * 9.0 - 20 BETWEEN 0 AND 180 AS linear, p_size * 9.0 - 20 >= 0 AND p_size * 9.0 - 20 < 360 AS circular FROM part"),
    "rel18_speaker_lists": (rel18, f"SELECT label::BIGINT AS spk, count(*) AS n, {r6('sum(embedding[1]::DOUBLE)')} AS s FROM embeddings GROUP BY 1"),
    "rel20_hermitian": (rel20, f"{V} SELECT utt, n AS i, ch AS j, {r6('x')} AS re, {r6('x')} AS im FROM samples"),
    "rel21_slices": (rel21, f"{V} SELECT utt, ch, n - 10 AS n, {r6('x')} AS x FROM samples WHERE n BETWEEN 10 AND 19 AND ch < 2"),
    "rel22_common_length": (rel22, f"{V} SELECT a.utt, count(*) AS n, {r6('sum(a.x*b.x)')} AS xy FROM samples a JOIN samples b ON a.utt = b.utt AND a.n = b.n AND a.ch = 0 AND b.ch = 1 WHERE a.n < 40 GROUP BY a.utt"),
    "agg01_wave_stats": (agg01, f"{V} SELECT utt, {r6('max(abs(x))')} AS maxabs, max(n) + 1 AS nsamps, {r6('(max(n) + 1) / 16000')} AS duration, {r6('avg(x*x) FILTER (ch = 0)')} AS power FROM samples GROUP BY utt"),
    "agg02_power_report": (agg02, f"{V}, p AS (SELECT utt, 10*log10(avg(x*x)+1e-5) AS db FROM samples GROUP BY utt) SELECT coalesce(utt, -1) AS utt, {r6('avg(db)')} AS m, {r6('min(db)')} AS lo, {r6('max(db)')} AS hi FROM p GROUP BY ROLLUP (utt)"),
    "agg03_rows_to_vector": (agg03, f"WITH {ROWS} SELECT utt, {r6('avg(x)')} AS mean, sum(x) AS total, max(x) FILTER (t = 1) AS first, arg_max(x, t) AS last FROM rows_ GROUP BY utt"),
    "agg04_class_report": (agg04, f"{DL}, c AS (SELECT x, coalesce(q::VARCHAR, 'NG') AS cls FROM a LEFT JOIN b USING (utt)) SELECT coalesce(cls, 'ALL') AS cls, count(*) AS n, {r6('avg(x)')} AS mean FROM c GROUP BY ROLLUP (cls)"),
    "agg06_centroids": (agg06, f"WITH {X.SPEAKERS} SELECT spk, i, {r6('avg(x / s)')} AS m FROM speakers JOIN (SELECT utt, sqrt(sum(x*x)) AS s FROM speakers GROUP BY utt) USING (utt) GROUP BY spk, i"),
    "agg07_cmvn": (agg07, f"{V} SELECT utt, ch, n, {r6('(x - avg(x) OVER w) / stddev_pop(x) OVER w')} AS x FROM samples WINDOW w AS (PARTITION BY utt, ch)"),
    "agg09_peak_normalisation": (agg09, f"{V} SELECT utt, ch, n, {r6('x / max(abs(x)) OVER (PARTITION BY utt)')} AS whole, {r6('x / max(abs(x)) OVER (PARTITION BY utt, ch)')} AS by_row, {r6('x / max(abs(x)) OVER (PARTITION BY utt, n)')} AS by_column FROM samples"),
    "agg12_stack": (agg12, f"SELECT label::BIGINT AS spk, count(*) AS n, {r6('arg_min(embedding[1]::DOUBLE, vec_id)')} AS first, {r6('arg_max(embedding[1]::DOUBLE, vec_id)')} AS last FROM embeddings GROUP BY 1"),
    "agg14_sum_trace_nan": (agg14, f"{V} SELECT utt, {r6('sum(x)')} AS total, {r6('coalesce(sum(x) FILTER (ch = n), 0)')} AS trace, count(*) FILTER (isnan(x)) AS nans FROM samples GROUP BY utt"),
    "top01_first_best": (top01, f"WITH {ROWS} SELECT utt, t, x FROM (SELECT *, row_number() OVER (PARTITION BY utt ORDER BY x DESC, t) AS r FROM rows_) WHERE r = 1"),
    "top04_first_rows": (top04, f"WITH {ROWS} SELECT utt, t, x FROM rows_ ORDER BY utt, t LIMIT 25"),
    "set02_intersect": (set02, f"{DL} SELECT utt FROM a INTERSECT SELECT utt FROM b"),
    "set03_except": (set03, f"{DL} SELECT utt FROM a EXCEPT ALL SELECT utt FROM b"),
    "set04_cardinality": (set04, f"{DL} SELECT x.a, y.b, x.a = y.b AS same FROM (SELECT count(*) AS a FROM a) x, (SELECT count(DISTINCT utt) AS b FROM b) y"),
    "fn_scalars": (fn_scalar, f"""{WS} SELECT key, t, {r6('1/(1+exp(-0.02*(x-200)))')} AS sigmoid, {r6('10*(1-exp(-0.1*x))/(1+exp(-0.1*x))')} AS compressed, {r6('x+pi()-floor((x+pi())/(2*pi()))*2*pi()-pi()')} AS wrapped, {r6('10*log10(x+1e-5)')} AS db,
      {r6('ln(greatest(x, 1.1920929e-07))')} AS ln, (2 ** ceil(log2(x+2)))::BIGINT AS pow2, {r6('CASE WHEN x = 0 THEN 1 ELSE sin(pi()*x/100)/(pi()*x/100) END')} AS sinc, {r6('sqrt((x+1)/(x*10**0.5+1.1920929e-07))')} AS gain, trunc(x*16000/1000)::BIGINT AS samples FROM series"""),
    "fn_complex": (fn_complex, f"""{V}, z AS (SELECT a.utt, a.n, a.x AS ar, b.x AS ai, c.x AS br, e.x AS bi FROM samples a, samples b, samples c, samples e WHERE a.utt=b.utt AND a.utt=c.utt AND a.utt=e.utt AND a.n=b.n AND a.n=c.n AND a.n=e.n AND a.ch=0 AND b.ch=1 AND c.ch=2 AND e.ch=3)
      SELECT utt, n, {r6('sqrt(ar*ar+ai*ai)')} AS abs, {r6('atan2(ai,ar)')} AS angle, {r6('ar*br+ai*bi')} AS mul_re, {r6('ai*br-ar*bi')} AS mul_im, {r6('(ar*br+ai*bi)/(br*br+bi*bi+1.1920929e-07)')} AS div_re, {r6('(ai*br-ar*bi)/(br*br+bi*bi+1.1920929e-07)')} AS div_im,
      {r6('cos(ar)')} AS exp_re, {r6('sqrt(ar*ar+ai*ai)*sin(atan2(bi,br))')} AS polar_im FROM z"""),
    "fn_strings": (fn_strings, "SELECT page_id, regexp_replace(split_part(regexp_extract(url, '^[^?#]*'), '/', -1), '\\.[^.]*$', '') AS stem, 4::BIGINT AS n, 4::BIGINT AS j FROM pages"),
    "fn_rooms": (fn_rooms, f"""SELECT p_partkey AS k, {r6('greatest(24*ln(10)*(x*y*3)/(343*2*(x*y+x*3+y*3)*0.4), 0.128)')} AS rt60, {r6('24*ln(10)*(x*y*3)/(343*2*(x*y+x*3+y*3)*0.4)')} AS absorption,
      {r6('0.5+0.5*(x*cos(0.5)*cos(0.1)+y*sin(0.5)*cos(0.1)+sin(0.1))/sqrt(x*x+y*y+1)')} AS gain, {r6('-cos(radians(x*10)-2*2*pi()/6)*0.07/343*1e6')} AS delay FROM (SELECT p_partkey, p_size/10+3 AS x, p_retailprice%5+3 AS y FROM part)"""),
}
