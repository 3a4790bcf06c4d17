"""Queries of transforms and masks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.signal import at, window_value
from ..operators import blocks as B
from ..operators import masks as M
from ..operators import transforms as T
from . import fixtures as X
from .fixtures import PAIR, SAMPLES, STFT, r6

C = T.StftConfig(X.LEN, X.HOP, center=False)
W = f"WITH {SAMPLES}, "


def rounded(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


def spec(spark, d):
    return T.stft(X.wave(spark, d), C)


def both(spark, d):
    """(utt, t, f, clean and noisy spectra)."""
    p = X.pair(spark, d)
    a = T.stft(p.select("utt", F.col("a").alias("x")), C).select("utt", "t", "f", F.col("re").alias("s_re"), F.col("im").alias("s_im"))
    b = T.stft(p.select("utt", F.col("y").alias("x")), C).select("utt", "t", "f", F.col("re").alias("y_re"), F.col("im").alias("y_im"))
    return a.join(b, ["utt", "t", "f"])


BOTH = W + PAIR + ", " + X.stft_sql("pair", "utt", "cs", "clean") + ", " + X.stft_sql("pair", "utt", "ns", "noisy") + """,
both_ AS (SELECT c.utt, c.t, c.f, c.re AS sr, c.im AS si, n.re AS yr, n.im AS yi, sqrt(c.re*c.re+c.im*c.im) AS s, sqrt(n.re*n.re+n.im*n.im) AS y,
  sqrt((n.re-c.re)*(n.re-c.re)+(n.im-c.im)*(n.im-c.im)) AS d, cos(atan2(c.im,c.re)-atan2(n.im,n.re)) AS turn FROM cs c JOIN ns n USING (utt, t, f))"""
EPS = "1.1920929e-07"


def tf01(spark, d):
    return rounded(spec(spark, d), "re", "im")


def tf01_blocks(spark, d):
    """The same from waves in blocks of 24 samples."""
    f = B.stft_frames(B.cut(X.wave(spark, d), ["utt", "ch"], 24), C, ["utt", "ch"], 24)
    return rounded(f.select("utt", "ch", "t", F.posexplode(F.arrays_zip("re", "im")).alias("f", "z")).select("utt", "ch", "t", F.col("f").cast("long").alias("f"), "z.re", "z.im"), "re", "im")


def tf04_blocks(spark, d):
    f = B.stft_frames(B.cut(X.wave(spark, d), ["utt", "ch"], 24), C, ["utt", "ch"], 24)
    x = B.istft_blocks(f, C, ["utt", "ch"], 40)
    return x.select("utt", "ch", "blk", F.posexplode("x").alias("n", "x")).select("utt", "ch", (F.col("blk") * 40 + F.col("n")).alias("n"), F.round("x", 6).alias("x"))


def tf01_hamming(spark, d):
    return rounded(T.stft(X.wave(spark, d), T.StftConfig(X.LEN, X.HOP, False, window="hamming", periodic=False, pad="zero")), "re", "im")


def tf03(spark, d):
    n = X.wave(spark, d).withColumn("n", F.size("x").cast("long"))
    return n.select("utt", "ch", (F.floor((F.col("n") - C.frame_len) / C.frame_hop) + 1).alias("frames"), ((F.floor((F.col("n") - C.frame_len) / C.frame_hop)) * C.frame_hop + C.frame_len).alias("samples"))


def tf04(spark, d):
    x = T.istft(spec(spark, d), C, ["utt", "ch"])
    return x.select("utt", "ch", F.posexplode("x").alias("n", "x")).select("utt", "ch", F.col("n").cast("long").alias("n"), F.round("x", 6).alias("x"))


def tf05(spark, d):
    """Waves scaled to a largest magnitude of their own, as 16-bit numbers."""
    s = spec(spark, d).where("ch = 0").withColumn("peak", (F.col("utt") % 5 + 1) / 8.0)
    x = T.istft(s, C, ["utt"], peak="peak").select("utt", F.posexplode("x").alias("n", "x"))
    return x.select("utt", F.col("n").cast("long").alias("n"), F.round("x", 6).alias("x"), F.round(F.col("x") * 32767, 0).cast("long").alias("pcm"))


def tf06(spark, d):
    s = spec(spark, d).where("ch = 0").drop("ch")
    m, p = T.spectrogram(s), T.spectrogram(s, power=True, log=True).withColumnRenamed("m", "logpow")
    return rounded(m.join(p, ["utt", "t", "f"]), "m", "logpow")


MEL = T.mel_weights(5, C, X.SR)


def tf07(spark, d):
    w = spark.createDataFrame(MEL, "b long, f long, w double")
    return rounded(T.fbank(T.spectrogram(spec(spark, d).where("ch = 0")), w, ["utt"], log=True), "m")


def tf08(spark, d):
    m = T.stft_frames(X.wave(spark, d).where("ch = 0").drop("ch"), C).select("utt", "t", F.zip_with("re", "im", lambda a, b: F.sqrt(a * a + b * b)).alias("m"))
    whole = m.groupBy("utt").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "m"))), lambda z: z["m"]).alias("m"))
    return T.griffin_lim(whole, C, ["utt"], rounds=5).select("utt", F.posexplode("x").alias("n", "x")).select("utt", F.col("n").cast("long").alias("n"), F.round("x", 4).alias("x"))


def tf09(spark, d):
    s = spec(spark, d)
    a = T.spectrogram(s.where("ch = 0")).drop("ch")
    return rounded(T.with_phase(a, s.where("ch = 1").drop("ch"), ["utt"]), "re", "im")


def tf10(spark, d):
    b = both(spark, d)
    m = b.select("utt", "t", "f", M.pair_mask(at("s_"), at("y_"), "irm").alias("m"))
    y = b.select("utt", "t", "f", F.col("y_re").alias("re"), F.col("y_im").alias("im"))
    x = T.istft(T.masked(y, m, ["utt"]), C, ["utt"])
    return x.select("utt", F.posexplode("x").alias("n", "x")).select("utt", F.col("n").cast("long").alias("n"), F.round("x", 6).alias("x"))


def tf11(spark, d):
    w = X.wave(spark, d)
    h = w.where("ch = 1").select("utt", F.col("x").alias("h"))
    x = w.where("ch = 0").join(h, "utt").select("utt", F.posexplode(T.convolved(F.col("x"), F.col("h"))).alias("n", "x"))
    return x.select("utt", F.col("n").cast("long").alias("n"), F.round("x", 6).alias("x"))


def tf12(spark, d):
    x = T.high_pass(X.wave(spark, d), X.SR)
    return x.select("utt", "ch", F.posexplode("x").alias("n", "x")).select("utt", "ch", F.col("n").cast("long").alias("n"), F.round("x", 6).alias("x"))


def fn20(spark, d):
    n = spark.range(X.LEN).select(F.col("id").alias("n"))
    return n.select("n", *(F.round(window_value(F.col("n"), X.LEN, k, p), 6).alias(k) for k, p in (("hann", True), ("hamming", False), ("blackman", False), ("rectangular", True), ("sqrthann", True))))


def msk01(spark, d):
    s, y = at("s_"), at("y_")
    return both(spark, d).select("utt", "t", "f", *(F.round(M.pair_mask(s, y, k), 6).alias(k) for k in ("ibm", "irm", "iam", "psm", "psa", "crm_re", "crm_im")))


def msk02(spark, d):
    m = both(spark, d).select("utt", M.pair_mask(at("s_"), at("y_"), "psm").alias("m"))
    return m.groupBy("utt").agg(F.count("*").alias("cells"), F.count_if((F.col("m") > 1) | (F.col("m") < 0)).alias("clipped"), F.round(F.avg(M.clipped(F.col("m"), 1.0)), 6).alias("mean"))


def msk03(spark, d):
    s, n = at("s_").abs(), (at("y_") - at("s_")).abs()
    return both(spark, d).select("utt", "t", "f", *(F.round(M.noise_mask(s, n, k), 6).alias(k) for k in ("irm_linear", "ibm", "wiener")))


def magnitudes(spark, d):
    return spec(spark, d).where("ch < 3").select("utt", F.col("ch").alias("spk"), "t", "f", at().abs().alias("m"))


def msk04(spark, d):
    return rounded(M.speaker_masks(magnitudes(spark, d), ["utt", "t", "f"]).drop("m"), "irm")


def msk04_mixture(spark, d):
    """All channels as speakers of their sum."""
    s = spec(spark, d).withColumnRenamed("ch", "spk")
    mix = s.groupBy("utt", "t", "f").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))
    return rounded(M.mixture_masks(s, mix, ["utt", "t", "f"]), "iam", "psm")


def msk06(spark, d):
    return M.cluster_labels(magnitudes(spark, d), ["utt"], beta=12.0)


def msk07(spark, d):
    return rounded(M.winner_takes_all(magnitudes(spark, d), ["utt", "t", "f"]), "m")


def msk08(spark, d):
    e = spec(spark, d).where("ch = 0").select("utt", "t", "f", F.round(at().abs(), 9).alias("e"))
    return M.energy_vad(e, ["utt"], 0.8)


def msk09(spark, d):
    s = spec(spark, d).where("ch = 0").drop("ch")
    m = s.select("utt", "t", "f", F.abs(F.sin(F.col("t") + 2 * F.col("f"))).alias("m"))
    return rounded(T.masked(s, m, ["utt"]), "re", "im")


def msk10(spark, d):
    m = magnitudes(spark, d)
    a, b = m.where("spk = 0").drop("spk"), m.where("spk = 1").drop("spk")
    scale = spark.range(5).select(F.col("id").alias("t"), (1.0 + F.col("id")).alias("s"))
    return rounded(M.scaled_rows(M.product(a, b, ["utt", "t", "f"]), scale, ["t"]), "m").select("utt", "t", "f", "m")


MAG = W + STFT + ", mag AS (SELECT utt, ch AS spk, t, f, sqrt(re*re+im*im) AS m FROM stft WHERE ch < 3)"
WHOLE = "(SELECT utt, {k} t * 8 + k AS n, sum({v}) AS num, sum(w*w) AS den FROM ({q}) GROUP BY ALL)"


def _overlap(source: str, keys: str) -> str:
    """Inverse DFT of source(keys, t, f, re, im), windowed and added."""
    return f"""SELECT {keys}, n, {r6('CASE WHEN den > 1e-10 THEN num / den ELSE 0 END')} AS x FROM (SELECT {keys}, t * {X.HOP} + k AS n, sum(y * w) AS num, sum(w * w) AS den FROM (
  SELECT {keys}, t, k, 0.5 - 0.5 * cos(2 * pi() * k / {X.LEN}) AS w, sum(CASE WHEN f = 0 OR f = {X.BINS - 1} THEN 1 ELSE 2 END * (re * cos(2 * pi() * f * k / {X.LEN}) - im * sin(2 * pi() * f * k / {X.LEN}))) / {X.LEN} AS y
  FROM {source}, range({X.LEN}) r(k) GROUP BY {keys}, t, k) GROUP BY {keys}, n)"""


_MEL = ", ".join(f"({b}, {f}, {w!r})" for b, f, w in MEL)
QUERIES = {
    "tf01_stft": (tf01, f"{W}{STFT} SELECT utt, ch, t, f, {r6('re')} AS re, {r6('im')} AS im FROM stft"),
    "tf02_stft_symmetric": (tf01_hamming, W + X.stft_sql("samples", "utt, ch", "stft", window=f"(0.54 - 0.46 * cos(2 * pi() * k / {X.LEN - 1}))") + f" SELECT utt, ch, t, f, {r6('re')} AS re, {r6('im')} AS im FROM stft"),
    "tf03_frame_counts": (tf03, f"{W} n AS (SELECT utt, ch, count(*) AS n FROM samples GROUP BY ALL) SELECT utt, ch, (n - {X.LEN}) // {X.HOP} + 1 AS frames, (n - {X.LEN}) // {X.HOP} * {X.HOP} + {X.LEN} AS samples FROM n"),
    "tf01_stft_blocks": (tf01_blocks, f"{W}{STFT} SELECT utt, ch, t, f, {r6('re')} AS re, {r6('im')} AS im FROM stft"),
    "tf04_istft_blocks": (tf04_blocks, f"{W}{STFT} " + _overlap("stft", "utt, ch")),
    "tf04_istft": (tf04, f"{W}{STFT} " + _overlap("stft", "utt, ch")),
    "tf05_renormalised": (tf05, f"{W}{STFT}, o AS ({_overlap('stft', 'utt, ch').replace('(round(', '((', 1).replace(', 6) + 0.0) AS x', ')) AS x', 1)}), p AS (SELECT utt, n, x * (utt % 5 + 1) / 8.0 / (max(abs(x)) OVER (PARTITION BY utt) + 1.1920929e-07) AS x FROM o WHERE ch = 0) SELECT utt, n, {r6('x')} AS x, round(x * 32767)::BIGINT AS pcm FROM p"),
    "tf06_spectrogram": (tf06, f"{W}{STFT} SELECT utt, t, f, {r6('sqrt(re*re+im*im)')} AS m, {r6(f'ln(greatest(re*re+im*im, {EPS}))')} AS logpow FROM stft WHERE ch = 0"),
    "tf07_fbank": (tf07, f"{W}{STFT} SELECT utt, t, b, {r6(f'ln(greatest(sum(w * sqrt(re*re+im*im)), {EPS}))')} AS m FROM stft JOIN (VALUES {_MEL}) x(b, f, w) USING (f) WHERE ch = 0 GROUP BY utt, t, b"),
    "tf08_griffin_lim": (tf08, None),
    "tf09_resynthesis_phase": (tf09, f"{W}{STFT} SELECT a.utt, a.t, a.f, {r6('sqrt(a.re*a.re+a.im*a.im)*cos(atan2(b.im,b.re))')} AS re, {r6('sqrt(a.re*a.re+a.im*a.im)*sin(atan2(b.im,b.re))')} AS im FROM stft a JOIN stft b ON a.utt = b.utt AND a.t = b.t AND a.f = b.f AND a.ch = 0 AND b.ch = 1"),
    "tf10_mask_separation": (tf10, f"{BOTH}, z AS (SELECT utt, t, f, s / sqrt(s*s + d*d + {EPS}) * yr AS re, s / sqrt(s*s + d*d + {EPS}) * yi AS im FROM both_) " + _overlap("z", "utt")),
    "tf11_convolution": (tf11, f"{W} h AS (SELECT utt, n AS k, x AS h FROM samples WHERE ch = 1) SELECT utt, n + k AS n, {r6('sum(x * h)')} AS x FROM samples JOIN h USING (utt) WHERE ch = 0 AND n + k < 64 GROUP BY utt, n + k"),
    "tf12_high_pass": (tf12, f"""WITH RECURSIVE {SAMPLES.replace(' AS (', ' AS MATERIALIZED (', 1)}, c AS (SELECT exp(-2 * pi() * 100 / 16000) AS p, cos(2 * pi() * 100 / 16000) AS q),
      r AS (SELECT utt, ch, -1::BIGINT AS n, 0::DOUBLE AS y, 0::DOUBLE AS u, 0::DOUBLE AS v FROM samples WHERE n = 0 UNION ALL SELECT utt, ch, n, w - (1 + p) * u + p * v, w, u
        FROM (SELECT s.utt, s.ch, s.n, s.x + 2 * p * q * r.u - p * p * r.v AS w, r.u, r.v, p FROM r JOIN samples s ON s.utt = r.utt AND s.ch = r.ch AND s.n = r.n + 1, c))
      SELECT utt, ch, n, {r6('y')} AS x FROM r WHERE n >= 0"""),
    "fn20_windows": (fn20, f"""SELECT n, {r6('0.5-0.5*cos(2*pi()*n/16)')} AS hann, {r6('0.54-0.46*cos(2*pi()*n/15)')} AS hamming, {r6('0.42-0.5*cos(2*pi()*n/15)+0.08*cos(4*pi()*n/15)')} AS blackman, 1.0::DOUBLE AS rectangular,
      {r6('sqrt(greatest(0.5-0.5*cos(2*pi()*n/16),0))')} AS sqrthann FROM range(16) r(n)"""),
    "msk01_pair_masks": (msk01, f"""{BOTH} SELECT utt, t, f, CASE WHEN s > d THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS ibm, {r6(f's/sqrt(s*s+d*d+{EPS})')} AS irm, {r6(f's/greatest(y,{EPS})')} AS iam, {r6(f's*turn/greatest(y,{EPS})')} AS psm,
      {r6(f's*greatest(turn,0)/greatest(y,{EPS})')} AS psa, {r6('sign(a)*10*(1-exp(-0.1*abs(a)))/(1+exp(-0.1*abs(a)))')} AS crm_re, {r6('sign(b)*10*(1-exp(-0.1*abs(b)))/(1+exp(-0.1*abs(b)))')} AS crm_im
      FROM (SELECT *, (sr*yr+si*yi)/(y*y+{EPS}) AS a, (si*yr-sr*yi)/(y*y+{EPS}) AS b FROM both_)"""),
    "msk02_clip_report": (msk02, f"{BOTH} SELECT utt, count(*) AS cells, count(*) FILTER (m > 1 OR m < 0) AS clipped, {r6('avg(greatest(least(m, 1), 0))')} AS mean FROM (SELECT utt, s*turn/greatest(y,{EPS}) AS m FROM both_) GROUP BY utt"),
    "msk03_noise_masks": (msk03, f"{BOTH} SELECT utt, t, f, {r6(f's/(s+d+{EPS})')} AS irm_linear, CASE WHEN s > d THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS ibm, {r6(f's*s/(s*s+d*d+{EPS})')} AS wiener FROM both_"),
    "msk04_speaker_masks": (msk04, f"{MAG} SELECT utt, spk, t, f, {r6(f'm/(sum(m) OVER w+{EPS})')} AS irm, CASE WHEN row_number() OVER (w ORDER BY m DESC, spk) = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS ibm FROM mag WINDOW w AS (PARTITION BY utt, t, f)"),
    "msk04_mixture_masks": (msk04_mixture, f"""{W}{STFT}, y AS (SELECT utt, t, f, sum(re) AS yr, sum(im) AS yi FROM stft GROUP BY ALL)
      SELECT utt, t, f, ch AS spk, {r6(f'sqrt(re*re+im*im)/(sqrt(yr*yr+yi*yi)+{EPS})')} AS iam, {r6(f'sqrt(re*re+im*im)/(sqrt(yr*yr+yi*yi)+{EPS})*cos(atan2(yi,yr)-atan2(im,re))')} AS psm FROM stft JOIN y USING (utt, t, f)"""),
    "msk06_cluster_labels": (msk06, f"{MAG}, c AS (SELECT utt, t, f, arg_max(spk, m) AS s, 20*log10(sum(m)+{EPS}) AS db FROM mag GROUP BY ALL) SELECT utt, t, f, CASE WHEN db < max(db) OVER (PARTITION BY utt) - 12 THEN -1 ELSE s END AS label FROM c"),
    "msk07_winner_takes_all": (msk07, f"{MAG} SELECT utt, spk, t, f, CASE WHEN m = max(m) OVER (PARTITION BY utt, t, f) THEN {r6('m')} ELSE 0.0001 END AS m FROM mag"),
    "msk08_energy_vad": (msk08, f"{MAG}, e AS (SELECT utt, t, f, round(m, 9) AS e FROM mag WHERE spk = 0) SELECT utt, t, f, CASE WHEN sum(e) OVER (PARTITION BY utt ORDER BY e, t, f ROWS UNBOUNDED PRECEDING) > sum(e) OVER (PARTITION BY utt) * 0.2 THEN 1.0::DOUBLE ELSE 0.0001 END AS m FROM e"),
    "msk09_post_masking": (msk09, f"{W}{STFT} SELECT utt, t, f, {r6('re*abs(sin(t+2*f))')} AS re, {r6('im*abs(sin(t+2*f))')} AS im FROM stft WHERE ch = 0"),
    "msk10_products": (msk10, f"{MAG} SELECT a.utt, a.t, a.f, {r6('a.m*b.m*CASE WHEN a.t < 5 THEN a.t + 1 ELSE 1 END')} AS m FROM mag a JOIN mag b ON a.utt = b.utt AND a.t = b.t AND a.f = b.f AND a.spk = 0 AND b.spk = 1"),
}
