"""Queries of estimators, metrics and simulation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.signal import at
from ..operators import estimation as E
from ..operators import families as A
from ..operators import masks as K
from ..operators import metrics as M
from ..operators import relational as R
from ..operators import simulation as S
from ..operators import transforms as T
from ..sources.places import scratch
from . import fixtures as X
from .arrays import COV, MASK, mask
from .fixtures import PAIR, SAMPLES, STFT, r6
from .spectral import BOTH, C, both, spec

V = f"WITH {SAMPLES} "


def cells(df, *names, places=5):
    return df.withColumns({n: F.round(n, places) for n in names})


def em01(spark, d):
    return cells(E.mixture_masks(spec(spark, d), 2, 5), "m")


def em02(spark, d):
    return cells(E.aligned(E.mixture_masks(spec(spark, d), 2, 5, angular=True, update_alpha=True)), "m")


def em03(spark, d):
    """Four rounds, stored, then two more from there; bins of even utterances had all six before and are passed over."""
    s = spec(spark, d)
    done = A.fitted(s.where("utt % 2 = 0"), rounds=6)
    path = scratch(spark, "model")
    A.fitted(s.where("utt % 2 = 1"), rounds=4).unionByName(done).write.parquet(path)
    model = A.fitted(s, rounds=6, model=spark.read.parquet(path))
    return cells(A.masks_of(s, model), "m")


def sim05(spark, d):
    """Orders as plans of mixtures: lines are speakers, some with a response; returned lines are noises."""
    line = X.read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("utt"))
    listed = lambda on, value="l_quantity": F.collect_list(F.when(on, F.col(value)))
    yes, returned = F.lit(True), F.col("l_returnflag") == "R"
    plan = line.agg(
        listed(yes).alias("speakers"), listed(F.col("l_linestatus") == "O").alias("speaker_rirs"), listed(F.col("l_linenumber") > 1).alias("sdrs"),
        listed(returned).alias("noises"), listed(returned & (F.col("l_discount") > 0.05)).alias("noise_snrs"), listed(F.col("l_linenumber") == 1, "l_tax").alias("isotropic"), listed(F.col("l_linenumber") == 2).alias("isotropic_snrs"),
        listed(yes, "l_linenumber").alias("rir_channels"),
    )
    return S.violations(plan).withColumn("first", F.coalesce("first", F.lit(-1).cast("long")))


def em04(spark, d):
    s = spec(spark, d).withColumn("p", at().power())
    n = s.groupBy("utt", "t", "f").agg(F.sqrt(F.sum("p")).alias("size"))
    return s.join(n, ["utt", "t", "f"]).select("utt", "ch", "t", "f", F.round(F.col("re") / F.greatest("size", F.lit(1.1920929e-07)), 6).alias("re"), F.round(F.col("im") / F.greatest("size", F.lit(1.1920929e-07)), 6).alias("im"))


def em05(spark, d):
    x = spec(spark, d).where("ch < 3").select("utt", F.col("ch").alias("k"), "t", "f", at().abs().alias("l"))
    top = x.groupBy("utt", "t", "f").agg(F.max("l").alias("top"))
    e = x.join(top, ["utt", "t", "f"]).withColumn("e", F.exp(F.col("l") - F.col("top")) * (F.col("k") + 1) / 6)
    total = e.groupBy("utt", "t", "f").agg(F.sum("e").alias("z"))
    return e.join(total, ["utt", "t", "f"]).select("utt", "k", "t", "f", F.round(F.col("e") / F.col("z"), 6).alias("m"))


def em06(spark, d):
    return cells(E.auxiva(spec(spark, d), 3), "re", "im")


def em07(spark, d):
    return cells(E.wpe(spec(spark, d), taps=2, delay=1, rounds=2), "re", "im")


def em08(spark, d):
    return cells(E.wpd(spec(spark, d), taps=1, delay=1, rounds=2, mask_rounds=3), "re", "im", "m", places=4)


def noise(improved):
    def query(spark, d):
        return cells(E.noise_gain(spec(spark, d).where("ch = 0"), improved), "m")

    return query


def bf11(spark, d):
    c = E.online_covariances(spec(spark, d), mask(spark, d), 3)
    return c.select("utt", "chunk", "f", "i", "j", F.round("re", 6).alias("re"), F.round("im", 6).alias("im"))


def bf11_output(kind):
    def query(spark, d):
        from ..operators import beamforming as B

        return cells(B.online(spec(spark, d), mask(spark, d), kind, 3), "re", "im") if kind == "mvdr" else B.online(spec(spark, d), mask(spark, d), kind, 3).groupBy("utt", "f").agg(F.round(F.sum(at().power()), 4).alias("power"))

    return query


def met01(spark, d):
    p = X.pair(spark, d).select("utt", F.explode(F.arrays_zip("a", "y")).alias("z")).select("utt", F.col("z.y").alias("est"), F.col("z.a").alias("ref"))
    return M.si_snr(p, ["utt"]).select("utt", F.round("value", 6).alias("value"))


def met02(spark, d):
    x = X.samples(spark, d)
    est = x.where("ch < 2").select("utt", "n", F.col("ch").alias("est_spk"), F.col("x").alias("est"))
    ref = x.where("ch > 1").select("utt", "n", (F.col("ch") - 2).alias("ref_spk"), F.col("x").alias("ref"))
    s = M.si_snr(est.join(ref, ["utt", "n"]), ["utt", "est_spk", "ref_spk"])
    return M.best_permutation(s, ["utt"], 2).select("utt", F.round("value", 6).alias("value"), "p")


def met03(spark, d):
    return M.sdr(X.pair(spark, d).select("utt", F.col("y").alias("est"), F.col("a").alias("ref")), 4).select("utt", F.round("value", 3).alias("value"))


def met03_scores(spark, d):
    """SDR, SIR and SAR of channels 2 and 3 mixed either way, against both, in the better order, filters of 16 taps."""
    ch = F.array_sort(F.collect_list(F.struct("ch", "x")))
    w = X.wave(spark, d).groupBy("utt").agg(ch.alias("z")).where("size(z) = 4")
    x = [F.col("z")[k]["x"] for k in range(4)]
    mix = lambda a, b, c: F.zip_with(F.zip_with(a, b, lambda p, q: p + 0.3 * q), c, lambda p, q: p + 0.1 * q)
    s = M.separation_scores(w.select("utt", F.array(mix(x[3], x[2], x[0]), mix(x[2], x[3], x[1])).alias("ests"), F.array(x[2], x[3]).alias("refs")), 16)
    best = M.best_permutation(s.select("utt", "est_spk", "ref_spk", F.col("sir").alias("value")), ["utt"], 2)
    return s.join(best.select("utt", "p"), "utt").where((F.col("est_spk") == F.col("ref_spk")) == (F.col("p") == 0)).select("utt", "est_spk", "ref_spk", *(F.round(c, 3).alias(c) for c in ("sdr", "sir", "sar")))


def met05(spark, d):
    return M.word_errors(X.transcripts(spark, d), ["conv_id", "turn"]).select("conv_id", "turn", "err", "len", F.round("wer", 6).alias("wer"))


def met04(spark, d):
    """Token errors of two hypotheses against two references in the better order: turns two apart of one conversation."""
    c = X.read(spark, d, "conversations")
    said = lambda k, name: c.select("conv_id", (F.col("turn") - k).alias("turn"), F.coalesce(F.split(F.btrim("text"), "\\s+"), F.array().cast("array<string>")).alias(name))
    four = said(0, "h0").join(said(1, "h1"), ["conv_id", "turn"]).join(said(2, "r0"), ["conv_id", "turn"]).join(said(3, "r1"), ["conv_id", "turn"])
    return M.permuted_word_errors(four.select("conv_id", "turn", F.array("h0", "h1").alias("hyps"), F.array("r0", "r1").alias("refs")), ["conv_id", "turn"], 2)


def agg05(spark, d):
    return R.ratio_report(M.word_errors(X.transcripts(spark, d), ["conv_id", "turn"]), "cls", "err", "len").select("cls", F.round("rate", 6).alias("rate"))


def met06(spark, d):
    v = met01(spark, d).withColumn("cls", F.when(F.col("utt") % 3 == 0, "a").when(F.col("utt") % 3 == 1, "b"))
    return R.class_report(v, "cls", F.col("value")).select("cls", "n", F.round("mean", 4).alias("mean"))


def met07(spark, d):
    v = X.speakers(spark, d)
    centre = v.select("spk", F.posexplode("v").alias("i", "x")).groupBy("spk", "i").agg(F.avg("x").alias("x")).groupBy("spk").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda z: z["x"]).alias("v"))
    return M.verification(v, centre)


def sim01(spark, d):
    w = X.wave(spark, d).where("ch < 2").select("utt", F.col("ch").alias("spk"), "x", (F.col("ch") * 8).alias("begin"), F.lit(3.0).alias("sdr"))
    return S.mixed_speakers(w, ["utt"]).groupBy("utt", "n").agg(F.round(F.sum("x"), 6).alias("x"))


def sim02(spark, d):
    x = X.samples(spark, d).where("ch = 0").select("utt", "n", "x")
    noise = X.wave(spark, d).where("ch = 1").select("utt", "x", F.lit(5).cast("long").alias("begin"), F.lit(10.0).alias("snr"))
    y = S.peak_normalised(S.add_noise(x, noise, ["utt"]), ["utt"], ["noise"])
    return y.select("utt", "n", F.round("x", 6).alias("x"), F.round("noise", 6).alias("noise"))


def sim07(spark, d):
    h = X.wave(spark, d).where("ch = 0")
    return h.select("utt", F.round(S.early_power(F.col("x"), 1000, 5, 20), 6).alias("p"))


def sim08(spark, d):
    rooms = spark.createDataFrame([(0, m, 5.0, 4.0, 6.0, 0.4, 2.0, 3.5, 2.0, rx, 1.5, 2.0) for m, rx in enumerate((2.0, 1.0))], "room long, mic long, x double, y double, z double, beta double, sx double, sy double, sz double, rx double, ry double, rz double")
    return S.impulse_responses(spark, rooms, 600, X.SR, order=2).select("room", "mic", "n", F.round("x", 6).alias("x"))


def sim08_walls(spark, d):
    """All reflections, another coefficient for each wall."""
    rooms = spark.createDataFrame([(0, 0, 5.0, 4.0, 6.0, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 2.0, 3.5, 2.0, 2.0, 1.5, 2.0)], "room long, mic long, x double, y double, z double, bx0 double, bx1 double, by0 double, by1 double, bz0 double, bz1 double, sx double, sy double, sz double, rx double, ry double, rz double")
    return S.impulse_responses(spark, rooms, 300, X.SR).select("room", "mic", "n", F.round("x", 6).alias("x"))


def sim09(spark, d):
    return S.random_rooms(spark, 20)


def sim10(spark, d):
    return S.placed(S.random_rooms(spark, 20), 2, (0.0, 0.1, 0.2, 0.3))


def fn18(spark, d):
    """The exponential integral against a sum over a fine grid."""
    import numpy as np

    v = [0.1 * k for k in range(1, 40)]
    return spark.createDataFrame([(float(a), float(b)) for a, b in zip(v, E.exponential_integral(np.array(v)), strict=True)], "v double, e1 double").select(F.round("v", 6).alias("v"), F.round("e1", 4).alias("e1"))


def bf15(spark, d):
    """Adaptive beamforming end to end: mask, weights, masked output, wave."""
    from ..operators import beamforming as B

    s, m = spec(spark, d), mask(spark, d)
    y = T.masked(B.beamformed(s, B.supervised(s, m, "mvdr")), m, ["utt"])
    return T.istft(y, C, ["utt"]).select("utt", F.posexplode("x").alias("n", "x")).select("utt", F.col("n").cast("long").alias("n"), F.round("x", 5).alias("x"))


def msk05(spark, d):
    """Oracle separation: the ratio mask of a clean signal on its mixture, and what it wins in SI-SNR."""
    b = both(spark, d)
    m = b.select("utt", "t", "f", K.pair_mask(at("s_"), at("y_"), "irm").alias("m"))
    x = T.istft(T.masked(b.select("utt", "t", "f", F.col("y_re").alias("re"), F.col("y_im").alias("im")), m, ["utt"]), C, ["utt"])
    p = X.pair(spark, d).join(x, "utt").select("utt", F.explode(F.arrays_zip("a", "x")).alias("z")).select("utt", F.col("z.x").alias("est"), F.col("z.a").alias("ref"))
    return M.si_snr(p, ["utt"]).select("utt", F.round("value", 4).alias("value"))


SNR = "20*log10(sqrt(greatest(t, 0))/(sqrt(greatest(xx-t, 0))+1e-8)+1e-8)"
MOM = "(SELECT *, xs*xs/(ss+1e-8) AS t FROM (SELECT {k}, sum(e*e)-sum(e)*sum(e)/count(*) AS xx, sum(r*r)-sum(r)*sum(r)/count(*) AS ss, sum(e*r)-sum(e)*sum(r)/count(*) AS xs FROM ({q}) GROUP BY {k}))"
_SI = f"si AS (SELECT utt, round({SNR}, 6) AS value FROM " + MOM.format(k="utt", q="SELECT utt, noisy AS e, clean AS r FROM pair") + ")"
QUERIES = {
    "em01_cgmm": (em01, None),
    "em02_cacgmm_aligned": (em02, None),
    "em04_normalised_observations": (em04, f"WITH {SAMPLES}, {STFT} SELECT utt, ch, t, f, {r6('re/greatest(sqrt(sum(re*re+im*im) OVER w),1.1920929e-07)')} AS re, {r6('im/greatest(sqrt(sum(re*re+im*im) OVER w),1.1920929e-07)')} AS im FROM stft WINDOW w AS (PARTITION BY utt, t, f)"),
    "em05_posterior": (em05, f"WITH {SAMPLES}, {STFT}, e AS (SELECT utt, ch AS k, t, f, exp(sqrt(re*re+im*im))*(ch+1) AS e FROM stft WHERE ch < 3) SELECT utt, k, t, f, {r6('e/sum(e) OVER (PARTITION BY utt, t, f)')} AS m FROM e"),
    "em06_auxiva": (em06, None),
    "em07_wpe": (em07, None),
    "em08_wpd": (em08, None),
    "em09_mcra": (noise(False), None),
    "em10_imcra": (noise(True), None),
    "bf11_online_covariance": (bf11, f"WITH {SAMPLES}, {STFT}, {MASK}, " + COV.replace("cov AS (SELECT a.utt,", "cov AS (SELECT a.utt, a.t//3 AS chunk,") + f""" SELECT b.utt, b.chunk, b.f, b.i, b.j, {r6('sum(CASE WHEN c.chunk = 0 THEN 1 ELSE 0.2 END * 0.8 ** (b.chunk - c.chunk) * c.re)')} AS re,
      {r6('sum(CASE WHEN c.chunk = 0 THEN 1 ELSE 0.2 END * 0.8 ** (b.chunk - c.chunk) * c.im)')} AS im FROM cov b JOIN cov c ON b.utt=c.utt AND b.f=c.f AND b.i=c.i AND b.j=c.j AND c.chunk <= b.chunk GROUP BY b.utt, b.chunk, b.f, b.i, b.j"""),
    "bf11_online_mvdr": (bf11_output("mvdr"), None),
    "bf11_online_gevd": (bf11_output("gevd"), None),
    "bf15_adaptive_to_wave": (bf15, None),
    "msk05_oracle_separation": (msk05, None),
    "fn18_exponential_integral": (fn18, f"SELECT {r6('k*0.1')} AS v, round(sum(exp(-(k*0.1)*exp(u*0.0005+0.00025))*0.0005), 4) AS e1 FROM range(1, 40) a(k), range(0, 16000) b(u) GROUP BY k"),
    "met01_si_snr": (met01, f"{V}, {PAIR}, {_SI} SELECT utt, {r6('value')} AS value FROM si"),
    "met02_permuted_si_snr": (met02, f"{V}, s AS (SELECT utt, i, j, {SNR} AS v FROM " + MOM.format(k="utt, i, j", q="SELECT a.utt, a.ch AS i, b.ch - 2 AS j, a.x AS e, b.x AS r FROM samples a JOIN samples b ON a.utt=b.utt AND a.n=b.n AND a.ch<2 AND b.ch>1") + f"), p AS (SELECT utt, CASE WHEN i = j THEN 0 ELSE 1 END AS p, avg(v) AS v FROM s GROUP BY ALL) SELECT utt, {r6('max(v)')} AS value, CASE WHEN round(max(v) FILTER (p = 0), 9) >= round(max(v) FILTER (p = 1), 9) THEN 0 ELSE 1 END::BIGINT AS p FROM p GROUP BY utt"),
    "met03_sdr": (met03, None),
    "em03_resumed_masks": (em03, None),
    "sim05_plan_checks": (sim05, """WITH p AS (SELECT l_orderkey AS utt, count(*) AS s, count(*) FILTER (l_linestatus = 'O') AS r, count(*) FILTER (l_linenumber > 1) AS d,
      count(*) FILTER (l_returnflag = 'R') AS n, count(*) FILTER (l_returnflag = 'R' AND l_discount > 0.05) AS q, count(*) FILTER (l_linenumber = 1) AS i, count(*) FILTER (l_linenumber = 2) AS j, count(DISTINCT l_linenumber) AS c FROM lineitem GROUP BY 1),
      b AS (SELECT utt, unnest([{'rule': 'a response for every speaker, or none', 'bad': r NOT IN (0, s)}, {'rule': 'ratios for more than one speaker', 'bad': s > 1 AND d = 0}, {'rule': 'a ratio for every speaker but the first', 'bad': d <> 0 AND d <> s - 1},
        {'rule': 'a beginning for every speaker, or none', 'bad': false}, {'rule': 'a response for every noise, or none', 'bad': false}, {'rule': 'a ratio for every noise', 'bad': n <> 0 AND q <> n}, {'rule': 'a beginning for every noise, or none', 'bad': false},
        {'rule': 'a ratio for isotropic noise', 'bad': i <> 0 AND j = 0}, {'rule': 'as many channels in every response', 'bad': c > 1}]) AS x FROM p)
      SELECT x.rule AS rule, count(*) FILTER (x.bad) AS n, coalesce(min(utt) FILTER (x.bad), -1) AS first FROM b GROUP BY 1"""),
    "met03_separation_scores": (met03_scores, None),
    "met05_word_errors": (met05, None),
    "met04_permuted_word_errors": (met04, None),
    "agg05_ratio_report": (agg05, None),
    "met06_class_si_snr": (met06, f"{V}, {PAIR}, {_SI}, c AS (SELECT value, CASE utt % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'NG' END AS cls FROM si) SELECT coalesce(cls, 'ALL') AS cls, count(*) AS n, round(avg(value), 4) + 0.0 AS mean FROM c GROUP BY ROLLUP (cls)"),
    "met07_verification": (met07, f"WITH {X.SPEAKERS}, c AS (SELECT spk, i, avg(x) AS y FROM speakers GROUP BY ALL) SELECT s.utt, c.spk, round(sum(s.x*c.y), 2) + 0.0 AS score, CASE WHEN s.spk = c.spk THEN 'target' ELSE 'nontarget' END AS kind FROM speakers s JOIN c USING (i) GROUP BY s.utt, s.spk, c.spk"),
    "sim01_mix_speakers": (sim01, f"{V}, p AS (SELECT utt, avg(x*x) FILTER (ch = 0) AS p0, avg(x*x) FILTER (ch = 1) AS p1 FROM samples GROUP BY utt) SELECT utt, n + ch * 8 AS n, {r6('sum(x * CASE WHEN ch = 0 THEN 1 ELSE sqrt(p0/(p1*10**(-0.3)+1.1920929e-07)) END)')} AS x FROM samples JOIN p USING (utt) WHERE ch < 2 GROUP BY utt, n + ch * 8"),
    "sim02_add_noise": (sim02, f"""{V}, p AS (SELECT utt, avg(x*x) FILTER (ch = 0) AS ps, avg(x*x) FILTER (ch = 1) AS pn FROM samples GROUP BY utt), y AS (SELECT a.utt, a.n, CASE WHEN a.n < 5 THEN 0 ELSE b.x * sqrt(ps/(pn*10**1.0+1.1920929e-07)) END AS noise, a.x AS s
      FROM samples a JOIN p USING (utt) JOIN samples b ON b.utt = a.utt AND b.ch = 1 AND b.n = (a.n + 59) % 64 WHERE a.ch = 0) SELECT utt, n, {r6('(s+noise)*0.9/(max(abs(s+noise)) OVER (PARTITION BY utt)+1.1920929e-07)')} AS x, {r6('noise*0.9/(max(abs(s+noise)) OVER (PARTITION BY utt)+1.1920929e-07)')} AS noise FROM y"""),
    "sim07_early_power": (sim07, f"{V}, k AS (SELECT utt, arg_max(n, abs(x)) AS p FROM samples WHERE ch = 0 GROUP BY utt) SELECT utt, {r6('sum(x*x)/count(*)')} AS p FROM samples JOIN k USING (utt) WHERE ch = 0 AND n >= k.p - 5 AND n < k.p + 20 GROUP BY utt"),
    "sim08_impulse_response": (sim08, f"""WITH m AS (SELECT mic, rx, mx, my, mz, q, j, k, (1-2*q)*2.0-rx+2*mx*5.0 AS dx, (1-2*j)*3.5-1.5+2*my*4.0 AS dy, (1-2*k)*2.0-2.0+2*mz*6.0 AS dz, abs(2*mx-q)+abs(2*my-j)+abs(2*mz-k) AS b
      FROM (VALUES (0, 2.0::DOUBLE), (1, 1.0::DOUBLE)) r(mic, rx), range(-2, 3) a(mx), range(-2, 3) b(my), range(-2, 3) c(mz), range(2) e(q), range(2) f(j), range(2) g(k)), d AS (SELECT *, sqrt(dx*dx+dy*dy+dz*dz)/(343.0/16000) AS dist FROM m WHERE b <= 2)
      SELECT 0::BIGINT AS room, mic::BIGINT AS mic, n, {r6('sum(pow(0.4::DOUBLE,b)/(4*pi()*dist*(343.0/16000))*0.5*(1+cos((n-dist)*pi()/64))*CASE WHEN n=dist THEN 1 ELSE sin(pi()*(n-dist))/(pi()*(n-dist)) END)')} AS x FROM d, range(600) t(n) WHERE dist < 600 AND n >= floor(dist)-63 AND n <= floor(dist)+64 GROUP BY mic, n"""),
    "sim08_six_walls": (sim08_walls, f"""WITH m AS (SELECT mx, my, mz, q, j, k, (1-2*q)*2.0-2.0+2*mx*5.0 AS dx, (1-2*j)*3.5-1.5+2*my*4.0 AS dy, (1-2*k)*2.0-2.0+2*mz*6.0 AS dz,
      pow(0.9::DOUBLE,abs(mx-q))*pow(0.8::DOUBLE,abs(mx))*pow(0.7::DOUBLE,abs(my-j))*pow(0.6::DOUBLE,abs(my))*pow(0.5::DOUBLE,abs(mz-k))*pow(0.4::DOUBLE,abs(mz)) AS w
      FROM range(-2, 3) a(mx), range(-2, 3) b(my), range(-2, 3) c(mz), range(2) e(q), range(2) f(j), range(2) g(k)), d AS (SELECT *, sqrt(dx*dx+dy*dy+dz*dz)/(343.0/16000) AS dist FROM m)
      SELECT 0::BIGINT AS room, 0::BIGINT AS mic, n, {r6('sum(w/(4*pi()*dist*(343.0/16000))*0.5*(1+cos((n-dist)*pi()/64))*CASE WHEN n=dist THEN 1 ELSE sin(pi()*(n-dist))/(pi()*(n-dist)) END)')} AS x FROM d, range(300) t(n) WHERE dist < 300 AND n >= floor(dist)-63 AND n <= floor(dist)+64 GROUP BY n"""),
    "sim09_random_rooms": (sim09, None),
    "sim10_placements": (sim10, None),
}
