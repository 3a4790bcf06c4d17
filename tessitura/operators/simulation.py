"""Simulation of mixtures, rooms and impulse responses."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.signal import EPSILON, SPEED, directivity, sabine_rt60, sinc, snr_gain
from ..sources.places import scratch


#: What a plan of mixtures must keep to: a rule and its condition, on arrays (null: empty) of one row a mixture.
RULES = {
    "a response for every speaker, or none": "size(speaker_rirs) IN (0, size(speakers))",
    "ratios for more than one speaker": "size(speakers) <= 1 OR size(sdrs) > 0",
    "a ratio for every speaker but the first": "size(sdrs) = 0 OR size(sdrs) = size(speakers) - 1",
    "a beginning for every speaker, or none": "size(speaker_begins) IN (0, size(speakers))",
    "a response for every noise, or none": "size(noises) = 0 OR size(noise_rirs) IN (0, size(noises))",
    "a ratio for every noise": "size(noises) = 0 OR size(noise_snrs) = size(noises)",
    "a beginning for every noise, or none": "size(noises) = 0 OR size(noise_begins) IN (0, size(noises))",
    "a ratio for isotropic noise": "size(isotropic) = 0 OR size(isotropic_snrs) > 0",
    "as many channels in every response": "size(array_distinct(rir_channels)) <= 1",
}
_LISTS = ("speakers", "speaker_rirs", "sdrs", "speaker_begins", "noises", "noise_rirs", "noise_snrs", "noise_begins", "isotropic", "isotropic_snrs", "rir_channels")


def violations(plan: DataFrame, key: str = "utt") -> DataFrame:
    """(rule, n, first): how many mixtures break each rule, and the first that does, from one aggregate of the plan. Lists that the
    plan has no column for are empty."""
    lists = plan.select(key, *((F.coalesce(F.col(c), F.array()) if c in plan.columns else F.array()).alias(c) for c in _LISTS))
    broken = [F.struct(F.lit(rule).alias("rule"), F.count_if(~F.expr(ok)).alias("n"), F.min(F.when(~F.expr(ok), F.col(key))).alias("first")) for rule, ok in RULES.items()]
    return lists.agg(F.array(*broken).alias("v")).select(F.inline("v"))


def validated(plan: DataFrame, key: str = "utt") -> DataFrame:
    """The plan, if it keeps to all rules; else an error that names the rules broken, before anything is simulated."""
    said = F.concat(F.lit("the plan lacks "), F.col("rule"), F.lit(": "), F.col("n").cast("string"), F.lit(" mixtures, first "), F.col("first").cast("string"))
    violations(plan, key).select(F.assert_true(F.col("n") == 0, said)).collect()
    return plan


def power(x: Column) -> Column:
    """Mean square of an array."""
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v) / F.size(x)


def mixed_speakers(speakers: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, spk, n, x) samples of speakers(keys, spk, x array, begin, sdr): moved to `begin`, and scaled to `sdr` dB against the
    first speaker."""
    first = speakers.groupBy(*keys).agg(F.min_by(power(F.col("x")), F.col("spk")).alias("p0"), F.min("spk").alias("s0"))
    gain = F.when(F.col("spk") == F.col("s0"), 1.0).otherwise(snr_gain(power(F.col("x")), F.col("p0"), -F.col("sdr")))
    s = speakers.join(first, keys).select(*keys, "spk", "begin", F.posexplode(F.transform("x", lambda v: v)).alias("n", "x"), gain.alias("g"))
    return s.select(*keys, "spk", (F.col("n") + F.col("begin")).cast("long").alias("n"), (F.col("x") * F.col("g")).alias("x"))


def add_noise(speech: DataFrame, noise: DataFrame, keys: list[str], repeat: bool = True) -> DataFrame:
    """(keys, n, x, noise): samples speech(keys, n, x) with noise(keys, x array, begin, snr), repeated to the end if asked, scaled to
    `snr` dB below the speech's power."""
    size = speech.groupBy(*keys).agg(F.avg(F.col("x") * F.col("x")).alias("ps"))
    scaled = noise.join(size, keys).withColumn("g", snr_gain(power(F.col("x")), F.col("ps"), F.col("snr"))).withColumnRenamed("x", "nx")
    at = F.col("n") - F.col("begin")
    value = F.get("nx", (at % F.size("nx") if repeat else at).cast("int"))
    inside = (at >= 0) if repeat else (at >= 0) & (at < F.size("nx"))
    return speech.join(scaled, keys).withColumn("noise", F.when(inside, value * F.col("g")).otherwise(0.0)).withColumn("x", F.col("x") + F.col("noise")).select(*speech.columns, "noise")


def peak_normalised(mix: DataFrame, keys: list[str], columns: list[str], peak: float = 0.9) -> DataFrame:
    """Mixture x and other columns times one factor that brings the mixture's peak to `peak`."""
    top = F.max(F.abs("x")).over(Window.partitionBy(*keys))
    return mix.withColumns({c: F.col(c) * (peak / (top + EPSILON)) for c in ["x", *columns]})


def early_power(h: Column, sr: int, before_ms: float = 1.0, after_ms: float = 50.0) -> Column:
    """Energy of an impulse response from just before its peak to the end of early reflections, for each sample of that time."""
    peak = F.array_position(F.transform(h, lambda v: F.abs(v)), F.array_max(F.transform(h, lambda v: F.abs(v)))) - 1
    lo, hi = F.greatest(peak - int(before_ms * sr / 1000), F.lit(0)), F.least(peak + int(after_ms * sr / 1000), F.size(h))
    part = F.slice(h, (lo + 1).cast("int"), (hi - lo).cast("int"))
    return F.aggregate(part, F.lit(0.0), lambda a, v: a + v * v) / (hi - lo)


def impulse_responses(spark: SparkSession, rooms: DataFrame, samples: int, sr: int, order: int = -1, pattern: str = "omnidirectional", speed: float = SPEED, half: float = 0.004) -> DataFrame:
    """(room, mic, n, x): responses of shoebox rooms by mirror images. rooms(room, mic, x, y, z size, beta, sx, sy, sz source,
    rx, ry, rz receiver). Images within reach are a sequence in each of three axes; an image adds a windowed sinc of 2 * `half`
    seconds around its delay. beta: one reflection coefficient of all walls, or columns bx0, bx1, by0, by1, bz0, bz1 for the walls
    at 0 and at the far end of each axis; order: most reflections, -1 for all."""
    step = speed / sr
    reach = lambda size: F.ceil(F.lit(samples * step) / (2 * F.col(size))).cast("int")
    axis = lambda size: F.explode(F.sequence(-reach(size), reach(size)))
    flip = F.array(F.lit(0), F.lit(1))
    im = rooms.withColumn("mx", axis("x")).withColumn("my", axis("y")).withColumn("mz", axis("z")).withColumn("q", F.explode(flip)).withColumn("j", F.explode(flip)).withColumn("k", F.explode(flip))
    d = lambda m, q, size, s, r: (1 - 2 * F.col(q)) * F.col(s) - F.col(r) + 2 * F.col(m) * F.col(size)
    bounce = F.abs(2 * F.col("mx") - F.col("q")) + F.abs(2 * F.col("my") - F.col("j")) + F.abs(2 * F.col("mz") - F.col("k"))
    im = im.withColumns({"dx": d("mx", "q", "x", "sx", "rx"), "dy": d("my", "j", "y", "sy", "ry"), "dz": d("mz", "k", "z", "sz", "rz"), "bounce": bounce})
    im = im.where((F.col("bounce") <= order) if order >= 0 else F.lit(True)).withColumn("dist", F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2 + F.col("dz") ** 2) / step).where(F.col("dist") < samples)
    if "bx0" in rooms.columns:
        hits = [(f"b{a}{end}", F.abs(F.col(m) - F.col(q)) if end == 0 else F.abs(F.col(m))) for a, m, q in (("x", "mx", "q"), ("y", "my", "j"), ("z", "mz", "k")) for end in (0, 1)]
        walls = reduce(lambda a, b: a * b, [F.pow(name, n) for name, n in hits])
    else:
        walls = F.pow("beta", F.col("bounce"))
    gain = walls * directivity(F.col("dx"), F.col("dy"), F.col("dz"), pattern) / (4 * math.pi * F.greatest(F.col("dist"), F.lit(1e-6)) * step)
    wide = int(half * sr)
    taps = im.withColumn("g", gain).withColumn("n", F.explode(F.sequence((F.floor("dist") - wide + 1).cast("long"), (F.floor("dist") + wide).cast("long")))).where((F.col("n") >= 0) & (F.col("n") < samples))
    off = F.col("n") - F.col("dist")
    tap = F.col("g") * 0.5 * (1 + F.cos(off * (math.pi / wide))) * sinc(off)
    return taps.groupBy("room", "mic", "n").agg(F.sum(tap).alias("x"))


def uniform(seed: int, low: float, high: float, *key: Column) -> Column:
    """A number in [low, high) that depends on the key alone."""
    return F.lit(low) + F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(1 << 40)) / float(1 << 40) * (high - low)


#: Rounds of draws after which a room or source that finds no place is an error.
ROUNDS = 50


def _drawn(wanted: DataFrame, keys: list[str], draw, tries: int) -> DataFrame:
    """For each row of wanted the first try that fits. draw(rows with a column `try`) gives those that fit, with a struct `r`.
    Rows without a fit draw again, `tries` at a time; after ROUNDS rounds it fails instead of losing them."""
    out, left = None, wanted
    for k in range(ROUNDS):
        c = left.withColumn("try", F.explode(F.sequence(F.lit(k * tries), F.lit((k + 1) * tries - 1))))
        path = scratch(wanted.sparkSession, "drawn")  # written, so that no round draws again what those before drew
        draw(c).groupBy(*keys).agg(F.min_by("r", "try").alias("r")).write.parquet(path)
        found = wanted.sparkSession.read.parquet(path)
        out = found if out is None else out.unionByName(found)
        left = left.join(found, keys, "left_anti")
        if left.isEmpty():
            return out
    raise ValueError(f"no fit in {ROUNDS * tries} draws: the bounds leave no room")


def random_rooms(spark: SparkSession, many: int, size: tuple = ((7, 10), (7, 10), (3, 4)), absorption: tuple = (0.2, 0.8), rt60: tuple = (0.2, 0.7), seed: int = 777, tries: int = 20) -> DataFrame:
    """(room, x, y, z, absorption, rt60): rooms drawn until their reverberation time lies within rt60."""
    i, t, names = F.col("room"), F.col("try"), ("x", "y", "z", "absorption")

    def draw(c):
        c = c.withColumns({n: uniform(seed + k, lo, hi, i, t) for k, (n, (lo, hi)) in enumerate(zip(names, (*size, absorption), strict=True))})
        c = c.withColumn("rt60", sabine_rt60(F.col("x"), F.col("y"), F.col("z"), F.col("absorption"))).where(F.col("rt60").between(*rt60))
        return c.select("room", "try", F.struct(*names, "rt60").alias("r"))

    found = _drawn(spark.range(many).withColumnRenamed("id", "room"), ["room"], draw, tries)
    return found.select("room", *(F.bround(f"r.{n}", 3).alias(n) for n in (*names, "rt60")))


def placed(rooms: DataFrame, sources: int, topo: tuple[float, ...], full_circle: bool = False, distance: tuple = (1.5, 3.0), height: tuple = (1.6, 2.0), seed: int = 777, tries: int = 20) -> DataFrame:
    """(room, src, doa, dist, px, py, pz): sources around an array in the middle of the room, drawn until inside its walls."""
    names = ("doa", "dist", "px", "py", "pz")

    def draw(c):
        key = (F.col("room"), F.col("src"), F.col("try"))
        c = c.withColumns({"doa": uniform(seed, 0, 360 if full_circle else 180, *key), "dist": uniform(seed + 1, *distance, *key), "pz": uniform(seed + 2, *height, *key)})
        c = c.withColumns({"px": F.col("x") / 2 + F.col("dist") * F.cos(F.radians("doa")), "py": F.col("y") / (2 if full_circle else 10) + F.col("dist") * F.sin(F.radians("doa"))})
        good = c.where((F.col("px") > 0) & (F.col("px") < F.col("x")) & (F.col("py") > 0) & (F.col("py") < F.col("y")) & (F.col("pz") < F.col("z")))
        return good.select("room", "src", "try", F.struct(*names).alias("r"))

    wanted = rooms.withColumn("src", F.explode(F.sequence(F.lit(0), F.lit(sources - 1)))).withColumn("src", F.col("src").cast("long"))
    return _drawn(wanted, ["room", "src"], draw, tries).select("room", "src", *(F.bround(f"r.{n}", 3).alias(n) for n in names))
