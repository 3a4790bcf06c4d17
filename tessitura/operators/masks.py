"""Time-frequency masks in long form (keys, t, f, m)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.signal import EPSILON, Complex, at, compressed, decibel


def pair_mask(clean: Complex, noisy: Complex, kind: str) -> Column:
    """Mask of a clean signal in its mixture: ibm, irm, iam, psm, psa, or crm_re / crm_im."""
    s, y, n = clean.abs(), noisy.abs(), (noisy - clean).abs()
    turn = F.cos(clean.angle() - noisy.angle())
    if kind.startswith("crm"):
        ratio = clean.divided(noisy, EPSILON)
        return compressed(ratio.re if kind == "crm_re" else ratio.im)
    return {
        "ibm": F.when(s > n, 1.0).otherwise(0.0),
        "irm": s / F.sqrt(s * s + n * n + EPSILON),
        "iam": s / F.greatest(y, F.lit(EPSILON)),
        "psm": s * turn / F.greatest(y, F.lit(EPSILON)),
        "psa": s * F.greatest(turn, F.lit(0.0)) / F.greatest(y, F.lit(EPSILON)),
    }[kind]


def noise_mask(clean: Column, noise: Column, kind: str) -> Column:
    """Masks from clean and noise magnitudes: irm_linear S / (S + N), ibm, and wiener on powers."""
    return {"irm_linear": clean / (clean + noise + EPSILON), "ibm": F.when(clean > noise, 1.0).otherwise(0.0), "wiener": clean * clean / (clean * clean + noise * noise + EPSILON)}[kind]


def clipped(mask: Column, cutoff: float = -1.0) -> Column:
    return F.greatest(F.least(mask, F.lit(cutoff)) if cutoff > 0 else mask, F.lit(0.0))


def speaker_masks(spec: DataFrame, cell: list[str], spk: str = "spk") -> DataFrame:
    """spec(cell, spk, m magnitude) with irm and ibm among the speakers of a cell; the first of equal speakers wins."""
    w = Window.partitionBy(*cell)
    first = F.row_number().over(w.orderBy(F.desc("m"), spk)) == 1
    return spec.withColumn("irm", F.col("m") / (F.sum("m").over(w) + EPSILON)).withColumn("ibm", F.when(first, 1.0).otherwise(0.0))


def mixture_masks(spec: DataFrame, mix: DataFrame, cell: list[str]) -> DataFrame:
    """(cell, spk, iam, psm) of spec(cell, spk, re, im) within mix(cell, re, im): a speaker's magnitude by the mixture's, and the
    same times the cosine between their phases. Cells without a mixture are left out."""
    y = mix.select(*cell, F.col("re").alias("y_re"), F.col("im").alias("y_im"))
    iam = at().abs() / (at("y_").abs() + EPSILON)
    return spec.join(y, cell).select(*cell, "spk", iam.alias("iam"), (iam * F.cos(at("y_").angle() - at().angle())).alias("psm"))


def cluster_labels(spec: DataFrame, utt: list[str], beta: float = 40.0, spk: str = "spk") -> DataFrame:
    """(utt, t, f, label): the loudest speaker of a cell, -1 in cells more than beta dB below the utterance's loudest."""
    cell = spec.groupBy(*utt, "t", "f").agg(F.max(F.struct("m", (-F.col(spk)).alias("s"))).alias("top"), F.sum("m").alias("all"))
    level = cell.withColumn("db", 20 * F.log10(F.col("all") + EPSILON))
    top = F.max("db").over(Window.partitionBy(*utt))
    return level.withColumn("label", F.when(F.col("db") < top - beta, -1).otherwise(-F.col("top.s"))).select(*utt, "t", "f", F.col("label").cast("long").alias("label"))


def winner_takes_all(mask: DataFrame, cell: list[str], eps: float = 1e-4) -> DataFrame:
    """Cells' largest masks stay (all of equal ones), others become eps."""
    return mask.withColumn("m", F.when(F.col("m") == F.max("m").over(Window.partitionBy(*cell)), F.col("m")).otherwise(eps))


def energy_vad(spec: DataFrame, utt: list[str], share: float, low: float = 1e-4) -> DataFrame:
    """(utt, t, f, m): cells that together hold less than 1 - share of the energy become `low`, others 1. Energies are summed
    in ascending order. A window of one utterance; its cells are one matrix."""
    w = Window.partitionBy(*utt).orderBy("e", "t", "f").rowsBetween(Window.unboundedPreceding, 0)
    total = Window.partitionBy(*utt)
    return spec.withColumn("run", F.sum("e").over(w)).withColumn("m", F.when(F.col("run") > F.sum("e").over(total) * (1 - share), 1.0).otherwise(low)).select(*utt, "t", "f", "m")


def product(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Elementwise product of two matrices by key."""
    return a.join(b.withColumnRenamed("m", "m2"), keys).withColumn("m", F.col("m") * F.col("m2")).drop("m2")


def scaled_rows(a: DataFrame, scale: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys) times scale(keys, s); rows without a scale stay."""
    return a.join(scale, keys, "left").withColumn("m", F.col("m") * F.coalesce("s", F.lit(1.0))).drop("s")


def silent_share(power: Column, threshold_db: float) -> Column:
    return F.avg(F.when(decibel(power) < threshold_db, 1.0).otherwise(0.0))
