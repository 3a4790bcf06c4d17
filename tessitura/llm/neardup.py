"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

Signatures use two permutations of 32-bit numbers: the first scatters the shingles, the second is shifted by one place for
each further coordinate. BANDS bands of ROWS coordinates put documents with a similarity of 0.85 into a common bucket with
probability 1 - 7e-6; the pipeline's stage has a threshold of 0.8 and more bands. Equal sets are one class from then on. Among classes that share a bucket:

1. shingles that no other candidate has are counted; a class with too many of them can't reach the threshold and goes;
2. each class is compared with one leader, the least id of its buckets (linear in the classes); what links makes parts;
3. only buckets that still hold several parts are compared further, and buckets of equal members once. Hot buckets are salted
   wherever rows meet by bucket. A bucket is dealt into
   blocks of bounded size by salt, parts that fill a block apart from the rest, and pairs of blocks meet in separate tasks,
   bit set against bit set; no part is compared with itself. Only a spanning forest of the links leaves a task.

All links are confirmed on whole sets of 64-bit shingle hashes, so none below the threshold is made. Components come from
star contraction (shared.connected), first of classes, then of parts.

Defined results: a text of fewer than five words is one shingle, its whole sequence; null and blank texts have none, link
with nothing and are kept; ties of ids go to one of the equal rows. `classes` takes rows that repeat a doc_id for the same
document; rows without a doc_id get the least doc_id of their component, are kept only if there is none, and are told apart
by their text. `keep_one` tells rows apart by a key of its own and carries the input in a struct, so that repeated rows keep
their text once and columns can have any names. Very long texts are hashed in slices. No rows, no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import LOWER, chunks, connected, dropped, grams, in_arrow, mix, paired, sifted, spaced, stored, table

SHINGLE = 5
PERCENT = 85
BANDS, ROWS = 16, 4
#: The pipeline's stage: 24 bands miss a pair of 80 % similarity with a probability of 3e-6.
STAGE_PERCENT, STAGE_BANDS = 80, 24
#: Shingles and classes of a block of the exact comparison.
BLOCK_SHINGLES, BLOCK_CLASSES = 200_000, 256
#: A bucket with more than one in HOT_SHARE of all places in shared buckets is hot, so fewer than HOT_SHARE buckets are. Its rows
#: are shuffled as SALTS keys.
HOT_SHARE, SALTS = 1024, 64


def shingled(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The set of shingle hashes of each text, ascending."""
    w = spaced(LOWER[data], offsets)
    out = []
    for a, b in zip(w.text.tolist(), w.text[1:].tolist(), strict=False):
        h = w.hash[a:b]
        if len(h) >= SHINGLE:
            out.append(np.unique(grams(h, SHINGLE)))
        elif len(h):
            x = np.array([len(h)], dtype=np.uint64)
            for one in h:
                x = paired(x, np.array([one]))
            out.append(x)
        else:
            out.append(h)
    return out


def _second(x: np.ndarray) -> np.ndarray:
    """The second permutation, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


def signatures(sets: list[np.ndarray], size: int = BANDS * ROWS) -> np.ndarray:
    """Circulant MinHash of non-empty sets: row i, coordinate k is the least second((first(x) - k) mod 2 ** 32)."""
    first = (mix(np.concatenate(sets)) >> np.uint64(32)).astype(np.uint32)
    at = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), size), dtype=np.uint32)
    for k in range(size):
        out[:, k] = np.minimum.reduceat(_second(first - np.uint32(k)), at)
    return out


def sketched(docs: DataFrame, key: str = "doc_id", text: str = "text", n_bands: int = BANDS) -> DataFrame:
    """(key, n_shingles, d1, d2, bands): size and digest of each set, and its bucket in each band (null without shingles)."""

    def run(batches):
        for b in batches:
            n, one, two, bands = [], [], [], []
            for _, data, offsets in chunks(b.column(1)):
                sets = shingled(data, offsets)
                full = [s for s in sets if len(s)]
                made = iter(())
                if full:
                    sig = signatures(full, n_bands * ROWS).astype(np.uint64)
                    cells = np.empty((len(full), n_bands), dtype=np.uint64)
                    for band in range(n_bands):
                        x = np.full(len(full), band, dtype=np.uint64)
                        for r in range(ROWS):
                            x = paired(x, sig[:, band * ROWS + r])
                        cells[:, band] = x
                    sums = [(np.bitwise_xor.reduce(mix(s)), np.add.reduce(mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)))) for s in full]
                    made = iter(zip(sums, cells.view(np.int64).tolist(), strict=True))
                for s in sets:
                    n.append(len(s))
                    (x, y), c = next(made) if len(s) else ((0, 0), None)
                    one.append(np.uint64(x).view(np.int64))
                    two.append(np.uint64(y).view(np.int64))
                    bands.append(c)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], ["k", "n_shingles", "d1", "d2", "bands"])

    return in_arrow(docs.select(key, text), run, f"k {docs.schema[key].dataType.simpleString()}, n_shingles long, d1 long, d2 long, bands array<long>").withColumnRenamed("k", key)


def _sets(docs: DataFrame) -> DataFrame:
    """(id, n, s): the whole sets of docs(id, text)."""

    def run(batches):
        for b in batches:
            for at, data, offsets in chunks(b.column(1)):
                sets = shingled(data, offsets)
                flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, dtype=np.int64)
                bounds = np.cumsum([0, *map(len, sets)])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(sets)), pa.array(np.diff(bounds), pa.int64()), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat))], ["id", "n", "s"])

    return in_arrow(docs, run, f"id {docs.schema['id'].dataType.simpleString()}, n long, s array<long>")


def _similar(inter, a, b, percent: int):
    return 100 * inter >= percent * (a + b - inter)


def _compared(group, percent: int):
    """Pairs of parts that link, between two blocks (sides 0 and 1) or in one (side 0), as a spanning forest."""
    label, side = np.asarray(group.column("label")), np.asarray(group.column("side"))
    size = np.asarray(group.column("n"))
    lists = group.column("s").combine_chunks()
    bounds, flat = np.asarray(lists.offsets), np.asarray(lists.values)
    values, at, df = np.unique(flat[bounds[0] : bounds[-1]], return_inverse=True, return_counts=True)
    place = np.full(len(values), -1)
    common = np.flatnonzero(df > 1)
    place[common] = np.arange(len(common))
    row = np.empty(max(len(common), 1), dtype=bool)
    bits = np.zeros((len(label), (len(row) + 63) // 64), dtype=np.uint64)
    for i in range(len(label)):
        row[:] = False
        p = place[at[bounds[i] - bounds[0] : bounds[i + 1] - bounds[0]]]
        row[p[p >= 0]] = True
        packed = np.packbits(row)
        bits[i].view(np.uint8)[: len(packed)] = packed
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.get(x, x) != x:
            root[x] = root.get(root[x], root[x])
            x = root[x]
        return x

    last, edges = int(side.max()), []
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == last)
    for i in left.tolist():
        others = right[(label[right] != label[i]) & (100 * np.minimum(size[right], size[i]) >= percent * np.maximum(size[right], size[i]))]
        if last == 0:
            others = others[others > i]
        if not len(others):
            continue
        inter = np.bitwise_count(bits[others] & bits[i]).sum(axis=1).astype(np.int64)
        for j in others[_similar(inter, size[i], size[others], percent)].tolist():
            a, b = find(int(label[i])), find(int(label[j]))
            if a != b:
                root[max(a, b)] = min(a, b)
                edges.append((a, b))
    return pa.table({"a": pa.array([e[0] for e in edges], pa.int64()), "b": pa.array([e[1] for e in edges], pa.int64())})


def _hot(shared: DataFrame) -> Column:
    """Whether a row's `cell` is a hot one of shared(cell, many)."""
    total = shared.agg(F.sum("many")).first()[0] or 0
    found = [r.cell for r in shared.where(F.col("many") * HOT_SHARE > total).select("cell").collect()]
    return F.expr(f"cell IN ({', '.join(f'{c}L' for c in found)})") if found else F.lit(False)


def _salt(hot: Column, *by: str) -> Column:
    """The salt of a row of a bucket: one of SALTS where the bucket is hot, else 0."""
    return F.when(hot, F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int")).otherwise(0).alias("salt")


def _spread(df: DataFrame, hot: Column) -> DataFrame:
    """df, which has one row or a few for each bucket, with a row for each salt of the bucket."""
    return df.withColumn("salt", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))


def _blocks(spark: SparkSession, cells: DataFrame, compared: DataFrame, hot: Column) -> tuple[DataFrame, DataFrame]:
    """Members (cell, part, k, id, label) of buckets that need comparing, by blocks (part, k) of a bucket, and the pairs
    (cell, part, k, part2, k2) of blocks to compare. cells(cell, salt, id, label, n), compared(id, leader): done already.
    part: the label of a part that fills blocks of its own, or -1 for all smaller ones. Members are stored before their blocks
    are paired, so that both come from the same dealing; room is counted in whole numbers for the same reason."""
    of = cells.join(compared, "id", "left").groupBy("cell")
    seen = of.agg(
        F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("many"), F.min("id").alias("first"), F.max("id").alias("last"),
        F.bit_xor(F.xxhash64("id")).alias("all"), F.max_by("leader", "id").alias("leader"),
    )
    open_ = seen.where("lo < hi AND NOT (many = 2 AND leader <=> first)").groupBy("many", "first", "last", "all").agg(F.min("cell").alias("cell")).select("cell")
    member = cells.join(_spread(open_, hot), ["cell", "salt"])
    room = F.sum(F.greatest(F.col("n"), F.lit(-(-BLOCK_SHINGLES // BLOCK_CLASSES))))
    needed = F.ceil(F.col("room") / BLOCK_SHINGLES)
    parts = member.groupBy("cell", "label").agg(room.alias("room"))
    own = _spread(parts.where(F.col("room") > BLOCK_SHINGLES).select("cell", "label", needed.alias("nb")), hot)
    rest = _spread(parts.where(F.col("room") <= BLOCK_SHINGLES).groupBy("cell").agg(F.sum("room").alias("room")).select("cell", needed.alias("ns")), hot)
    dealt = member.join(own, ["cell", "salt", "label"], "left").join(rest, ["cell", "salt"], "left").select(
        "cell", F.when(F.col("nb").isNull(), F.lit(-1).cast("long")).otherwise(F.col("label")).alias("part"),
        F.when(F.col("nb").isNull(), F.pmod(F.xxhash64("label"), F.col("ns"))).otherwise(F.pmod(F.xxhash64("id"), F.col("nb"))).alias("k"), "id", "label",
    )
    dealt = stored(spark, dealt, "blocks")
    block = dealt.groupBy("cell", "part", "k").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
    two = _spread(block.select("cell", F.col("part").alias("part2"), F.col("k").alias("k2")), hot)
    apart = F.struct("part", "k") < F.struct("part2", "k2")
    inside = (F.col("part") == F.col("part2")) & (F.col("k") == F.col("k2")) & (F.col("lo") < F.col("hi"))
    met = block.withColumn("salt", _salt(hot, "part", "k")).join(two, ["cell", "salt"])
    return dealt, met.where(inside | (apart & ((F.col("part") == -1) | (F.col("part") != F.col("part2"))))).select("cell", "part", "k", "part2", "k2")


def _keyed(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) with a key `id` that is never null: for rows without a doc_id, a large number made of the text."""
    alone = F.lit(1 << 62) + F.pmod(F.xxhash64("text"), F.lit(1 << 62))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("id", F.coalesce("doc_id", alone))


def classes(spark: SparkSession, docs: DataFrame, percent: int = PERCENT, bands: int = BANDS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs(doc_id, text); links from a similarity of `percent` on."""
    docs = _keyed(docs)
    sketch = stored(spark, sketched(docs.select(F.struct("id", "doc_id").alias("key"), "text"), "key", n_bands=bands).select("key.id", "key.doc_id", "n_shingles", "d1", "d2", "bands"), "sketch")
    # one class for equal sets, named by its least key
    same = sketch.where("n_shingles > 0").groupBy("d1", "d2").agg(F.min_by(F.struct("id", F.col("n_shingles").alias("n"), "bands"), "id").alias("c"))
    named = stored(spark, same.select("d1", "d2", "c.id", "c.n", "c.bands"), "classes")
    cells = named.select("id", F.explode("bands").alias("cell"))
    met = cells.groupBy("cell").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("many")).where("lo < hi")
    shared = stored(spark, met.select("cell", "many"), "shared")
    hot = _hot(shared)
    cells = stored(spark, cells.withColumn("salt", _salt(hot, "id")).join(_spread(shared.select("cell"), hot), ["cell", "salt"]), "cells")
    wanted = stored(spark, cells.select("id").distinct(), "wanted")
    texts = sifted(docs.select("id", "text"), "id", wanted, wanted.count())  # before they are shuffled
    sets = stored(spark, _sets(texts.join(wanted, "id", "left_semi")), "sets")
    # shingles of one candidate alone: too many of them, and no other can be near enough
    single = sets.select("id", F.explode("s").alias("h")).groupBy("h").agg(F.min("id").alias("id"), F.count("*").alias("c")).where("c = 1").groupBy("id").agg(F.count("*").alias("u"))
    alive = stored(spark, sets.select("id", "n").join(single, "id", "left").where(100 * (F.col("n") - F.coalesce("u", F.lit(0))) >= percent * F.col("n")).select("id", "n"), "alive")
    buckets = cells.join(alive, "id")
    leader = _spread(buckets.groupBy("cell").agg(F.min("id").alias("leader")), hot)
    pairs = stored(spark, buckets.join(leader, ["cell", "salt"]).where("leader < id").groupBy("id").agg(F.min("leader").alias("leader")), "pairs")
    one, two = sets.select("id", "n", "s"), sets.select(F.col("id").alias("leader"), F.col("n").alias("n2"), F.col("s").alias("s2"))
    near = pairs.join(one, "id").join(two, "leader").where(_similar(F.size(F.array_intersect("s", "s2")), F.col("n"), F.col("n2"), percent))
    part = connected(spark, near.select(F.col("leader").alias("a"), F.col("id").alias("b"))).select("id", F.col("component_id").alias("label"))
    dealt, duo = _blocks(spark, buckets.join(part, "id", "left").withColumn("label", F.coalesce("label", "id")), pairs, hot)
    task = duo.withColumn("one", F.struct("part", "k", F.lit(0).alias("side"))).withColumn("two", F.struct(F.col("part2").alias("part"), F.col("k2").alias("k"), F.lit(1).alias("side")))
    same_block = (F.col("part") == F.col("part2")) & (F.col("k") == F.col("k2"))
    task = task.select("cell", F.struct("part", "k", "part2", "k2").alias("duo"), F.explode(F.when(same_block, F.array("one")).otherwise(F.array("one", "two"))).alias("x")).select("cell", "duo", "x.part", "x.k", "x.side")
    group = dealt.join(task, ["cell", "part", "k"]).join(sets, "id").select("cell", "duo", "label", "side", "n", "s")
    more = connected(spark, group.groupBy("cell", "duo").applyInArrow(lambda key, g: _compared(g, percent), "a long, b long")).select(F.col("id").alias("label"), "component_id")
    dropped(spark, shared, cells, wanted, sets, alive, pairs, dealt)
    final = named.select("d1", "d2", "id").join(part, "id", "left").withColumn("label", F.coalesce("label", "id")).join(more, "label", "left").select("d1", "d2", F.coalesce("component_id", "label").alias("component_id"))
    out = sketch.select("doc_id", "n_shingles", "d1", "d2").join(final, ["d1", "d2"], "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    if not sketch.where("doc_id IS NULL AND n_shingles > 0").isEmpty():  # a component's name is a doc_id, if one of its rows has any
        touched = out.where("doc_id IS NULL AND n_shingles > 0").select("component_id").distinct()
        real = out.where("n_shingles > 0").join(touched, "component_id", "left_semi").groupBy("component_id").agg(F.min("doc_id").alias("real"), F.lit(True).alias("found"))
        out = out.join(real, "component_id", "left").select("doc_id", "n_shingles", F.when(F.col("found"), F.col("real")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(spark: SparkSession, docs: DataFrame, percent: int = PERCENT, bands: int = BANDS) -> DataFrame:
    """docs without all but one row of each component, with the columns they came with. Every row has a key of its own, so
    rows that repeat a doc_id, or have none, are compared like all others. The least doc_id stays, nulls last."""
    rows = stored(spark, docs.select(F.struct("*").alias("d"), F.monotonically_increasing_id().alias("row")), "rows")
    found = classes(spark, rows.select(F.col("row").alias("doc_id"), "d.text"), percent, bands).where("n_shingles > 0").select(F.col("doc_id").alias("row"), "component_id")
    found = stored(spark, found.join(rows.select("row", "d.doc_id"), "row"), "found")
    best = found.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("least")).select("least.row")
    gone = found.join(best, "row", "left_anti").select("row")
    return rows.join(stored(spark, gone, "gone"), "row", "left_anti").select("d.*")


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(spark, table(spark, sf_dir, "documents"))
