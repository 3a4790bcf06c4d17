"""What each of five quality filters removes, alone and after the others, for every order of applying them.

Each document becomes a mask of the filters it fails. For every part and label the corpus is reduced to 32 signed parity sums
(a Walsh-Hadamard transform of the table of masks), which are inverted exactly to the number of documents of each mask. All 120
orders and the Shapley counts follow from those 32 numbers: a document that fails k filters is removed by each of them in
120 / k orders.

Defined results: a null text is empty; an empty text fails `A`, and `E` if a smaller id has an empty text too. Words are maximal
runs of other characters than white space. A row without an id is smaller than none and has no smaller one, so it never fails
`E` and no other row fails for it. Rows that repeat whole are counted one by one and don't make each other fail (their ids are
equal). A document has a label if any of its label rows has it; documents without labels count as neither good nor toxic. Part
null is the empty string. Very long texts are read whole. An empty table gives an empty result. Only the named columns are read,
so others can have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import stored, table, words

FILTERS = "ABCDE"
MIN_WORDS = 100
MIN_DISTINCT_PERCENT = 80
MAX_CAPITAL_PERCENT = 10
SIGNS = "#$%&*|"
CELLS = 1 << len(FILTERS)
LABELS = ("all", "good", "toxic")


def text_mask(text: Column) -> Column:
    """Bits 0 to 3: which of the filters A to D a text fails."""
    w, t = words(text), F.coalesce(text, F.lit(""))
    n = F.size(w)
    fails = (
        n < MIN_WORDS,
        100 * F.size(F.array_distinct(w)) < MIN_DISTINCT_PERCENT * n,
        100 * F.regexp_count(t, F.lit("[A-Z]")) > MAX_CAPITAL_PERCENT * F.length(t),
        t.rlike(f"[{SIGNS}]"),
    )
    mask = F.lit(0)
    for k, x in enumerate(fails):
        mask = mask + F.when(x, 1 << k).otherwise(0)
    return mask


def masked(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(key, part, mask, n): how many rows of this id fail exactly these filters. Texts are compared by SHA-256. The smallest id
    of each text comes from a map-side combined minimum and is matched by (id, text), so that a group of copies, however large,
    never meets in one task."""
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(part), F.lit("")).alias("part"), text_mask(F.col(text)).alias("mask"), F.unhex(F.sha2(t, 256)).alias("same"))
    rows = stored(spark, rows.groupBy("key", "same", "part", "mask").agg(F.count("*").alias("n")), "masks")
    first = rows.where("key IS NOT NULL").groupBy("same").agg(F.min("key").alias("key")).withColumn("first", F.lit(True))
    copy = F.col("key").isNotNull() & F.col("first").isNull()
    return rows.join(first, ["key", "same"], "left").select("key", "part", (F.col("mask") + F.when(copy, 16).otherwise(0)).alias("mask"), "n").groupBy("key", "part", "mask").agg(F.sum("n").alias("n"))


def parity_sums(cells: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """(part, label, w): w[s] is the number of documents that fail an even number of the filters in s, less those that fail an odd
    number."""
    has = labels.select(F.col(key).alias("key"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic")).groupBy("key").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    label = F.array_compact(F.array(F.lit("all"), F.when(F.col("good"), "good"), F.when(F.col("toxic"), "toxic")))
    rows = cells.join(has, "key", "left").select("part", "mask", "n", F.explode(label).alias("label"))
    sign = lambda s: 1 - 2 * (F.bit_count(F.col("mask").bitwiseAND(s)) % 2)
    sums = rows.groupBy("part", "label").agg(*(F.sum(F.col("n") * sign(s)).alias(f"w{s}") for s in range(CELLS)))
    return sums.select("part", "label", F.array(*(f"w{s}" for s in range(CELLS))).alias("w"))


#: The inverse transform, exact: each sum is divisible by the number of cells.
_INVERSE = f"transform(sequence(0, {CELLS - 1}), m -> aggregate(sequence(0, {CELLS - 1}), 0L, (a, s) -> a + w[s] * (1 - 2 * (bit_count(m & s) % 2))) div {CELLS})"

#: All orders, letter by letter.
_ORDERS = f"""aggregate(sequence(1, {len(FILTERS)}), array(''), (found, i) -> flatten(transform(found, o ->
  transform(filter(split('{FILTERS}', ''), x -> NOT contains(o, x)), x -> concat(o, x)))))"""


def audited(sums: DataFrame) -> DataFrame:
    """One row for each part, order and step, from the parity sums."""
    cells = sums.select("part", "label", F.expr(_INVERSE).alias("c"))
    none = F.array_repeat(F.lit(0).cast("long"), CELLS)
    by = F.map_from_entries(F.collect_list(F.struct("label", "c")))
    parts = cells.groupBy("part").agg(by.alias("by")).select("part", *(F.coalesce(F.col("by")[x], none).alias(x) for x in LABELS))
    steps = parts.withColumn("filter_order", F.explode(F.expr(_ORDERS))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    bits = lambda letters: f"aggregate(sequence(0, {len(FILTERS) - 1}), 0, (a, k) -> a + if(contains({letters}, substr('{FILTERS}', k + 1, 1)), shiftleft(1, k), 0))"
    steps = steps.withColumn("own", F.expr(bits("substr(filter_order, step, 1)"))).withColumn("before", F.expr(bits("substr(filter_order, 1, step - 1)")))
    total = lambda cells, mask, value="c": F.expr(f"aggregate(transform({cells}, (c, m) -> if({mask}, {value}, 0L)), 0L, (a, c) -> a + c)")
    removed = "(m & own) <> 0 AND (m & before) = 0"
    return steps.select(
        "part", "filter_order", "step",
        total("all", "(m & (own | before)) = 0").alias("kept"),
        total("all", removed).alias("removed"),
        total("all", "(m & own) <> 0 AND (m & before) <> 0").alias("redundant"),
        total("all", "m = own").alias("unique_fails"),
        total("good", removed).alias("good_lost"),
        total("toxic", removed).alias("toxic_lost"),
        total("all", "(m & own) <> 0", "c * (120 div bit_count(m))").alias("shapley"),
    )


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audited(parity_sums(masked(spark, table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels")))


#: By definition: every document through every order.
ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, part, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS lo FROM d),
m AS (SELECT w.doc_id, part, len(ws) < 100 AS a, 100 * len(list_distinct(ws)) < 80 * len(ws) AS b,
    100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
    coalesce(lo < w.doc_id, false) AS e, coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic
  FROM w LEFT JOIN (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id) l ON l.doc_id = w.doc_id),
f AS (SELECT part, good, toxic, (CASE WHEN a THEN 'A' ELSE '' END) || (CASE WHEN b THEN 'B' ELSE '' END) || (CASE WHEN c THEN 'C' ELSE '' END)
    || (CASE WHEN d THEN 'D' ELSE '' END) || (CASE WHEN e THEN 'E' ELSE '' END) AS fails, count(*) AS n FROM m GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS own, substr(filter_order, 1, step - 1) AS prior
  FROM o, (SELECT unnest(range(1, 6)) AS step)),
r AS (SELECT part, filter_order, step, own, n, good, toxic, contains(fails, own) AS failing,
    len(list_intersect(string_split(fails, ''), string_split(prior, ''))) > 0 AND fails <> '' AND prior <> '' AS gone, fails = own AS alone FROM s, f),
g AS (SELECT part, filter_order, step, own,
    sum(CASE WHEN NOT gone AND NOT failing THEN n ELSE 0 END) AS kept, sum(CASE WHEN NOT gone AND failing THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN gone AND failing THEN n ELSE 0 END) AS redundant, sum(CASE WHEN alone THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN NOT gone AND failing AND good THEN n ELSE 0 END) AS good_lost, sum(CASE WHEN NOT gone AND failing AND toxic THEN n ELSE 0 END) AS toxic_lost
  FROM r GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM g
"""
