"""Quality rules by weak supervision, all in DataFrame functions.

Each rule looks at one feature of a text and votes good (1), bad (-1) or abstains (0). Expectation-maximisation over the
table of vote patterns (at most 2 * 3 ** rules rows, whatever the corpus) estimates for each rule how often it is right on
good and on bad documents among those it votes on; whether it votes is taken to be independent of the class, so an abstention
has no weight. A document's posterior probability of being good replaces "all rules must pass".

What tells the classes apart: documents that fail the base rule are known to be bad while EM runs; those that AGREE or more
rules blame start as bad, all others as good; the share of good documents has a weak prior; and a vote never speaks for the
other side (a rule blames bad documents at least as often as good ones). No accuracy is pinned: a rule that alone blames many
documents loses its weight, one that blames them together with others gains some.

Defined results: null and empty texts have no words, fail the base rule and aren't kept. Very long texts are read whole, as
one row's arrays. Repeated rows and ties are judged one by one; a posterior of exactly 0.5 is kept. An empty table gives an
empty result. `with_features` keeps its columns under the prefix `q_` and overwrites columns of that name; `filter_quality`
carries the input in a struct, so its columns can have any names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import SPACES, stored, table, words

SYMBOLS = "#*$%&|<>"
WINDOW = 5
BASE_MIN_WORDS = 10
BASE_MAX_REPEAT_PERCENT = 20
EM_ROUNDS = 40
#: Rules that must blame a document for it to start as bad.
AGREE = 2


def with_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the struct column q_: counts from which base rule and voters are computed. One pass, no shuffle: windows
    are hashed, and only texts that repeat one sort their own windows."""
    t = F.coalesce(F.col(text), F.lit(""))
    step = docs.withColumn("q_words", words(F.col(text)))
    w = F.col("q_words")
    n = F.size(w)
    hashes = F.transform(F.slice(w, F.lit(1), F.greatest(n - (WINDOW - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *(F.get(w, i + k) for k in range(1, WINDOW))))
    step = step.withColumn("q_hash", hashes)
    h = F.col("q_hash")
    step = step.withColumn("q_sorted", F.when(F.size(F.array_distinct(h)) < F.size(h), F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    s = F.col("q_sorted")
    same = lambda x, other: F.coalesce(other["h"] == x["h"], F.lit(False))
    step = step.withColumn("q_at", F.sort_array(F.transform(F.filter(s, lambda x, i: same(x, F.get(s, i - 1)) | same(x, F.get(s, i + 1))), lambda x: x["i"])))
    at = F.col("q_at")
    repeat = F.aggregate(F.transform(at, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(at, i + 1), p + WINDOW) - p)), F.lit(0), lambda a, x: a + x)
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0)
    step = step.withColumn("q_lines", lines)
    many = lambda what: F.regexp_count(t, F.lit(what)).cast("long")  # noqa: E731  (a quarter of the time of a translate)
    blank = "\\x20\\x09-\\x0D"
    chars = F.length(t) - many(f"[{blank}]")
    return step.withColumn(
        "q_",
        F.struct(
            n.cast("long").alias("n_words"),
            chars.alias("word_chars"),
            many(f"[{SYMBOLS}]").alias("n_symbols"),
            many(f"[{SYMBOLS}]+").alias("n_symbol_runs"),
            (chars - many(f"[^\\p{{L}}\\p{{N}}{blank}]")).alias("n_alnum"),
            F.size("q_lines").cast("long").alias("n_lines"),
            (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("long").alias("n_dup_lines"),
            F.coalesce(repeat, F.lit(0)).cast("long").alias("n_repeat_words"),
            many("\\p{Lu}").alias("n_upper"),
            many("!").alias("n_shouts"),
            many("[.?;:]").alias("n_stops"),
        ),
    ).drop("q_words", "q_hash", "q_sorted", "q_at", "q_lines")


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def votes(q: str = "q_") -> dict[str, Column]:
    """The rules. A rule votes only where its feature says something; between its two thresholds it abstains."""
    f = lambda k: F.col(f"{q}.{k}")
    n, chars = f("n_words"), F.greatest(f("word_chars"), F.lit(1))
    per_word = lambda k: f(k) / F.greatest(n, F.lit(1))
    enough = n >= 10
    return {
        "symbols": _vote(f("n_symbols") > 0.03 * chars, f("n_symbols") <= 0.005 * chars),
        "symbol_runs": _vote(f("n_symbol_runs") > 0.1 * n, f("n_symbol_runs") <= 0.03 * n),
        "signs": _vote(enough & (f("n_alnum") < 0.8 * chars), f("n_alnum") >= 0.9 * chars),
        "capitals": _vote(enough & (f("n_upper") > 0.3 * chars), f("n_upper") < 0.12 * chars),
        "shouting": _vote(enough & (per_word("n_shouts") > 0.2), per_word("n_shouts") < 0.02),
        "lines": _vote(f("n_dup_lines") >= F.greatest(F.lit(2), 0.25 * f("n_lines")), f("n_dup_lines") == 0),
        "windows": _vote(f("n_repeat_words") > 0.15 * n, f("n_repeat_words") <= 0.02 * n),
        "length": _vote(n < 5, n >= 30),
        "word_length": _vote(enough & ((f("word_chars") > 15 * n) | (f("word_chars") < 2 * n)), (f("word_chars") <= 11 * n) & (f("word_chars") >= 3 * n)),
        "stops": _vote((n >= 60) & (per_word("n_stops") < 0.005), per_word("n_stops") >= 0.02),
    }


@dataclass
class LabelModel:
    """prior: share of good documents. right[rule] = (P(votes good | good, votes), P(votes bad | bad, votes))."""

    prior: float
    right: dict[str, tuple[float, float]]

    def posterior(self, vote: dict[str, Column]) -> Column:
        """Probability of good, from the votes; an abstention says nothing."""
        odds = F.log(F.lit(self.prior / (1 - self.prior)))
        for rule, (good, bad) in self.right.items():
            odds = odds + F.when(vote[rule] == 1, F.log(F.lit(good / (1 - bad)))).when(vote[rule] == -1, F.log(F.lit((1 - good) / bad))).otherwise(0.0)
        return 1 / (1 + F.exp(-odds))


#: EM over the array p of vote patterns (v: votes, n: documents, known: known to be bad). g is the good documents' share of n.
_ROUNDS = """
aggregate(sequence(1, {rounds}), named_struct('start', true, 'prior', 0.8D, 'good', array_repeat(0.99D, {n}), 'bad', array_repeat(0.15D, {n})), (s, r) ->
  transform(array(transform(p, x -> named_struct('v', x.v, 'n', x.n, 'g', CASE WHEN x.known THEN 0D
      WHEN s.start THEN x.n * if(size(filter(x.v, y -> y = -1)) >= {agree}, 0.1D, 0.9D)
      ELSE x.n / (1 + exp(-(ln(s.prior / (1 - s.prior)) + aggregate({all}, 0D, (a, j) ->
        a + CASE x.v[j] WHEN 1 THEN ln(s.good[j] / (1 - s.bad[j])) WHEN -1 THEN ln((1 - s.good[j]) / s.bad[j]) ELSE 0D END)))) END))), e ->
    transform(array(transform({all}, j -> (aggregate(e, 0D, (a, x) -> a + if(x.v[j] = 1, x.g, 0D)) + 9.9) / (aggregate(e, 0D, (a, x) -> a + if(x.v[j] <> 0, x.g, 0D)) + 10))), good -> named_struct(
      'start', false,
      'prior', (aggregate(e, 0D, (a, x) -> a + x.g) + 4) / (aggregate(e, 0D, (a, x) -> a + x.n) + 5),
      'good', good,
      'bad', transform({all}, j -> greatest(1 - good[j], (aggregate(e, 0D, (a, x) -> a + if(x.v[j] = -1, x.n - x.g, 0D)) + 1.5) / (aggregate(e, 0D, (a, x) -> a + if(x.v[j] <> 0, x.n - x.g, 0D)) + 10)))))[0])[0])
"""


def fit(spark: SparkSession, voted: DataFrame, rules: list[str], rounds: int = EM_ROUNDS, known_bad: str | None = None) -> LabelModel:
    """EM over the counts of vote patterns, all documents counted. known_bad: a column that is true for documents known to be
    bad. Weak priors, worth ten votes a rule and class (0.99 right on good, 0.15 on bad documents) and five documents for the
    share, keep every weight finite. The pattern table has at most 2 * 3 ** len(rules) rows and is folded in one expression."""
    voted = voted.select(*rules, F.coalesce(F.col(known_bad), F.lit(False)).alias("known") if known_bad else F.lit(False).alias("known"))
    counts = voted.groupBy(*rules, "known").agg(F.count("*").cast("double").alias("n"))
    p = counts.agg(F.array_sort(F.collect_list(F.struct(F.array(*(F.col(r).cast("int") for r in rules)).alias("v"), "n", "known"))).alias("p"))
    s = p.select(F.expr(_ROUNDS.format(rounds=rounds, n=len(rules), agree=AGREE, all=f"sequence(0, {len(rules) - 1})")).alias("s")).first()["s"]
    return LabelModel(s["prior"], {r: (s["good"][j], s["bad"][j]) for j, r in enumerate(rules)})


def base_failed(q: str = "q_") -> Column:
    return (F.col(f"{q}.n_words") < BASE_MIN_WORDS) | (100 * F.col(f"{q}.n_repeat_words") > BASE_MAX_REPEAT_PERCENT * F.col(f"{q}.n_words"))


def scored(docs: DataFrame, model: LabelModel) -> DataFrame:
    """Rows that have q_, with q_good (posterior) and q_kept."""
    return docs.withColumn("q_good", model.posterior(votes())).withColumn("q_kept", ~base_failed() & (F.col("q_good") >= 0.5))


def fitted(spark: SparkSession, featured: DataFrame) -> LabelModel:
    v = votes()
    return fit(spark, featured.select(*(c.alias(r) for r, c in v.items()), base_failed().alias("failed")), list(v), known_bad="failed")


def filter_quality(spark: SparkSession, docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents worth keeping, with the columns they came with. Documents and features are stored once, so that no filter
    is pushed below the features and computes them again; as a struct, so that no column name can clash."""
    f = stored(spark, with_features(docs.select(F.struct("*").alias("d"), F.col(text).alias("t")), "t").select("d", "q_"), "quality")
    return scored(f, fitted(spark, f)).where("q_kept").select("d.*")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = stored(spark, with_features(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "q_"), "quality")
    s = scored(f, fitted(spark, f))
    return s.select("doc_id", "q_.n_words", "q_.word_chars", "q_.n_symbols", "q_.n_dup_lines", "q_.n_repeat_words", base_failed().alias("base_failed"), F.col("q_kept").alias("kept"), F.round("q_good", 6).alias("good"))
