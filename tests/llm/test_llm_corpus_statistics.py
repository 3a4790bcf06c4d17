"""Operators 11 to 13 against plain Python on texts that are null, empty, blank, very long, repeated and tied."""

import collections
import itertools
import math
import os
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessitura.llm import audit, automaton, divergence

SCHEMA = "doc_id long, text string, lang string, source string"
SPLIT = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
RNG = np.random.default_rng(11)
VOCAB = [f"wort{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]


def prose(n, most=200):
    return " ".join(RNG.choice(VOCAB[:most], n))


TEXTS = [None, "", " \t\n", "a", "A b A b", "Ünïcode 中文 x9y-z \x1cq\x1d", prose(5000), "AB CD EF " * 60, "same text here", "same text here", "same text here", None, ""]
TEXTS += [prose(int(n), int(m)) for n, m in zip(RNG.integers(1, 300, 60), RNG.integers(5, 200, 60), strict=True)]
TEXTS += ["price $5 & more " + prose(120), prose(150, 150) + " #tag", TEXTS[20], TEXTS[21], TEXTS[21]]
ROWS = [(None if i % 17 == 16 else i, t, None if i % 7 == 6 else "en" if i % 2 else "de", None if i % 5 == 4 else f"s{i % 3}") for i, t in enumerate(TEXTS)]
ROWS += [ROWS[3], ROWS[20], ROWS[16]]  # rows that repeat whole


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def clash(docs):
    return docs.select("*", *(F.lit(k).alias(n) for k, n in enumerate(["key", "block", "part", "mask", "n", "same", "term", "slice", "seat", "value", "train", "held_out", "label", "first"])))


# ------------------------------------------------------------------ language-model scores

def expected_scores(rows, order, prior):
    tokens = [[*SPLIT.findall(lower(t)), None] for _, t, *_ in rows]
    apart = [k is not None and zlib.crc32(str(k).encode()) % 7 == 2 for k, *_ in rows]
    seen = [collections.Counter(tuple(w[a : a + k + 1]) for w, x in zip(tokens, apart, strict=True) if not x for a in range(len(w) - k)) for k in range(order)]
    n, v = sum(seen[0].values()), len(seen[0])

    def p(gram):
        if len(gram) == 1:
            return (seen[0][gram] + 1) / (n + v + 1)
        return (seen[len(gram) - 1][gram] + prior * p(gram[1:])) / (seen[len(gram) - 2][gram[:-1]] + prior)

    for (key, *_), w, x in zip(rows, tokens, apart, strict=True):
        base = sum(math.log10(p((y,))) for y in w)
        score = sum(math.log10(p(tuple(w[max(0, j - order + 1) : j + 1]))) for j in range(len(w)))
        yield key, x, len(w), sum(seen[0][(y,)] > 0 for y in w), n, base, score


@pytest.mark.parametrize(("order", "block", "lane"), [(2, 1 << 22, 128), (3, 3000, 16), (4, 500, 3), (1, 2000, 7)])
def test_scores_like_a_loop(spark, docs, order, block, lane, monkeypatch):
    for name, x in (("BLOCK", block), ("SHARD", 4 * block), ("LANE", lane)):
        monkeypatch.setattr(automaton, name, x)
    got = sorted((tuple(r) for r in automaton.scored(docs, order=order, prior=2.5).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[2], r[6]))
    want = sorted(expected_scores(ROWS, order, 2.5), key=lambda r: (r[0] is None, r[0] or 0, r[2], r[6]))
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], abs=1e-8) and a[6] == pytest.approx(b[6], abs=1e-8)


def test_probabilities_of_a_state_add_up_to_one():
    """Over all tokens of the vocabulary and the unknown one, from every state."""
    import pyarrow as pa

    texts = [prose(40, 12) for _ in range(6)]
    g = automaton.Grams(pa.chunked_array([pa.array([*texts, "zz"])]), 3)
    train = np.array([True] * 6 + [False])
    totals = [g.counts(k, train) for k in range(3)]
    n, v = int(totals[0].sum()), int((totals[0] > 0).sum())
    model = automaton.Automaton(g, totals, n, v, 1.5)
    states = np.arange(len(model.fail))
    total = np.zeros(len(states))
    for token in range(g.n):  # all tokens of training, and zz for any other
        total += 10 ** model.step(states, np.full(len(states), token))[1]
    assert g.n == v + 1 and np.allclose(total, 1.0)


def test_nothing_to_learn_from(spark, none):
    assert automaton.scored(none).count() == 0
    got = automaton.scored(spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string"), apart=F.lit(True)).collect()
    assert sorted((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["score"]) for r in got) == [(1, 3, 0, 0, 0.0), (2, 1, 0, 0, 0.0)]


def test_scores_with_clashing_columns(spark, docs):
    a, b = (sorted(map(str, automaton.scored(x).collect())) for x in (docs, clash(docs)))
    assert a == b


def test_held_out_texts_gain_from_context(spark, tmp_path):
    """Texts of a fixed order of words are likelier under the model than word by word, also those it hasn't learned from."""
    rows = [(i, " ".join(VOCAB[(i + k) % 200] for k in range(50))) for i in range(300)]
    got = automaton.scored(spark.createDataFrame(rows, "doc_id long, text string")).where("held_out").collect()
    assert len(got) > 20 and all(r["score"] > r["base_score"] for r in got)


# ------------------------------------------------------------------ divergence of sources

def expected_divergence(rows, least):
    occurs, docs = collections.Counter(), collections.Counter()
    groups = {(lang or "", source or "") for _, _, lang, source in rows}
    for _, t, lang, source in rows:
        found = TERM.findall(lower(t))
        for x in found:
            occurs[lang or "", source or "", x] += 1
        for x in set(found):
            docs[lang or "", x] += 1
    out = set()
    for lang in {g[0] for g in groups}:
        kept = sorted((x for (y, x), n in docs.items() if y == lang and n >= least), key=lambda x: x.encode())
        sources = sorted(s for y, s in groups if y == lang)
        count = {s: [occurs[lang, s, x] for x in kept] for s in sources}
        count[None] = [sum(c[i] for c in count.values()) for i in range(len(kept))]
        p = {s: [1 + (10**9 * (x + 5)) // (sum(c) + 5 * len(kept)) for x in c] for s, c in count.items()}
        for s in sources:
            pairs = sorted((-sum(abs(x - y) for x, y in zip(p[s], p[o], strict=True)), o.encode(), o) for o in sources if o != s)
            terms = sorted((y - x, t.encode(), t) for t, n, x, y in zip(kept, count[s], p[s], p[None], strict=True) if n and x > y)
            out |= {(lang, s, "pair", o, -v, k) for k, (v, _, o) in enumerate(pairs, 1)}
            out |= {(lang, s, "term", t, -v, k) for k, (v, _, t) in enumerate(terms[:50], 1)}
    return out


@pytest.mark.parametrize(("slices", "seat"), [(16384, 8), (20, 1)])
def test_divergence_like_a_loop(spark, docs, slices, seat, monkeypatch):
    for name, x in (("SLICE", slices), ("PER_SEAT", seat), ("CHUNK", 2000), ("SHARD", 5000)):
        monkeypatch.setattr(divergence, name, x)
    got = [tuple(r) for r in divergence.diverging(spark, docs, min_docs=4).collect()]
    assert len(set(got)) == len(got) and set(got) == expected_divergence(ROWS, 4)
    assert [tuple(r) for r in divergence.diverging(spark, clash(docs), min_docs=4).collect() if tuple(r) not in set(got)] == []


def test_divergence_of_a_task_with_several_batches(spark, docs):
    """A table of texts counted at once is made of Arrow batches; a text keeps its language and source in each."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "4")
    try:
        got = [tuple(r) for r in divergence.diverging(spark, docs, min_docs=4).collect()]
    finally:
        spark.conf.set(name, before)
    assert len(set(got)) == len(got) and set(got) == expected_divergence(ROWS, 4)


def test_divergence_of_nothing(spark, none):
    assert divergence.diverging(spark, none).count() == 0
    rows = [(1, "a", "en", "x"), (2, None, "en", "y"), (3, "b", "de", "x")]
    got = {tuple(r) for r in divergence.diverging(spark, spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)}


def test_every_pair_of_seats_meets_once(spark):
    for seats in (2, 4, 10, 16):
        met = collections.Counter()
        for r in range(seats - 1):
            rows = spark.range(seats).select(F.col("id").cast("int").alias("seat")).select("seat", divergence.partner(F.col("seat"), F.lit(seats), r).alias("met")).collect()
            at = {x["seat"]: x["met"] for x in rows}
            assert all(at[b] == a != b for a, b in at.items())
            met.update(frozenset(x) for x in at.items())
        assert set(met.values()) == {seats - 1 and 2} and len(met) == seats * (seats - 1) // 2


def test_shares_are_exact_where_products_overflow():
    counts, total, many = np.array([0, 5, 10**14, 3 * 10**14]), 4 * 10**14, 17
    assert divergence.shares(counts, total, many).tolist() == [1 + 10**9 * (int(c) + 5) // (total + 5 * many) for c in counts]


def test_vectors_survive_packing():
    ids, n = np.array([0, 3, 70000]), np.array([1, 2**40, 7])
    a, b = divergence.unpacked(divergence.packed(ids, n))
    assert a.tolist() == ids.tolist() and b.tolist() == n.tolist()


# ------------------------------------------------------------------ filter audit

def expected_audit(rows, labels):
    first = {}
    for k, t, *_ in rows:
        if k is not None:
            first[t or ""] = min(k, first.get(t or "", k))
    cases = []
    for k, t, lang, _ in rows:
        t = t or ""
        w = SPLIT.findall(t)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": k is not None and first[t] < k}
        mine = [x for x in labels if k is not None and x[0] == k]
        cases.append((lang or "", {x for x, y in fails.items() if y}, any(x[1] == 1 for x in mine), any(x[2] == 1 for x in mine)))
    removed_by, out = collections.Counter(), {}
    parts = {c[0] for c in cases}
    for order in itertools.permutations("ABCDE"):
        for part in parts:
            left = [c for c in cases if c[0] == part]
            for step, x in enumerate(order, 1):
                gone = [c for c in left if x in c[1]]
                left = [c for c in left if x not in c[1]]
                failing = [c for c in cases if c[0] == part and x in c[1]]
                removed_by[part, x] += len(gone)
                out[part, "".join(order), step] = (len(left), len(gone), len(failing) - len(gone), sum(c[1] == {x} for c in failing), sum(c[2] for c in gone), sum(c[3] for c in gone))
    return {(*k, *v, removed_by[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_like_a_loop(spark, docs):
    labels = [(i, i % 2, (i // 2) % 2) for i in range(0, 80, 3)] + [(3, 0, 1), (3, 1, 0), (None, 1, 1), (9999, 1, 1), (6, None, None)]
    table = spark.createDataFrame(labels, "doc_id long, quality long, toxic long")
    for given in (docs, clash(docs)):
        got = [tuple(r) for r in audit.audited(audit.parity_sums(audit.masked(spark, given), table)).collect()]
        assert len(got) == 3 * 600 and set(got) == expected_audit(ROWS, labels)


def test_audit_of_nothing(spark, none):
    assert audit.audited(audit.parity_sums(audit.masked(spark, none), spark.createDataFrame([], "doc_id long, quality long, toxic long"))).count() == 0


def test_parity_sums_are_inverted_exactly(spark):
    rng = np.random.default_rng(3)
    n = rng.integers(0, 10**15, 32).tolist()
    cells = spark.createDataFrame([(k, "p", k, x) for k, x in enumerate(n)], "key long, part string, mask int, n long")
    sums = audit.parity_sums(cells, spark.createDataFrame([], "doc_id long, quality long, toxic long"))
    assert sums.select(F.expr(audit._INVERSE)).first()[0] == n


# ------------------------------------------------------------------ registered queries with SQL

@pytest.mark.parametrize("name", ["op12_source_divergence", "op13_filter_audit"])
def test_query_equals_its_sql(spark, name):
    import duckdb

    from tessitura.llm import queries

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for x in ("documents", "labels"):
        path = f"{sf}/{x}.parquet"
        con.execute(f"CREATE VIEW {x} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    want = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(tuple(r) for r in queries.queries()[name](spark, sf).select(*columns).collect()) == sorted(want.fetchall())
