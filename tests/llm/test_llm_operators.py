"""The training-data operators against brute force, round trips and edge cases.

EDGES holds null, empty, blank, very long, repeated and tied texts; every operator runs on it, on an empty table and with
columns whose names clash with its own."""

import collections
import hashlib
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessitura.llm import bpe, chat, language, licenses, neardup, packing, quality, shared, substrings, urls, vectors

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
RNG = np.random.default_rng(5)
SPLIT = re.compile(r"[^\x20\x09-\x0D]+")
VOCAB = [f"w{i}" for i in range(400)]


def prose(n, rng=RNG):
    return " ".join(rng.choice(VOCAB, n))


PASSAGE, BASE = prose(60), prose(300)
COPIES = [" ".join(f"x{i}{k}" if RNG.random() < 0.01 else w for k, w in enumerate(BASE.split())) for i in range(12)]
EDGES = [
    None, "", " \t\n", "a", "one two three four", "one two three four", prose(34), PASSAGE, prose(20) + " " + PASSAGE + " " + prose(15), BASE, BASE, BASE, *COPIES,
    "a " * 200, "Üben ist \x1cgut\x1d <|endoftext|> x<|startoftext|>y İΣ ﬁ 中文 😀", prose(30_000), "dup line here\n" * 30 + prose(20), "### *** $$$ %%% " * 30 + prose(30),
    "Licensed under CC\nBY-NC 4.0. Under the MIT license, under the mit LICENSE", "".join(map(chr, range(1, 200))),
]
ROWS = [(i, t, None if i % 5 == 0 else "en" if i % 2 else "de", None if i % 3 else "s", len(t or "")) for i, t in enumerate(EDGES)]
ROWS += [ROWS[9], ROWS[0], ROWS[7]]  # rows that repeat whole


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return SPLIT.findall(t or "")


def clash(docs):
    """docs with columns named as those that operators make."""
    return docs.select("*", *(F.lit(k).alias(n) for k, n in enumerate(["q_", "q_words", "key", "k", "n", "spans", "s_words", "kept", "lang_pred", "score", "component_id", "b_block", "t", "d", "id", "h", "l_text", "q_good", "q_kept"])))


# ------------------------------------------------------------------ quality

def features(t):
    t = t or ""
    w = words(t)
    c, cover = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)), set()
    for i in range(len(w) - 4):
        if c[tuple(w[i : i + 5])] > 1:
            cover.update(range(i, i + 5))
    lines = [x for x in t.split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover)


def test_quality_features_and_verdicts(spark, docs, none):
    f = quality.with_features(docs)
    model = quality.fitted(spark, f)
    got = quality.scored(f, model).select("doc_id", "q_.*", "q_good", "q_kept", quality.base_failed().alias("base")).collect()
    assert len(got) == len(ROWS)
    for r in got:
        n, chars, symbols, lines, repeat = features(EDGES[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, lines, repeat)
        assert r["base"] == (n < 10 or 100 * repeat > 20 * n)
        assert 0 <= r["q_good"] <= 1 and not (r["base"] and r["q_kept"])
    assert quality.filter_quality(spark, none).columns == none.columns and quality.filter_quality(spark, none).count() == 0
    assert quality.filter_quality(spark, clash(docs)).columns == clash(docs).columns


def test_quality_model_finds_planted_junk(spark):
    rng = np.random.default_rng(2)
    rows = [(i, prose(100, rng) + ".") for i in range(300)] + [(300 + i, "### $$$ *** " * 20 + prose(40, rng)) for i in range(30)] + [(400 + i, prose(60, rng).upper() + "!! " * 40) for i in range(20)]
    kept = {r["doc_id"] for r in quality.filter_quality(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == set(range(300))


def test_em_is_what_a_loop_gives(spark):
    rules, table = ["symbols", "length", "lines"], [(1, 1, 1, False, 80), (-1, 1, -1, False, 10), (1, -1, 1, False, 5), (0, 0, 1, False, 7), (-1, 0, 1, False, 3), (-1, -1, 1, True, 4), (1, 1, 1, True, 2)]
    voted = spark.createDataFrame([tuple(v) for *v, n in table for _ in range(n)], "symbols int, length int, lines int, failed boolean")
    got = quality.fit(spark, voted, rules, rounds=6, known_bad="failed")
    prior = good = bad = None
    for k in range(6):
        e = []
        for *v, known, n in table:
            if k:
                odds = np.log(prior / (1 - prior)) + sum(np.log(good[j] / (1 - bad[j])) if x == 1 else np.log((1 - good[j]) / bad[j]) if x == -1 else 0 for j, x in enumerate(v))
            e.append((v, n, 0 if known else n / (1 + np.exp(-odds)) if k else n * (0.1 if v.count(-1) >= 2 else 0.9)))
        prior = (sum(x[2] for x in e) + 4) / (sum(x[1] for x in e) + 5)
        good = [(sum(g for v, n, g in e if v[j] == 1) + 9.9) / (sum(g for v, n, g in e if v[j]) + 10) for j in range(3)]
        bad = [max(1 - good[j], (sum(n - g for v, n, g in e if v[j] == -1) + 1.5) / (sum(n - g for v, n, g in e if v[j]) + 10)) for j in range(3)]
    assert np.isclose(got.prior, prior) and np.allclose([got.right[r] for r in rules], list(zip(good, bad, strict=True)))


def test_em_estimates_planted_accuracies(spark):
    """Two classes, rules of known accuracy that abstain a fifth of the time, an eighth of the bad documents known."""
    rng, n = np.random.default_rng(31), 20_000
    rules = list(quality.votes())
    right = [(0.97 - 0.015 * j, 0.4 + 0.05 * j) for j in range(len(rules))]
    good = rng.random(n) < 0.75
    cols = []
    for a, b in right:
        says_good = np.where(good, rng.random(n) < a, rng.random(n) >= b)
        cols.append(np.where(rng.random(n) < 0.2, 0, np.where(says_good, 1, -1)))
    known = ~good & (rng.random(n) < 0.125)
    voted = spark.createDataFrame([(*map(int, r), bool(k)) for *r, k in zip(*cols, known, strict=True)], ", ".join(f"{r} int" for r in rules) + ", failed boolean")
    model = quality.fit(spark, voted, rules, known_bad="failed")
    assert abs(model.prior - good.mean()) < 0.03
    for r, (a, b) in zip(rules, right, strict=True):
        assert abs(model.right[r][0] - a) < 0.03 and abs(model.right[r][1] - b) < 0.03


def test_one_bad_vote_can_be_overruled(spark):
    """Prose without full stops stays, whether it is a seventh of a table or all of it; so does prose in a table of bad documents."""
    rng = np.random.default_rng(32)
    plain = [(i, prose(80, rng)) for i in range(40)]
    other = [(100 + i, prose(80, rng) + ".") for i in range(240)] + [(500 + i, "### $$$ *** " * 20 + prose(40, rng)) for i in range(15)]
    few = [(900 + i, "a b c") for i in range(60)]
    kept = lambda rows: {r["doc_id"] for r in quality.filter_quality(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept(plain + other) == {*range(40), *range(100, 340)}
    assert kept(plain) == set(range(40)) and kept(plain + few) == set(range(40))


# ------------------------------------------------------------------ language

def test_language_counts_like_a_counter():
    texts = ["", "12 34 !!", "abc a b", "ÀÉ é 中文字", "a" * 50, "x\ny"]
    text, gram, n = language.counted(texts)
    for i, t in enumerate(texts):
        s = " " + "".join(c if c.isalpha() else " " for c in t.lower()) + " "
        want = collections.Counter(s[j : j + k] for k in (1, 2, 3) for j in range(len(s) - k + 1) if (w := s[j : j + k]).strip() and not (k == 3 and (w[1] == " " or w[0] == w[2] == " ")))

        def spelled(v):
            out = ""
            while v:
                out, v = chr(v & 0x1FFFFF) + out, v >> 21
            return out

        assert {spelled(int(g)): int(c) for x, g, c in zip(text, gram, n, strict=True) if x == i} == dict(want)


def test_language_held_out_accuracy(spark):
    rng = np.random.default_rng(4)
    sounds = {"aa": "aeiou lmnr", "bb": "xzkqw jyoe", "cc": "stpdb aei"}
    rows = [(i, " ".join("".join(rng.choice(list(sounds[x].replace(" ", "")), 5)) for _ in range(40)), x) for i, x in enumerate(list(sounds) * 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    p = language.learned(spark, df.where(~language.held_out()))
    got = language.judged(df.select("doc_id", "text", language.held_out().alias("held_out")), p).select("d.*", "lang_pred").join(df.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 20 and np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.97


def test_language_edges(spark, docs, none):
    p = language.learned(spark, docs)
    assert set(p) == {"en", "de"}
    for r in language.judged(docs, p).select("d.doc_id", "lang_pred", "score").collect():
        letters = any(c.isalpha() for c in EDGES[r["doc_id"]] or "")
        assert (r["lang_pred"] == "und") == (not letters) and 0 <= r["score"] <= 1
    assert language.learned(spark, none) == {}
    assert {r["lang_pred"] for r in language.judged(docs, {}).collect()} == {"und"}
    assert language.judged(none, p).count() == 0
    assert language.filter_language(spark, clash(docs)).columns == clash(docs).columns
    assert language.filter_language(spark, clash(docs)).count() == language.filter_language(spark, docs).count() > 20


def test_language_distance_like_a_loop(spark):
    """Out-of-place distances by Counter and sorted lists, ties and a text longer than a slice included."""
    rng = np.random.default_rng(41)
    texts = ["", "x", "the cat sat on the mat", "der Hund und die Katze", "été à la mer", prose(20), "".join(rng.choice(list("abcde fgh"), 300_000))]
    learn = spark.createDataFrame([(i, " ".join(rng.choice(list(a), 200)), x) for x, a in (("aa", "abc de"), ("bb", "fgh ie"), ("cc", "xyz a")) for i in range(5)], "doc_id long, text string, lang string")
    p = language.learned(spark, learn)
    got = [(r["lang_pred"], r["score"]) for r in language.judged(spark.createDataFrame(list(enumerate(texts)), "n int, text string"), p).orderBy("d.n").collect()]
    for t, (lang, score) in zip(texts, got, strict=True):
        s, c = " " + "".join(x if x.isalpha() else " " for x in t.lower()) + " ", collections.Counter()
        for k in (1, 2, 3):
            for j in range(len(s) - k + 1):
                w = s[j : j + k]
                if w.strip() and not (k == 3 and (w[1] == " " or w[0] == w[2] == " ")):
                    c[sum(ord(x) << 21 * (k - 1 - i) for i, x in enumerate(w))] += 1
        top = [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))][: language.PROFILE]
        far = {x: sum(min(abs(where[g] - i), language.PROFILE) if g in where else language.PROFILE for i, g in enumerate(top)) for x in p for where in [{int(g): i for i, g in enumerate(p[x])}]}
        best = min(sorted(far), key=far.get) if top else "und"
        assert lang == best and np.isclose(score, 1 - far[best] / (len(top) * language.PROFILE) if top else 0)


# ------------------------------------------------------------------ near duplicates

def shingles(t):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def components(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(n):
        for b in range(a):
            if linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize(("size", "share"), [(256, 1024), (3, 1024), (3, 0), (3, 8)])
def test_near_dups_by_brute_force(spark, docs, none, size, share, monkeypatch):
    """Blocks of any size, and every, no and some buckets hot."""
    monkeypatch.setattr(neardup, "BLOCK_CLASSES", size)
    monkeypatch.setattr(neardup, "HOT_SHARE", share)
    s = [shingles(t) for t in EDGES]
    want = components(len(s), lambda a, b: bool(s[a]) and 100 * len(s[a] & s[b]) >= 85 * len(s[a] | s[b]))
    got = neardup.classes(spark, docs).collect()
    assert len(got) == len(ROWS)
    for r in got:
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(s[r["doc_id"]]), want[r["doc_id"]], want[r["doc_id"]] == r["doc_id"])
    if size == 3:
        assert neardup.classes(spark, none).count() == 0
        kept = neardup.keep_one(spark, clash(docs))
        assert kept.columns == clash(docs).columns and {r["doc_id"] for r in kept.select("doc_id").collect()} == set(want)


def test_salted_rows_meet_their_bucket_once(spark):
    """Rows of a hot bucket take many keys; each still meets the bucket's own row, and no bucket's row twice."""
    rows = spark.createDataFrame([(i, -7 if i % 3 else i) for i in range(3000)], "id long, cell long")
    many = rows.groupBy("cell").agg(F.count("*").alias("many"))
    hot = neardup._hot(many)
    salted = rows.withColumn("salt", neardup._salt(hot, "id"))
    keys = {r["cell"]: r["n"] for r in salted.groupBy("cell").agg(F.count_distinct("salt").alias("n")).collect()}
    assert keys.pop(-7) == neardup.SALTS and set(keys.values()) == {1}
    met = salted.join(neardup._spread(many, hot), ["cell", "salt"])
    assert met.count() == met.select("id").distinct().count() == 3000
    assert neardup._spread(many, neardup._hot(many.limit(0))).count() == many.count()


def test_many_edited_copies(spark):
    """A group of near copies around one original: links that only pairs of copies have must not be lost."""
    rng = np.random.default_rng(8)
    base, rows = prose(150, rng).split(), []
    for i in range(120):
        w = list(base)
        for k in rng.integers(0, 150, rng.integers(0, 9)):
            w[k] = f"e{rng.integers(0, 4)}"
        rows.append((i, " ".join(w)))
    s = [shingles(t) for _, t in rows]
    want = components(len(s), lambda a, b: 100 * len(s[a] & s[b]) >= 85 * len(s[a] | s[b]))
    got = {r["doc_id"]: r["component_id"] for r in neardup.classes(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(rows))] == want


def test_circulant_signatures_estimate_similarity():
    a = RNG.integers(0, 2**63, 1000, dtype=np.uint64)
    b = np.concatenate([a[:700], RNG.integers(0, 2**63, 300, dtype=np.uint64)])
    x, y = neardup.signatures([a, b], 512)
    assert abs((x == y).mean() - 700 / 1300) < 0.08


def test_connected_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100 + i, 100) for i in range(1, 40)] + [(500, 501), (501, 502), (502, 500), (7, 7)]
    got = {r["id"]: r["component_id"] for r in shared.connected(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{100 + i: 100 for i in range(40)}, 500: 500, 501: 500, 502: 500}


def test_rows_without_a_doc_id_have_their_copies_component(spark):
    rng = np.random.default_rng(42)
    a, b, c = (prose(50, rng) for _ in range(3))
    rows = [(None, a), (3, a), (9, a), (None, b), (None, b), (None, ""), (4, c), (None, " ".join(["x", *c.split()[1:]]))]
    got = sorted(map(tuple, neardup.classes(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(None, 46, 3, False), (3, 46, 3, True), (9, 46, 3, False), (None, 46, None, True), (None, 46, None, True), (None, 0, None, True), (4, 46, 4, True), (None, 46, 4, False)], key=str)


def test_templated_texts_of_half_similarity(spark, monkeypatch):
    """Many texts from one template share buckets without being near; the few real pairs among them are found."""
    monkeypatch.setattr(neardup, "BLOCK_CLASSES", 20)
    rng = np.random.default_rng(43)
    frame = prose(90, rng)
    rows = [(i, f"{frame} {prose(45, rng)}") for i in range(150)]
    rows += [(200 + k, rows[k][1] + " tail words") for k in range(0, 150, 7)]
    s = [shingles(t) for _, t in rows]
    want = components(len(s), lambda x, y: 100 * len(s[x] & s[y]) >= 85 * len(s[x] | s[y]))
    got = {r["doc_id"]: r["component_id"] for r in neardup.classes(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i, _ in rows] == [rows[c][0] for c in want] and len(set(want)) == 150


# ------------------------------------------------------------------ substrings

def stripped(texts):
    w = [words(t) for t in texts]
    c = collections.Counter(tuple(x[i : i + 35]) for x in w for i in range(len(x) - 34))
    out = []
    for x in w:
        gone = [False] * len(x)
        for i in range(len(x) - 34):
            if c[tuple(x[i : i + 35])] > 1:
                gone[i : i + 35] = [True] * 35
        out.append((len(x), sum(gone), " ".join(a for a, b in zip(x, gone, strict=True) if not b)))
    return out


@pytest.mark.parametrize("hot", [400, 1])
def test_repeats_by_brute_force(spark, docs, none, hot, monkeypatch):
    monkeypatch.setattr(substrings, "HOT", hot)
    monkeypatch.setattr(substrings, "SHARD_WORDS", 2000)
    want = {r[0]: s for r, s in zip(ROWS, stripped([r[1] for r in ROWS]), strict=True)}
    wide = clash(docs) if hot == 1 else docs
    got = substrings.remove_repeats(spark, wide)
    assert got.columns == wide.columns
    rows = got.collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        n, gone, kept = want[r["doc_id"]]
        assert r["text"] == (kept if gone else EDGES[r["doc_id"]])
    if hot == 1:
        assert substrings.remove_repeats(spark, none).count() == 0


def test_automaton_counts_places():
    a, texts = substrings.Automaton(), [[1, 2, 3, 1, 2, 3, 1], [2, 3, 1, 2], [9]]
    for t, w in zip(texts, (1, 2, 1), strict=True):
        a.add(t, w)
    a.finish()
    for t in texts:
        want = [i for i in range(len(t) - 2) if sum(w * sum(x[k : k + 3] == t[i : i + 3] for k in range(len(x) - 2)) for x, w in zip(texts, (1, 2, 1), strict=True)) > 1]
        assert a.repeated(t, 3) == want


# ------------------------------------------------------------------ tokens and packing

def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.vocabulary())


def test_bpe_equals_the_library(spark, docs, none):
    t = tokenizer()
    got = bpe.coded(clash(docs), bpe.vocabulary()).collect()
    assert len(got) == len(ROWS)
    for r in got:
        ids = t.encode(EDGES[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids"] == " ".join(map(str, ids))
        assert r["decoded"] == t.decode(ids, skip_special_tokens=False)
    assert bpe.coded(none, bpe.vocabulary(), digests=True).count() == 0


def test_bpe_of_random_text_with_a_small_table(monkeypatch):
    monkeypatch.setattr(bpe, "MAX_KEPT", 50)
    monkeypatch.setattr(bpe, "MAX_SEEN", 300)
    t, e = tokenizer(), bpe.Encoder(bpe.vocabulary())
    rng, letters = np.random.default_rng(6), list("aabbccdeé'st l\n.,!1²ßΣ<|>ñ🙂́\x85")
    texts = ["".join(rng.choice(letters, 60)) for _ in range(150)] + ["aaaa aaaaa", "<|endoftext|>" * 2]
    for text, numbers in zip(texts, e.texts(texts), strict=True):
        assert e.ids_of(numbers).tolist() == t.encode(text, add_special_tokens=False).ids


def test_packing_places_every_id_once(spark, docs, none):
    t = tokenizer()
    got = packing.pack(spark, clash(docs), bpe.vocabulary()).toPandas()
    for _, x in got.groupby("sequence_id"):
        x = x.sort_values("offset")
        assert x["offset"].tolist() == np.concatenate(([0], np.cumsum(x["length"])[:-1])).tolist() and x["length"].sum() <= 4096
    twice = collections.Counter(r[0] for r in ROWS)
    for i, text in enumerate(EDGES):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        x = got[got.doc_id == i]
        assert x["length"].sum() == twice[i] * len(ids) and set(x["doc_tokens"]) == {len(ids)}
        for r in x.itertuples():
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], dtype="<u4").tobytes())
    assert packing.pack(spark, none, bpe.vocabulary()).count() == 0


@pytest.mark.parametrize("shape", ["even", "long", "short", "one", "thin"])
def test_column_generation_meets_the_demand_with_few_bins(shape):
    """Exactly the demand, and no more sequences than the linear program's bound, its gap and one a length for rounding."""
    rng = np.random.default_rng(9)
    weight = np.arange(1, 257)
    demand = rng.integers(0, 400, 256).astype(float)
    if shape == "long":
        demand[:120] = 0
    if shape == "short":
        demand[40:] = 0
    if shape == "one":
        demand = np.where(weight == 100, 77.0, 0.0)
    if shape == "thin":
        demand = rng.integers(0, 2, 256).astype(float)
    keep = demand > 0
    began = time.perf_counter()
    made = packing.patterns(weight[keep], demand[keep], 256)
    took = time.perf_counter() - began
    total = sum(n * items for n, items in made)
    assert (total == demand[keep]).all() and all((items * weight[keep]).sum() <= 256 for _, items in made)
    bound = packing.solved(weight[keep], demand[keep], 256)[2]
    assert (demand * weight).sum() / 256 <= bound + 1e-6 or shape != "short"
    assert bound - 1e-6 <= sum(n for n, _ in made) <= bound * (1 + packing.GAP) + keep.sum() / 2 + 1 and took < 30


def test_knapsack_by_enumeration():
    value, weight = np.array([0.3, 0.45, 0.6]), np.array([2, 3, 5])
    best = max(0.3 * a + 0.45 * b + 0.6 * c for a in range(7) for b in range(5) for c in range(3) if 2 * a + 3 * b + 5 * c <= 13)
    got, many = packing.priced(value, weight, 13)
    assert np.isclose(got, best) and (many * weight).sum() <= 13 and np.isclose((many * value).sum(), best)


# ------------------------------------------------------------------ licences

def test_many_templates_cost_what_they_hit(spark, monkeypatch):
    """A thousand further templates that no file holds the words of are never walked."""
    more = tuple((f"t{i}", f"licence{i} holder{i} may use software{i} freely", (f"licence{i} holder{i}",)) for i in range(1000))
    rows = [(0, "x licence7 holder7 may use software7 freely y"), (1, "licence8 and holder8 apart"), (2, "holder9 licence9 may use"), (3, "all rights reserved"), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    idf = {h: 1.0 for h in licenses.vocabulary(licenses.BASE, licenses.TEMPLATES + more)}
    index = licenses.Index(licenses.BASE, licenses.TEMPLATES + more, idf)
    got = {r["doc_id"]: r["labels"] for r in licenses.scanned(df, index).collect()}
    assert got == {0: "t7", 1: "", 2: "", 3: "all-rights-reserved", 4: ""}
    seen = []
    monkeypatch.setattr(licenses.Postings, "holds", lambda self, text, words: seen.append(text) or False)
    raw = [t.encode() for _, t in rows if t]
    w = licenses.read(np.frombuffer(b"".join(raw), dtype=np.uint8), np.cumsum([0] + [len(t) for t in raw]))
    licenses.scan(w, index)
    assert 0 < len(seen) < 40


def test_licences_by_brute_force(spark, docs, none):
    index = licenses.weighed(docs)
    got = licenses.scanned(docs, index).collect()
    assert len(got) == len(ROWS)
    for r in got:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), EDGES[r["doc_id"]] or "")
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
        at = [(i, label) for label, p in licenses.BASE for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        assert (r["n_words"], r["n_base"]) == (len(w), len(at))
        assert (r["first_word"], r["last_word"]) == ((min(at)[0], max(at)[0]) if at else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in at})) and 0 <= r["score"] <= 1
        assert r["labels"] == brute_labels(EDGES[r["doc_id"]])
    assert licenses.scanned(none, licenses.weighed(none)).count() == 0


def brute_labels(text):
    """Labels straight from the definition: every template at every place where its first key phrase stands."""
    read = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, out = read(text), {label for label, p in licenses.BASE if re.search(rf"(^| ){p}( |$)", " ".join(read(text)))}
    for label, body, keys in licenses.TEMPLATES:
        b, k = read(body), [read(x) for x in keys]
        shift = [next(i for i in range(len(b)) if b[i : i + len(x)] == x) for x in k]
        starts = [{i - s for i in range(len(w)) if w[i : i + len(x)] == x} for x, s in zip(k, shift, strict=True)]
        for s in starts[0]:
            if all(any(abs(o - s) <= licenses.SLACK for o in other) for other in starts[1:]):
                around = set(w[max(0, s - licenses.SLACK) : max(0, s + len(b) + licenses.SLACK)])
                if len(set(b) & around) >= licenses.LEAST * len(set(b)):
                    out.add(label)
    return ",".join(sorted(out))


def test_licence_templates(spark):
    rng = np.random.default_rng(51)
    rows = ["This work is licensed under the GNU General Public License, version 3.", "All rights reserved.", "the gnu general public licence version 3", "mit license", "Permission is hereby granted, free of charge, to any person obtaining a copy", "GNU General Public License version 2 licensed under the",
            "licensed under the GNU GPL, that is the GNU General Public License, either version 3 or later", "Creative Commons Attribution-ShareAlike 4.0 International", None, ""]
    for _, body, _ in licenses.TEMPLATES:  # whole, with words lost, put in, cut off, twice, and in the middle of prose
        w = body.split()
        rows += [body, " ".join(x for x in w if rng.random() > 0.1), " ".join(y for x in w for y in ([x, "really"] if rng.random() < 0.1 else [x])), " ".join(w[: len(w) * 2 // 3]), f"{prose(30)} {body}\n{body}", f"{prose(2000)}\n{body.upper()} {prose(50)}"]
        rows.append(" ".join(rng.permutation(w)))
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["labels"] for r in licenses.scanned(clash(df), licenses.weighed(df)).collect()}
    assert got == {i: brute_labels(t) for i, t in enumerate(rows)}
    assert [got[i] for i in range(8)] == ["gpl-3", "all-rights-reserved", "", "", "mit", "gpl-2", "gpl-3", "cc-by-sa"]


# ------------------------------------------------------------------ vectors

def test_vectors_by_brute_force(spark):
    rng = np.random.default_rng(10)
    x = rng.standard_normal((400, 16))
    near = np.repeat(x[:40], 5, axis=0) + 0.12 * rng.standard_normal((200, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([x, near, x[:30], 2 * x[:5]]))]
    bad = [(9000, None), (9001, [0.0] * 16), (9002, [float("nan")] * 16), (9003, [None, *[1.0] * 15]), (9004, [1.0] * 3), (9005, []), (9006, [float("inf")] * 16)]
    df = spark.createDataFrame([*rows, *bad, rows[3]], "vec_id long, embedding array<double>").withColumn("n", F.lit(1)).withColumn("v", F.lit(2))
    got = vectors.linked(spark, df).collect()
    assert len(got) == len(rows) + len(bad) + 1
    v = np.array([r[1] for r in rows])
    v = v / np.linalg.norm(v, axis=1)[:, None]
    sim = v @ v.T >= vectors.THRESHOLD - 1e-12
    n, comp = sim.sum(axis=1) - 1, components(len(rows), lambda a, b: sim[a, b])
    mine = {r["vec_id"]: r for r in got}
    assert all(mine[i]["n_links"] == 0 and mine[i]["component_id"] == i and mine[i]["kept"] for i, _ in bad)
    assert all(mine[i]["n_links"] <= n[i] for i in range(len(rows)))
    assert sum(mine[i]["n_links"] for i in range(len(rows))) >= 0.9 * n.sum()
    assert np.mean([mine[i]["component_id"] == comp[i] for i in range(len(rows))]) > 0.97
    q = df.where("vec_id < 600 AND vec_id % 20 = 0").select("vec_id", "embedding")
    assert {r["vec_id"]: r["n_links"] for r in vectors.brute_links(df.where(F.size("embedding") == 16).where("vec_id < 9000").select("vec_id", "embedding").distinct(), q).collect()} == {i: n[i] for i in range(0, 600, 20)}
    assert vectors.linked(spark, df.limit(0)).count() == 0
    assert vectors.linked(spark, df.where("vec_id >= 9000 AND vec_id <> 9004")).count() == len(bad) - 1


def test_vectors_of_each_length_link(spark):
    rng = np.random.default_rng(61)
    x, y = rng.standard_normal((60, 16)), rng.standard_normal((6, 5))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(100 + i, v.tolist()) for i, v in enumerate(y)] + [(200, (3 * y[2]).tolist()), (201, y[2].tolist()), (300, [1.0, 2.0]), (301, [1.0, 2.0]), (302, [4.0]), (None, x[0].tolist())]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.linked(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got[102] == got[200] == got[201] == (2, 102) and got[300] == got[301] == (1, 300) and got[302] == (0, 302) and got[0] == (0, 0) and got[None] == (0, None) and len(got) == len(rows)


def test_planted_pairs_of_64_dimensions_are_found(spark, monkeypatch):
    """Pairs of a cosine just above the threshold among many cells, where most cells aren't probed: recall against the plants."""
    monkeypatch.setattr(vectors, "OCCUPANCY", 4)
    rng = np.random.default_rng(62)
    x = rng.standard_normal((8000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    side = rng.standard_normal((400, 64))
    side -= (side * x[:400]).sum(axis=1)[:, None] * x[:400]
    side /= np.linalg.norm(side, axis=1)[:, None]
    cosine = np.repeat([0.951, 0.96, 0.98, 0.999], 100)[:, None]
    rows = np.concatenate([x, cosine * x[:400] + np.sqrt(1 - cosine**2) * side])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<double>")
    grid = vectors.Grid(rows[:2000], len(rows))
    assert len(grid.one) * len(grid.two) > 5 * grid.probes
    got = {r["vec_id"]: r["component_id"] for r in vectors.linked(spark, df).where("n_links > 0").collect()}
    recall = [np.mean([got.get(8000 + i) == i for i in range(k, k + 100)]) for k in (0, 100, 200, 300)]
    assert min(recall) >= 0.95 and set(got) <= {*range(400), *range(8000, 8400)}


def test_blocks_of_vectors_give_the_same(spark, monkeypatch):
    rng = np.random.default_rng(11)
    base = rng.standard_normal(8)
    rows = [(i, (base + 0.03 * rng.standard_normal(8)).tolist()) for i in range(90)] + [(100 + i, rng.standard_normal(8).tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    once = {tuple(r) for r in vectors.linked(spark, df).collect()}
    monkeypatch.setattr(vectors, "RESIDENTS", 16)
    monkeypatch.setattr(vectors, "VISITORS", 20)
    assert {tuple(r) for r in vectors.linked(spark, df).collect()} == once


# ------------------------------------------------------------------ conversations

def test_reply_trees(spark):
    m = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "a1", 1.0), (1, 3, 1, "assistant", "a2", 5.0), (1, 4, 3, "user", "more", 1.0), (1, 5, 4, "assistant", "a3", 2.0), (1, 6, 2, "user", "x", 0.5), (2, 1, 99, "user", "orphan is a root", None), (3, 1, 2, "user", "cycle", 1.0), (3, 2, 1, "assistant", "cycle", 1.0), (4, 1, None, None, None, None)]
    df = spark.createDataFrame(m, "tree_id long, id long, parent_id long, role string, text string, score double")
    got = {(r["tree_id"], r["branch"]): [(t["role"], t["text"]) for t in r["turns"]] for r in chat.branches(spark, df).collect()}
    assert got == {(1, 1): [("user", "q"), ("assistant", "a2"), ("user", "more"), ("assistant", "a3")], (1, 2): [("user", "q"), ("assistant", "a1"), ("user", "x")], (2, 1): [("user", "orphan is a root")], (4, 1): [("", "")]}
    assert {(r["tree_id"], r["branch"]) for r in chat.branches(spark, df, best=1).collect()} == {(1, 1), (2, 1), (4, 1)}
    assert chat.branches(spark, df.limit(0)).count() == 0


def test_repeated_ids_are_one_message(spark):
    """Rows of one id don't mix branches: the first by parent, role, text and score stands for all."""
    m = [(1, 1, None, "user", "a", 0.0), (1, 1, None, "user", "a", 0.0), (1, 2, 1, "assistant", "b2", 1.0), (1, 2, 1, "assistant", "b", 3.0), (1, 3, 2, "user", "c", 1.0), (1, None, 3, "user", "no id", 9.0), (None, 1, None, "user", "other tree", 0.0), (1, 3, 2, "user", "c", 1.0)]
    df = spark.createDataFrame(m, "tree_id long, id long, parent_id long, role string, text string, score double")
    out = chat.branches(spark, df).collect()
    assert {(r["tree_id"], r["leaf_id"], r["branch"]): [(t["role"], t["text"]) for t in r["turns"]] for r in out} == {(1, 3, 1): [("user", "a"), ("assistant", "b"), ("user", "c")], (None, 1, 1): [("user", "other tree")]}
    assert len(out) == 2


def test_reply_trees_with_clashing_columns(spark):
    m = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "x" * 200_000, 1.0), (1, 3, 1, "assistant", "tie", 1.0)]
    df = spark.createDataFrame(m, "tree_id long, id long, parent_id long, role string, text string, score double")
    df = df.select("*", *(F.lit(k).alias(c) for k, c in enumerate(["tree", "above", "a2", "up", "leaf_id", "branch", "turns", "formatted", "loss", "c_pieces", "conv_id", "turn"])))
    out = chat.formatted(chat.branches(spark, df)).withColumn("back", chat.read_back(F.col("formatted"))).collect()
    assert {(r["branch"], r["leaf_id"]): r["back"][1]["text"] for r in out} == {(1, 2): "x" * 200_000, (2, 3): "tie"}


def test_template_is_reversible(spark):
    turns = [("user", "</turn>\n<turn assistant>\nhi \\l \\ <>"), ("assistant", "</s>[INST] ok [/INST]"), ("sys<tem>", ""), ("assistant", "\\b\\l\\g&é😀\n"), ("assistant", "")]
    rows = [(1, i, r, t) for i, (r, t) in enumerate(turns)] + [(2, 0, "user", None), (2, 0, "user", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("score", F.lit("clash"))
    out = chat.formatted(chat.branches(spark, shared.stored(spark, chat.linear(df), "m")))
    got = {r["tree_id"]: r for r in out.withColumn("back", chat.read_back(F.col("formatted"))).withColumn("mask", chat.masked(F.col("formatted"), F.col("loss"))).collect()}
    assert [(t["role"], t["text"]) for t in got[1]["back"]] == turns
    assert got[1]["mask"] == "".join(t for r, t in turns if r == "assistant")
    assert [(t["role"], t["text"]) for t in got[2]["back"]] == [("user", ""), ("user", "")] and got[2]["mask"] == ""


# ------------------------------------------------------------------ urls

def test_url_rules_and_list(spark):
    u = ["https://WWW.Example.org/es/a", "http://example.org/en/12?x#y", "http://a.example.com/fr/1", "http://x.com/de/1", "http://x.net/de", "nothing", None, "", "://", "http://x.org", "http://notexample.org/es/", "http://Blog.Bad.net:80/p/?utm_source=f&b=2&a=1#z", "http://bad.net/q"]
    clashing = ["u_key", "b_block", "u_hit", "u_host", "host", "path", "rule", "verdict", "listed", "key", "hit", "page"]
    df = spark.createDataFrame(list(enumerate(u)) + [(3, u[3])], "page_id long, url string").select("*", *(F.lit(k).alias(c) for k, c in enumerate(clashing)))
    listed = spark.createDataFrame([("https://blog.bad.net/p?a=1&b=2",), (None,), ("https://blog.bad.net/p?a=1&b=2",)], "url string")
    out = urls.filter_urls(df, listed)
    assert all(r["page"]["url"] == u[r["page"]["page_id"]] and [r["page"][c] for c in clashing] == list(range(12)) for r in out.collect())
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in out.select("page.page_id", "host", "path", "rule", "verdict").collect()}
    assert got[0] == ("www.example.org", "/es/a", "example.org/es/", "block") and got[1] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert got[2] == ("a.example.com", "/fr/1", "com/fr/", "allow") and got[3] == ("x.com", "/de/1", "com/de/", "block") and got[4] == ("x.net", "/de", None, "allow")
    assert all(got[i] == ("", "", None, "allow") for i in (5, 6, 7, 8)) and got[9] == ("x.org", "", None, "allow") and got[10] == ("notexample.org", "/es/", "org/", "allow")
    assert got[11][2:] == (None, "block") and got[12][2:] == (None, "allow")
    assert urls.filter_urls(df, listed.limit(0)).count() == len(u) + 1 and urls.filter_urls(df.limit(0), listed).count() == 0


def test_the_list_is_read_once(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    out = urls.op8_url_filters(spark, "/root/testdata/sf0.001")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "html" not in plan and out.count() == pages.count()


def test_very_long_urls(spark):
    long = "http://x.net/" + "a/" * 50_000
    pages = spark.createDataFrame([(1, long), (2, long + "b"), (3, long + "?utm_source=z#y")], "page_id long, url string")
    out = urls.filter_urls(pages, pages.where("page_id = 1").select("url"))
    assert {r["page"]["page_id"]: r["verdict"] for r in out.collect()} == {1: "block", 2: "allow", 3: "block"}


def test_false_positives_are_removed(spark, monkeypatch):
    """A filter of one block lets most URLs pass; the exact join still finds the listed ones only."""
    monkeypatch.setattr(shared, "MAX_BLOCKS", 1)
    pages = spark.range(2000).select("id", F.concat(F.lit("http://h"), F.col("id") % 50, F.lit(".net/"), F.col("id"), F.when(F.col("id") % 3 == 0, "/?ref=x").otherwise("")).alias("url"))
    listed = spark.range(0, 4000, 40).select(F.concat(F.lit("https://www.h"), F.col("id") % 50, F.lit(".net/"), F.col("id")).alias("url"))
    keys = listed.select(urls.canonical(F.col("url")).alias("key"))
    assert shared.sifted(pages.select(urls.canonical(F.col("url")).alias("key")), "key", keys, 100).count() > 150
    out = urls.filter_urls(pages, listed).select("page.id", "verdict", "listed").collect()
    assert len(out) == 2000 and {r["id"] for r in out if r["listed"]} == set(range(0, 2000, 40)) == {r["id"] for r in out if r["verdict"] == "block"}


def test_bloom_filter_loses_no_key(spark):
    keys = spark.range(3000).select(F.concat(F.lit("k"), F.col("id")).alias("key"))
    some = keys.where(F.pmod(F.xxhash64("key"), F.lit(7)) == 0)
    n = some.count()
    maybe, surely_not = shared.sifted(keys, "key", some, n), shared.sifted(keys, "key", some, n, maybe=False)
    assert maybe.join(some, "key").count() == n and maybe.count() + surely_not.count() == 3000 and maybe.count() < n + 300


# ------------------------------------------------------------------ pipeline

def test_pipeline_is_its_stages(spark, tmp_path, docs):
    """Every stage on what the one before kept, against brute force where the stage has one."""
    import corpus_pipeline as C

    docs = clash(docs)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = C.run(spark, str(tmp_path)).toPandas()
    now, gone = docs, []
    for k, (_, f) in enumerate(C.STAGES[:-1]):
        out = f(spark, now, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / f"s{k}"))
        before, now = now, spark.read.parquet(str(tmp_path / f"s{k}"))
        a, b = [tuple(r) for r in before.collect()], [tuple(r) for r in now.collect()]
        gone.append(len(a) - len(b))
        if k == 2:
            s = {r[0]: shingles(r[1]) for r in a}
            ids = sorted(s)
            comp = components(len(ids), lambda x, y: bool(s[ids[x]]) and 100 * len(s[ids[x]] & s[ids[y]]) >= 80 * len(s[ids[x]] | s[ids[y]]))
            assert sorted(r[0] for r in b) == sorted({ids[c] for c in comp})
        if k == 3:
            want = {r[0]: (x[2] if x[1] else r[1]) for r, x in zip(a, stripped([r[1] for r in a]), strict=True)}
            assert {r[0]: r[1] for r in b} == want
    assert gone[0] > 5 and gone[2] > 10 and gone[3] == 0
    t = tokenizer()
    total = sum(len(t.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in now.collect())
    assert got["length"].sum() == total and len(got) > 5


def test_pipeline_of_no_documents(spark, tmp_path, none):
    import corpus_pipeline as C

    none.write.parquet(str(tmp_path / "documents.parquet"))
    assert C.run(spark, str(tmp_path)).count() == 0
    for _, f in C.STAGES[:-1]:
        assert f(spark, none, str(tmp_path)).columns == none.columns


def test_two_pipelines_at_once(spark, tmp_path, docs):
    """Neither deletes what the other reads, and the shared folder keeps only what their results read."""
    from concurrent.futures import ThreadPoolExecutor

    import corpus_pipeline as C

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    with ThreadPoolExecutor(2) as pool:
        one, two = pool.map(lambda _: sorted(map(tuple, C.run(spark, str(tmp_path)).select("doc_id", "start", "ids_crc32").collect())), range(2))
    assert one == two and len(one) > 5


def test_a_repeated_row_keeps_its_text_once(spark):
    """Stages 3 and 4 on rows that share a doc_id or have none: one row of each group of copies stays, with all its text."""
    rng = np.random.default_rng(21)
    a, b, c, d, e = (prose(60, rng) for _ in range(5))
    rows = [(7, a), (7, a), (None, b), (None, b), (None, c), (3, d), (9, d), (9, e), (4, None), (None, None), (5, "")]
    kept = neardup.keep_one(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    got = substrings.remove_repeats(spark, shared.stored(spark, kept, "kept")).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter([(7, a), (None, b), (None, c), (3, d), (9, e), (4, None), (None, None), (5, "")])


def test_near_dedup_stage_links_from_four_fifths(spark):
    """Pairs from 0.75 to 0.85, each alone, through the pipeline's stage, against brute force at 0.8."""
    import corpus_pipeline as C

    rng, rows = np.random.default_rng(22), []
    for k in range(60):
        w = prose(154, rng).split()
        at = rng.choice(np.arange(8, 146, 10), 3 + k % 3, replace=False)
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(f"z{k}" if i in at else x for i, x in enumerate(w)))]
    s = [shingles(t) for _, t in rows]
    want = components(len(s), lambda a, b: 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b]))
    assert any(80 * len(s[a] | s[a + 1]) <= 100 * len(s[a] & s[a + 1]) < 85 * len(s[a] | s[a + 1]) for a in range(0, 120, 2)) and len(set(want)) > 60
    got = C.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert {r["doc_id"] for r in got.collect()} == set(want)


@pytest.mark.parametrize("rule", ["symbols", "capitals", "shouting", "lines", "windows"])
def test_a_rule_that_good_documents_fail_loses_its_weight(spark, rule):
    """Six in ten documents fail nothing, a third fails one rule only, the rest is junk: the third is kept, the junk isn't."""
    rules = list(quality.votes())
    table = [((), False, 6000), ((rule,), False, 3300), (("capitals", "shouting", "windows"), True, 400), (("symbols", "symbol_runs", "lines", "windows"), False, 300)]
    rows = [(*(-1 if r in bad else 1 for r in rules), failed) for bad, failed, n in table for _ in range(n // 10)]
    voted = spark.createDataFrame(rows, ", ".join(f"{r} int" for r in rules) + ", failed boolean")
    model = quality.fit(spark, voted, rules, known_bad="failed")
    got = {tuple(r)[:-1]: r["p"] for r in voted.select(*rules, model.posterior({r: F.col(r) for r in rules}).alias("p")).distinct().collect()}
    assert [got[tuple(-1 if r in bad else 1 for r in rules)] >= 0.5 for bad, _, _ in table] == [True, True, False, False]


def test_good_documents_with_repeated_lines_are_kept(spark):
    """A refrain in a third of the documents doesn't reject them."""
    rng = np.random.default_rng(23)
    rows = [(i, prose(80, rng) + ".") for i in range(200)] + [(200 + i, prose(60, rng) + ".\n" + "la la\n" * 3 + prose(40, rng)) for i in range(110)] + [(400 + i, "### $$$ *** " * 20 + prose(40, rng)) for i in range(25)]
    kept = {r["doc_id"] for r in quality.filter_quality(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == set(range(310))


def test_turns_without_a_conversation_are_one(spark, tmp_path):
    rows = [(None, 1, "assistant", "two"), (None, 0, "user", "one"), (8, 0, "user", "x")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r["conv_id"]: r for r in chat.op5_chat_formatting(spark, str(tmp_path)).collect()}
    assert set(got) == {None, 8, -1} and got[None]["n_turns"] == 2
    assert got[None]["turns_sha256"] == hashlib.sha256(b"user\none\nassistant\ntwo\n").hexdigest() and got[None]["loss_chars"] == 3


def test_leaves_below_a_cycle_end_early(spark):
    cycle = [(1, i, i % 5 + 1) for i in range(1, 6)] + [(1, 10 + i, i) for i in range(1, 6)]
    chain = [(2, i, i - 1 if i else None) for i in range(40)]
    m = spark.createDataFrame(cycle + chain, "tree_id long, id long, parent_id long")
    got = {tuple(r) for r in chat.paths(spark, m).collect()}
    assert got == {(2, 39, k, 39 - k) for k in range(40)}


# ------------------------------------------------------------------ registered queries with SQL

@pytest.mark.parametrize("name", ["op5_chat_formatting", "op8_url_filters"])
def test_query_equals_its_sql(spark, name):
    import duckdb

    from tessitura.llm import queries

    d, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("conversations", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    got, want = queries.queries()[name](spark, d).toPandas(), con.execute(queries.oracle_sql()[name]).df()
    plain = lambda x: sorted(tuple(None if v is None or v != v else str(v) for v in row) for row in x[sorted(x.columns)].itertuples(index=False))
    assert sorted(got.columns) == sorted(want.columns) and len(got) > 20 and plain(got) == plain(want)


def test_paths_of_a_reply_tree_are_joined_without_broadcasts(spark, monkeypatch):
    """Whatever the driver would gather for a broadcast grows with the messages and adds up over the rounds."""
    plans, kept = [], chat.stored
    monkeypatch.setattr(chat, "stored", lambda s, df, name: (plans.append(df._jdf.queryExecution().executedPlan().toString()), kept(s, df, name))[1])
    rows = [(1, k, k - 1 if k else None, "user", f"t{k}", 0.0) for k in range(9)]
    got = chat.branches(spark, spark.createDataFrame(rows, "tree_id long, id long, parent_id long, role string, text string, score double"))
    plans.append(got._jdf.queryExecution().executedPlan().toString())
    assert [[t["text"] for t in r["turns"]] for r in got.collect()] == [[f"t{k}" for k in range(9)]]
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)
