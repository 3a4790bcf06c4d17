"""Substring dedup: passages of WINDOW words that occur more than once in the corpus are removed wherever they stand.

Suffix automata of shards of the corpus give, for passages streamed through them, matching statistics and how often each
window occurs. To make each shard small and complete, windows are dealt by content: a window's anchor is the least hash of
the GRAM-word sequences in it, so equal windows have the same anchor at the same place. A run is the stretch of windows that
share one anchor; runs of anchors that occur once can't repeat and are left out. What remains is dealt by anchor to shards of
bounded size; each distinct run goes to its shard once, with the number of its occurrences as weight, so copies in any number
cost one. A window repeats if its state in the automaton has a weight of two or more.

An anchor with more than HOT distinct runs (a common phrase in many surroundings, or a large family of near copies) would make
one shard grow with the corpus. Its windows are counted by hash, and each distinct window counted twice or more becomes a run
of its own, dealt by anchor and window; the automaton of its shard decides about it. So no shard holds more than about
SHARD_WORDS words and one anchor's HOT runs, and nothing that repeats is dropped.

Automata aren't broadcast to all documents: the reference is the corpus itself, so what would be broadcast grows with it (see
the README for figures). Each shard's automaton is built and read in one task, by the runs dealt to it.

Defined results: null and blank texts have no words; documents of fewer words than a window keep all. Rows are told apart by
key and text, so repeated rows are copies of each other. Kept words are joined by one space; texts that lose no word stay as
they are. Overlapping windows of one text count as occurrences. Very long texts are read whole, in slices of rows. Other
columns keep their values under a prefix on the way, so they can have any names. No rows, no rows.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import chunks, dropped, grams, in_arrow, mix, sifted, spaced, stored, table

WINDOW = 35
GRAM = 8
#: Words of the runs of one automaton, about.
SHARD_WORDS = 120_000
#: Runs of one anchor beyond which windows are counted first.
HOT = 400
#: ASCII characters at which str.split() splits besides SPACES.
ODD = "\x1c\x1d\x1e\x1f"
SPLIT = re.compile("[\x20\x09-\x0D]+")
_STEP = np.uint64(0x9FB21C651E98DF25)


def _runs(data: np.ndarray, offsets: np.ndarray):
    """Runs of windows with one anchor: (anchor, hash of the run's words, text, first window in the text, windows, first word)."""
    w = spaced(data, offsets)
    n = len(w) - WINDOW + 1
    if n <= 0:
        return (np.zeros(0, np.uint64), np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(4))), w
    g = mix(grams(w.hash, GRAM))
    wide = WINDOW - GRAM + 1
    anchor = np.lib.stride_tricks.sliding_window_view(g, wide)[:n].argmin(axis=1) + np.arange(n)
    owner = w.owner()
    inside = owner[:n] == owner[WINDOW - 1 :]
    new = inside & np.concatenate(([True], (anchor[1:] != anchor[:-1]) | ~inside[:-1]))
    first = np.flatnonzero(new)
    stop = np.flatnonzero(inside & np.concatenate(((anchor[1:] != anchor[:-1]) | ~inside[1:], [True]))) + 1
    power = np.full(len(w) + 1, _STEP, dtype=np.uint64)
    power[0] = 1
    power = np.multiply.accumulate(power)
    total = np.zeros(len(w) + 1, dtype=np.uint64)
    np.cumsum(w.hash * power[1:], out=total[1:])
    inverse = np.uint64(pow(int(_STEP), -1, 2**64))
    back = np.full(len(w) + 1, inverse, dtype=np.uint64)
    back[0] = 1
    back = np.multiply.accumulate(back)
    end = stop + WINDOW - 1
    content = mix((total[end] - total[first]) * back[first] + (stop - first).astype(np.uint64))
    text = owner[first]
    return (g[anchor[first]], content, text, first - w.text[text], stop - first, first), w


def _run_rows(docs: DataFrame) -> DataFrame:
    """(h, c, key, first, n) for every run of docs(key, text)."""

    def run(batches):
        for b in batches:
            keys = b.column(0)
            for at, data, offsets in chunks(b.column(1)):
                (h, c, text, first, n, _), _ = _runs(data, offsets)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.view(np.int64)), keys.take(pa.array(text + at)), pa.array(first, pa.int64()), pa.array(n, pa.int64())], ["h", "c", "key", "first", "n"])

    return in_arrow(docs, run, "h long, c long, key long, first long, n long")


def _anchor_counts(docs: DataFrame) -> DataFrame:
    """(h, m): anchors and how many runs they have, where that is two or more."""

    def run(batches):
        for b in batches:
            for _, data, offsets in chunks(b.column(0)):
                (h, *_), _ = _runs(data, offsets)
                value, count = np.unique(h, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(count, pa.int64())], ["h", "m"])

    return in_arrow(docs.select("text"), run, "h long, m long").groupBy("h").agg(F.sum("m").alias("m")).where("m > 1")


def _with(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """docs joined with asked by key; texts that aren't asked for are sifted out before the shuffle."""
    return sifted(docs, "key", asked.select("key"), asked.count()).join(asked, "key")


def _asked_words(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """The word hashes of asked(key, list of (h, c, first, n, weight, deal)) runs: one row (h, c, weight, deal, words) each."""

    def run(batches):
        for b in batches:
            lists = b.column(1)
            bounds, item = np.asarray(lists.offsets), lists.values
            h, c, first, n, weight, deal = (item.field(x) for x in ("h", "c", "first", "n", "weight", "deal"))
            first, n = np.asarray(first), np.asarray(n)
            for at, data, offsets in chunks(b.column(0)):
                w = spaced(data, offsets)
                lo, hi = int(bounds[at]), int(bounds[at + len(offsets) - 1])
                text = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds[at : at + len(offsets)]))
                start, size = w.text[text] + first[lo:hi], n[lo:hi] + WINDOW - 1
                edge = np.concatenate(([0], np.cumsum(size)))
                flat = w.hash[np.repeat(start - edge[:-1], size) + np.arange(edge[-1])] if hi > lo else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays([h.slice(lo, hi - lo), c.slice(lo, hi - lo), weight.slice(lo, hi - lo), deal.slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(flat.view(np.int64)))], ["h", "c", "weight", "deal", "words"])

    return in_arrow(_with(docs, asked).select("text", "runs"), run, "h long, c long, weight long, deal long, words array<long>")


class Automaton:
    """A suffix automaton of several sequences with weights. Afterwards weight[state] is the weight of all places of the state."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size, self.weight = [-1], [0], [0]

    def add(self, words: list[int], weight: int) -> None:
        nxt, link, size = self.next, self.link, self.size
        last = 0
        for x in words:
            if x in nxt[last]:
                q = nxt[last][x]
                if size[q] == size[last] + 1:
                    last = q
                    self.weight[last] += weight
                    continue
                last = self._clone(last, x, q)
                self.weight[last] += weight
                continue
            new = len(nxt)
            nxt.append({})
            link.append(0)
            size.append(size[last] + 1)
            self.weight.append(weight)
            p = last
            while p >= 0 and x not in nxt[p]:
                nxt[p][x] = new
                p = link[p]
            if p >= 0:
                q = nxt[p][x]
                link[new] = q if size[q] == size[p] + 1 else self._clone(p, x, q)
            last = new

    def _clone(self, p: int, x: int, q: int) -> int:
        nxt, link, size = self.next, self.link, self.size
        copy = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        size.append(size[p] + 1)
        self.weight.append(0)
        link[q] = copy
        while p >= 0 and nxt[p].get(x) == q:
            nxt[p][x] = copy
            p = link[p]
        return copy

    def finish(self) -> None:
        for s in np.argsort(-np.array(self.size), kind="stable").tolist():
            if s:
                self.weight[self.link[s]] += self.weight[s]

    def repeated(self, words: list[int], least: int) -> list[int]:
        """Starts of the stretches of `least` words that have a weight of two or more, by matching statistics."""
        nxt, link, size, weight = self.next, self.link, self.size, self.weight
        state = length = 0
        out = []
        for i, x in enumerate(words):
            while state and x not in nxt[state]:
                state = link[state]
                length = size[state]
            state = nxt[state].get(x, 0)
            length = length + 1 if state else 0
            if length >= least:
                while size[link[state]] >= least:
                    state = link[state]
                length = min(length, size[state])
                if weight[state] > 1:
                    out.append(i - least + 1)
        return out


def _sharded(key, group):
    """For each distinct run of a shard the stretches of repeated windows: (h, c, lo, hi), hi after the last."""
    lists = group.column("words").combine_chunks()
    bounds, flat = np.asarray(lists.offsets), np.asarray(lists.values)
    ids = np.unique(flat[bounds[0] : bounds[-1]], return_inverse=True)[1].tolist()
    base = int(bounds[0])
    runs = [ids[a - base : b - base] for a, b in zip(bounds.tolist(), bounds[1:].tolist(), strict=False)]
    a = Automaton()
    for words, weight in zip(runs, group.column("weight").to_pylist(), strict=True):
        a.add(words, weight)
    a.finish()
    h, c = group.column("h").to_pylist(), group.column("c").to_pylist()
    out: list[tuple[int, int, int, int]] = []
    for i, words in enumerate(runs):
        at = a.repeated(words, WINDOW)
        start = None
        for k, x in enumerate(at):
            if start is None:
                start = x
            if k + 1 == len(at) or at[k + 1] != x + 1:
                out.append((h[i], c[i], start, x + 1))
                start = None
    cols = list(zip(*out, strict=True)) if out else [[]] * 4
    return pa.table({n: pa.array(x, pa.int64()) for n, x in zip(("h", "c", "lo", "hi"), cols, strict=True)})


def _window_hashes(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """(h, c, key, first, at, x): each window of the asked runs, `at` from the run's start, x its hash."""

    def run(batches):
        for b in batches:
            keys, lists = b.column(0), b.column(2)
            bounds, item = np.asarray(lists.offsets), lists.values
            h, c, first, n = (np.asarray(item.field(x)) for x in ("h", "c", "first", "n"))
            for at, data, offsets in chunks(b.column(1)):
                w = spaced(data, offsets)
                x = grams(w.hash, WINDOW)
                lo, hi = int(bounds[at]), int(bounds[at + len(offsets) - 1])
                text = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds[at : at + len(offsets)]))
                size = n[lo:hi]
                edge = np.concatenate(([0], np.cumsum(size)))
                inner = np.arange(edge[-1]) - np.repeat(edge[:-1], size)
                each = np.repeat(np.arange(lo, hi), size)
                hashes = x[w.text[np.repeat(text, size)] + first[each] + inner] if hi > lo else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(h[each]), pa.array(c[each]), keys.take(pa.array(np.repeat(text + at, size))), pa.array(first[each]), pa.array(inner, pa.int64()), pa.array(hashes.view(np.int64))], ["h", "c", "key", "first", "at", "x"])

    return in_arrow(_with(docs, asked).select("key", "text", "runs"), run, "h long, c long, key long, first long, at long, x long")


def repeated_spans(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(key, lo, hi): spans of words covered by repeated windows of docs(key, text); spans of a document may touch."""
    counts = stored(spark, _anchor_counts(docs), "anchors")
    runs = stored(spark, _run_rows(docs).join(counts, "h"), "runs")
    distinct = runs.groupBy("h", "c").agg(F.min(F.struct("key", "first")).alias("at"), F.first("n").alias("n"), F.count("*").alias("weight")).select("h", "c", "n", "weight", "at.key", "at.first")
    distinct = stored(spark, distinct, "distinct")
    hot = stored(spark, distinct.groupBy("h").agg(F.count("*").alias("k")).where(F.col("k") > HOT).select("h"), "hot")
    plain = distinct.join(hot, "h", "left_anti").select("key", "h", "c", "first", "n", "weight", F.xxhash64("h").alias("deal"))
    # windows of hot anchors, by hash; those counted twice are runs of one window
    cut = distinct.join(hot, "h", "left_semi").select("key", "h", "c", "first", "n", "weight")
    lists = lambda df, *names: stored(spark, df.groupBy("key").agg(F.collect_list(F.struct(*names)).alias("runs")), "lists")
    windows = stored(spark, _window_hashes(docs, lists(cut, "h", "c", "first", "n")).join(cut.select("h", "c", "weight"), ["h", "c"]), "windows")
    twice = windows.groupBy("h", "x").agg(F.sum("weight").alias("weight"), F.min(F.struct("key", (F.col("first") + F.col("at")).alias("first"))).alias("at")).where("weight > 1")
    single = twice.select("at.key", "h", F.col("x").alias("c"), "at.first", F.lit(1).cast("long").alias("n"), "weight", F.xxhash64("h", "x").alias("deal"))
    asked = stored(spark, plain.unionByName(single), "asked")
    words = int(asked.agg(F.sum(F.col("n") + WINDOW - 1)).first()[0] or 0)
    shards = max(1, -(-words // SHARD_WORDS))
    sent = _asked_words(docs, lists(asked, "h", "c", "first", "n", "weight", "deal"))
    found = stored(spark, sent.groupBy(F.pmod("deal", F.lit(shards)).alias("shard")).applyInArrow(_sharded, "h long, c long, lo long, hi long"), "found")
    # windows of a hot anchor's run that repeat, as stretches
    stay = windows.join(found.join(hot, "h", "left_semi").select("h", F.col("c").alias("x")), ["h", "x"], "left_semi").groupBy("h", "c").agg(F.array_sort(F.collect_list("at")).alias("ats"))
    marks = F.transform("ats", lambda x, i: F.struct(x.alias("at"), (x - i).alias("run")))
    back = stay.select("h", "c", F.explode(marks).alias("mark")).groupBy("h", "c", "mark.run").agg(F.min("mark.at").alias("lo"), (F.max("mark.at") + 1).alias("hi")).select("h", "c", "lo", "hi")
    whole = stored(spark, found.join(hot, "h", "left_anti").unionByName(back), "whole")
    dropped(spark, counts, distinct, hot, windows, asked, found)
    return runs.select("h", "c", "key", "first").join(whole, ["h", "c"]).select("key", (F.col("first") + F.col("lo")).alias("lo"), (F.col("first") + F.col("hi") + (WINDOW - 1)).alias("hi")).distinct()


def _stripped(spark: SparkSession, docs: DataFrame, spans: DataFrame, out: str, digest: bool) -> DataFrame:
    """docs(key, text, and others) with n_words, n_removed and the kept words as text or digest. Texts that certainly have no
    span aren't shuffled."""
    per = stored(spark, spans.groupBy("key").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")), "spans")
    many = per.count()
    rest = [c for c in docs.columns if c not in ("key", "text")]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in rest)

    def run(batches):
        for b in batches:
            texts, lists = b.column(0).to_pylist(), b.column(1).to_pylist()
            n, gone, kept = [], [], []
            for t, s in zip(texts, lists, strict=True):
                w = _split(t or "")
                n.append(len(w))
                if s:
                    cover = np.zeros(len(w) + 1, dtype=np.int64)
                    for x in s:
                        cover[x["lo"]] += 1
                        cover[min(x["hi"], len(w))] -= 1
                    stay = np.cumsum(cover[:-1]) == 0
                    gone.append(int(len(w) - stay.sum()))
                    w = [x for x, y in zip(w, stay.tolist(), strict=True) if y]
                else:
                    gone.append(0)
                if digest:
                    kept.append(hashlib.sha256(" ".join(w).encode()).hexdigest())
                else:
                    kept.append(" ".join(w) if gone[-1] else t)
            yield pa.RecordBatch.from_arrays([*b.columns[2:], pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], [*b.schema.names[2:], "s_words", "s_removed", out])

    cut = sifted(docs, "key", per.select("key"), many).join(per, "key", "left")
    whole = sifted(docs, "key", per.select("key"), many, maybe=False).withColumn("spans", F.lit(None).cast(per.schema["spans"].dataType))
    return in_arrow(cut.unionByName(whole).select("text", "spans", *rest), run, f"{fields}{', ' if fields else ''}s_words long, s_removed long, `{out}` string")


def _split(text: str) -> list[str]:
    """Words between the six white-space characters only."""
    if any(c in text for c in ODD) or not text.isascii():
        return [x for x in SPLIT.split(text) if x]
    return text.split()


def remove_repeats(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs with repeated passages taken out of their texts; same columns, every row stays."""
    names = docs.columns
    # the text is carried under its own name; other columns keep theirs under a prefix, so that none can clash
    keyed = docs.select(F.xxhash64(F.col("doc_id"), F.col("text")).alias("key"), "text", *(F.col(f"`{c}`").alias(f"d_{c}") for c in names if c != "text"))
    spans = repeated_spans(spark, keyed.select("key", "text"))
    out = _stripped(spark, keyed, spans, "text", digest=False)
    return out.select(*(F.col("text") if c == "text" else F.col(f"`d_{c}`").alias(c) for c in names))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.xxhash64("doc_id", "text").alias("key"), "doc_id", "text")
    out = _stripped(spark, docs, repeated_spans(spark, docs.select("key", "text")), "kept_sha256", digest=True)
    return out.select("doc_id", F.col("s_words").alias("n_words"), F.col("s_removed").alias("n_removed"), "kept_sha256")
