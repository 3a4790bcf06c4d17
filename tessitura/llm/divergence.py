"""How each source of a language differs from every other source and from the language, over the language's kept terms.

Terms are maximal runs of ASCII letters and non-ASCII characters, A-Z lower-cased. A language keeps the terms that stand in at
least MIN_DOCS of its documents. A group (language, source) gives each kept term the share p = 1 + floor(1e9 (count + 5) /
(N + 5 V)); everything is computed in whole numbers.

The rotation: a language's vocabulary is dealt into slices of about SLICE terms, and a group's vector, compressed, is cut along.
In each slice the groups sit on an even number of seats, resident by (language, slice, seat). In every round of a round-robin
tournament one half of the seats sends its vectors to the seat it meets, where both directions of every pair are evaluated; the
residents' shuffle is the same in all rounds and is reused. Each seat keeps a heap of its residents' leading terms. What a slice
finds is summed (pairs) or merged (heaps, at most TOP terms a slice). Memory goes with a slice and a seat, not with the vocabulary
or the number of sources.

Defined results: null text, language and source are ''. A document without a term still makes its group occur. With no kept term
all values of a language are 0 and it has no `term` rows; a language of one source has no `pair` rows. Ties of value go to the
item that sorts first in UTF-8. Repeated rows count as often as they stand. Very long texts are read whole, in slices of bounded
memory. An empty table gives an empty result. Only the named columns are read, so others can have any names.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import LOWER, Words, chunks, in_arrow, stored, table

MIN_DOCS = 30
TOP = 50
SCALE, PRIOR = 1_000_000_000, 5
#: Terms of a slice, on average.
SLICE = 16384
#: Groups of a seat, on average, until a language has MAX_SEATS seats; then seats hold more.
PER_SEAT = 8
MAX_SEATS = 16
#: Bytes of text that a task counts at once, and of all texts for one shard of the terms, about.
CHUNK, SHARD = 1 << 23, 1 << 24

_TERM = np.zeros(256, dtype=bool)
_TERM[128:] = True
_TERM[65:91] = True
_TERM[97:123] = True


def _joined(batches):
    """Tables of about CHUNK bytes of text each."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(0).nbytes
        if size >= CHUNK:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


_COUNTED = pa.schema([("lang", pa.string()), ("shard", pa.int32()), ("sources", pa.list_(pa.string())), ("terms", pa.binary()), ("counts", pa.binary())])


def _counted(shards: int):
    def run(batches):
        """For each language and shard of term hashes a row: its terms, and for each (term, source) their numbers in this row, the
        occurrences and the documents."""
        for rows in _joined(batches):
            langs, sources = (rows.column(k).fill_null("").combine_chunks().dictionary_encode() for k in (1, 2))
            names, many = sources.dictionary.to_pylist(), len(sources.dictionary)
            group = langs.indices.to_numpy().astype(np.int64) * many + sources.indices.to_numpy()
            out, hashes, owner, text = [], [], [], {}
            for at, data, offsets in chunks(rows.column(0), 1 << 19):  # hashing needs some ten times the bytes
                w = Words(LOWER[data], offsets, _TERM[data])
                hashes.append(w.hash)
                owner.append(at + w.owner())
                one, first = np.unique(w.hash, return_index=True)
                raw = w.data.tobytes()
                for h, a, b in zip(one.tolist(), w.start[first].tolist(), w.end[first].tolist(), strict=True):
                    if h not in text:
                        text[h] = raw[a:b]
            if not text:
                continue
            kinds, term = np.unique(np.concatenate(hashes), return_inverse=True)
            pair = np.sort(term * rows.num_rows + np.concatenate(owner))  # by term (in the order of their hashes), then document
            begin = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
            t, d = np.divmod(pair[begin], rows.num_rows)
            shard = (((kinds >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int64)
            code = (group[d] // many * len(kinds) + t) * many + group[d] % many  # by language, term, source
            code, where = np.unique(code, return_inverse=True)
            n, docs = np.bincount(where, np.diff(np.append(begin, len(pair)))).astype(np.int64), np.bincount(where)
            t, lang, source = code // many % len(kinds), code // many // len(kinds), code % many
            cut = np.flatnonzero(np.append(True, (lang[1:] != lang[:-1]) | (shard[t[1:]] != shard[t[:-1]]))).tolist()
            for a, b in zip(cut, [*cut[1:], len(code)], strict=True):
                mine, local = np.unique(t[a:b], return_inverse=True)
                counts = np.stack([local, source[a:b], n[a:b], docs[a:b]]).astype("<i4")
                out.append((langs.dictionary[int(lang[a])].as_py(), int(shard[t[a]]), names, b" ".join(text[x] for x in kinds[mine].tolist()), counts.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _COUNTED, strict=True)], schema=_COUNTED)

    return run


def _kept(min_docs: int):
    def run(key, rows):
        """Adds up a shard of a language's terms and keeps those that stand in enough documents: their counts in each source, and
        with source null in all."""
        rows = rows.to_pylist()
        names = {x: k for k, x in enumerate(dict.fromkeys(x for r in rows for x in r["sources"]))}
        terms = pa.concat_arrays([pa.array(r["terms"].split(b" "), pa.binary()) for r in rows]).dictionary_encode()
        at, t, s, n, docs = 0, [], [], [], []
        numbers = terms.indices.to_numpy().astype(np.int64)
        for r in rows:
            local, source, a, b = np.frombuffer(r["counts"], "<i4").reshape(4, -1).astype(np.int64)
            t.append(numbers[at + local])
            s.append(np.array([names[x] for x in r["sources"]])[source])
            n.append(a)
            docs.append(b)
            at += int(local.max()) + 1
        t, s, n, docs = map(np.concatenate, (t, s, n, docs))
        enough = np.bincount(t, docs) >= min_docs
        own = enough[t]
        code, where = np.unique(t[own] * (len(names) + 1) + s[own], return_inverse=True)
        code = np.append(code, np.flatnonzero(enough) * (len(names) + 1) + len(names))
        total = np.append(np.bincount(where, n[own]), np.bincount(t, n, len(enough))[enough]).astype(np.int64)
        return pa.table({
            "lang": pa.array([key[0].as_py()] * len(code), pa.string()),
            "source": pa.array([*names, None], pa.string()).take(pa.array(code % (len(names) + 1))),
            "term": terms.dictionary.take(pa.array(code // (len(names) + 1))).cast(pa.string()),
            "n": total,
        })

    return run


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, source, term, n) of kept terms; with source null those of the whole language. Terms are counted in each task, then
    added up by language and range of the term's hash, a shard for SHARD bytes of the corpus."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    sent = in_arrow(docs.select(text, lang, source), _counted(max(1, -(-size // SHARD))), "lang string, shard int, sources array<string>, terms binary, counts binary")
    return sent.groupBy("lang", "shard").applyInArrow(_kept(min_docs), "lang string, source string, term string, n long")


# ---------------------------------------------------------------- vectors of a slice

def packed(ids: np.ndarray, n: np.ndarray) -> bytes:
    """Ascending ids and their counts, compressed."""
    return zlib.compress(np.diff(ids, prepend=0).astype("<i4").tobytes() + n.astype("<i8").tobytes(), 1)


def unpacked(data: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    raw = zlib.decompress(data) if data else b""
    many = len(raw) // 12
    return np.cumsum(np.frombuffer(raw, "<i4", many)), np.frombuffer(raw, "<i8", many, 4 * many)


def shares(counts: np.ndarray, total: int, many: int) -> np.ndarray:
    """1 + floor(SCALE (count + PRIOR) / (total + PRIOR many)) by long division, three digits at a time, so that nothing
    overflows below 9e15 occurrences."""
    over = total + PRIOR * many
    whole, rest = np.divmod(counts + PRIOR, over)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, over)
        whole = whole * 1000 + digit
    return whole + 1


def _dense(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """(counts, shares) of a vector over all terms of its slice."""
    ids, n = unpacked(row["vector"])
    counts = np.zeros(row["size"], dtype=np.int64)
    counts[ids] = n
    return counts, shares(counts, row["total"], row["many"]) if row["many"] else counts


def _pack(key, rows):
    ids = rows["id"].to_numpy()
    order = np.argsort(ids)
    data = packed(ids[order], rows["n"].to_numpy()[order])
    return pa.table({"lang": pa.array([key[0].as_py()], pa.string()), "source": pa.array([key[1].as_py()], pa.string()), "slice": pa.array([key[2].as_py()], pa.int32()), "vector": pa.array([data], pa.binary())})


def vectors(spark: SparkSession, counts: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vectors, terms). Vectors: one for each group and slice, and with source null one for each language, slice and seat. Terms:
    (lang, slice, id, term), numbered within a slice in UTF-8 order."""
    by_term = counts.where("source IS NULL")
    seats = F.least(F.lit(MAX_SEATS), 2 * F.ceil(F.count("*") / (2 * PER_SEAT))).cast("int").alias("seats")
    langs = groups.groupBy("lang").agg(seats).join(by_term.groupBy("lang").agg(F.count("*").alias("many"), F.sum("n").alias("all")), "lang", "left").fillna(0)
    langs = stored(spark, langs.withColumn("slices", F.greatest(F.lit(1), F.ceil(F.col("many") / SLICE)).cast("int")), "langs")
    dealt = by_term.join(langs.select("lang", "slices"), "lang").withColumn("slice", F.pmod(F.xxhash64("term"), F.col("slices")).cast("int"))
    slices = dealt.groupBy("lang", "slice").agg(F.array_sort(F.collect_list("term")).alias("found"))  # about SLICE terms each
    terms = stored(spark, slices.select("lang", "slice", F.size("found").alias("size"), F.posexplode("found").alias("id", "term")), "slices")
    known = counts.join(terms, ["lang", "term"]).select("lang", "source", "slice", "id", "n")
    packs = known.groupBy("lang", "source", "slice").applyInArrow(_pack, "lang string, source string, slice int, vector binary")
    sizes = terms.groupBy("lang", "slice").agg(F.first("size").alias("size"))
    totals = counts.where("source IS NOT NULL").groupBy("lang", "source").agg(F.sum("n").alias("total"))
    place = F.pmod(F.xxhash64("source"), F.col("seats")).cast("int")
    cells = groups.join(langs, "lang").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    own = cells.join(totals, ["lang", "source"], "left").join(packs.where("source IS NOT NULL"), ["lang", "source", "slice"], "left").withColumn("seat", place)
    every = langs.withColumn("total", F.col("all")).join(packs.where("source IS NULL"), "lang").withColumn("seat", F.explode(F.sequence(F.lit(0), F.col("seats") - 1)))
    columns = ["lang", "slice", "seat", "seats", "source", "many", "total", "vector"]
    both = own.select(columns).unionByName(every.select(columns)).join(sizes, ["lang", "slice"], "left").fillna(0, ["size", "total"])
    return stored(spark, both, "vectors"), terms


# ---------------------------------------------------------------- meetings

#: item: the other source, with what this slice adds; or null, with a leading term's id.
_MET = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("slice", pa.int32()), ("id", pa.int32()), ("value", pa.int64())])


def _table(key, found: list[tuple]) -> pa.Table:
    a, b, ids, v = zip(*found, strict=True) if found else ((), (), (), ())
    return pa.table([pa.array([key[0].as_py()] * len(a), pa.string()), pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array([key[1].as_py()] * len(a), pa.int32()), pa.array(ids, pa.int32()), pa.array(v, pa.int64())], schema=_MET)


def _distances(mine: list[dict], theirs: list[dict] | None) -> list[tuple]:
    """Both directions of every pair of mine with theirs, or among mine. Sixteen residents are unpacked at a time."""
    found = []
    for at in range(0, len(mine), 16):
        block = mine[at : at + 16]
        p = np.stack([_dense(x)[1] for x in block])
        for k, other in enumerate(mine[at + 1 :] if theirs is None else theirs):
            far = np.abs(p - _dense(other)[1]).sum(axis=1).tolist()
            for j, (one, v) in enumerate(zip(block, far, strict=True)):
                if theirs is not None or j <= k:  # among mine: other is number at + 1 + k
                    found += [(one["source"], other["source"], None, v), (other["source"], one["source"], None, v)]
    return found


def _home(key, rows):
    """Pairs among a seat's residents, and the heap of each resident's leading terms."""
    rows = rows.to_pylist()
    mine = [x for x in rows if x["source"] is not None]
    found = _distances(mine, None)
    for whole in (x for x in rows if x["source"] is None):
        q = _dense(whole)[1]
        for x in mine:
            counts, p = _dense(x)
            f = np.where(counts > 0, p - q, 0)
            ids = np.flatnonzero(f > 0)
            ids = ids[np.lexsort((ids, -f[ids]))][:TOP]
            found += [(x["source"], None, i, v) for i, v in zip(ids.tolist(), f[ids].tolist(), strict=True)]
    return _table(key, found)


def _away(key, residents, guests):
    return _table(key, _distances([x for x in residents.to_pylist() if x["source"] is not None], guests.to_pylist()))


def partner(seat: Column, seats: Column, r: int) -> Column:
    """The seat that `seat` meets in round r of the seats - 1 rounds."""
    last = seats - 1
    other = F.pmod(F.lit(r) - seat, last)
    return F.when(seat == last, F.pmod(F.lit(r) * (seats / 2).cast("int"), last)).when(other == seat, last).otherwise(other)


def rotated(cells: DataFrame, rounds: int) -> DataFrame:
    """Pair sums and heaps of all meetings."""
    spot = ["lang", "slice", "seat"]
    kind = "lang string, source string, item string, slice int, id int, value long"
    residents = cells.groupBy(*spot)
    out = residents.applyInArrow(_home, kind)
    for r in range(rounds):
        met = partner(F.col("seat"), F.col("seats"), r)
        travels = (F.col("seat") > met) == ((F.col("seat") + met) % 2 == 0)  # one of the two, in turns
        guests = cells.where(F.col("source").isNotNull() & (F.lit(r) < F.col("seats") - 1) & travels).withColumn("seat", met)
        out = out.unionByName(residents.cogroup(guests.groupBy(*spot)).applyInArrow(_away, kind))
    return out


def diverging(spark: SparkSession, docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, source, part, item, value, rank), see above."""
    counts = stored(spark, term_counts(docs, text, lang, source, min_docs), "counts")
    groups = stored(spark, docs.select(F.coalesce(F.col(lang), F.lit("")).alias("lang"), F.coalesce(F.col(source), F.lit("")).alias("source")).distinct(), "groups")
    cells, terms = vectors(spark, counts, groups)
    seats = cells.agg(F.max("seats")).first()[0] or 1
    met = stored(spark, rotated(cells, seats - 1), "met")
    pairs = met.where("id IS NULL").groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("part", F.lit("pair"))
    heaps = met.where("id IS NOT NULL").select("lang", "source", "slice", "id", "value").join(terms, ["lang", "slice", "id"]).select("lang", "source", F.col("term").alias("item"), "value", F.lit("term").alias("part"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = pairs.unionByName(heaps).withColumn("rank", F.row_number().over(order)).where((F.col("part") == "pair") | (F.col("rank") <= TOP))
    return ranked.select("lang", "source", "part", "item", "value", "rank")


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diverging(spark, table(spark, sf_dir, "documents"))


#: By definition, every group against every other one over every kept term.
ORACLE = r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
c AS (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(ts) AS term FROM d) GROUP BY ALL),
k AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(ts)) AS term FROM d) GROUP BY ALL HAVING count(*) >= 30),
g AS (SELECT DISTINCT lang, source, 'g' AS kind FROM d UNION ALL SELECT DISTINCT lang, '' AS source, 'l' AS kind FROM d),
ck AS (SELECT c.lang, source, 'g' AS kind, c.term, n FROM c JOIN k USING (lang, term)
  UNION ALL SELECT c.lang, '', 'l', c.term, sum(n) FROM c JOIN k USING (lang, term) GROUP BY ALL),
nv AS (SELECT g.lang, g.source, g.kind, coalesce(sum(ck.n), 0)::HUGEINT AS total FROM g LEFT JOIN ck ON ck.lang = g.lang AND ck.source = g.source AND ck.kind = g.kind GROUP BY ALL),
v AS (SELECT lang, count(*)::HUGEINT AS v FROM k GROUP BY lang),
p AS (SELECT nv.lang, nv.source, nv.kind, k.term, coalesce(ck.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(ck.n, 0) + 5)) // (nv.total + 5 * v.v) AS p
  FROM nv JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN ck ON ck.lang = nv.lang AND ck.source = nv.source AND ck.kind = nv.kind AND ck.term = k.term),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum(abs(a.p - b.p))::BIGINT AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.kind = 'g' AND b.kind = 'g' AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pair.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.kind = 'g' AND b.kind = 'g' AND a.source <> b.source
  LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source),
terms AS (SELECT a.lang, a.source, 'term' AS part, a.term AS item, (a.p - q.p)::BIGINT AS value
  FROM p a JOIN p q ON a.lang = q.lang AND a.term = q.term AND a.kind = 'g' AND q.kind = 'l' WHERE a.n > 0 AND a.p > q.p),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM r WHERE part = 'pair' OR rank <= 50
"""
