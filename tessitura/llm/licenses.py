"""License scans by a positional rare-token index.

Templates are licence texts, notices and short statements with mandatory key phrases. Their words are posted with their
positions, and weigh by inverse document frequency, counted over all documents. A file's licence words are looked up in the
postings: a word leads to the templates of which it is the highest-IDF mandatory word, so the work follows the words that a file
holds, not the number of templates. A template all of whose mandatory words the file holds is intersected by its LOOKED_UP
highest-IDF ones: each of their places in the file says where the template would start. Where the starts of all of them agree within SLACK words, the key phrases are verified
word by word, each within SLACK of its place. Slack lets a text leave out or insert words, such as "either" in "General
Public License, either version 3". A template's coverage is the share of its distinct words that stand in the stretch of its
length, SLACK words more on both sides; it must be LEAST or more.

No place of a template is lost: its key phrases are mandatory, so their rarest words stand in the file at their places. Base
phrases are looked up by their own rarest word in the same way, without slack, and every place counts.

Defined results: null and empty texts have no words and no label; very long texts are scanned whole, in slices of rows. Phrases
match across line ends, as words do. Repeated rows are scanned one by one; ties of IDF go to the word further left. Only the
key and the text are read, whatever other columns are called. If no document holds a licence word, all of them weigh alike;
no rows, no rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import LOWER, Words, chunks, in_arrow, table

#: (label, phrase): every place of these phrases counts.
BASE = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))
#: The wording of public licences and of the notices that they ask for. (label, template, key phrases).
TEMPLATES = (
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ("permission is hereby granted free of charge",)),
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial
portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO
THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.""", ("without restriction including without limitation", "the above copyright notice and this permission notice")),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
that the above copyright notice and this permission notice appear in all copies.""", ("for any purpose with or without fee", "appear in all copies")),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any
damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial
applications, and to alter it and redistribute it freely""", ("without any express or implied warranty", "alter it and redistribute it freely")),
    ("apache-2", "licensed under the apache license version 2 0", ("apache license", "version 2")),
    ("apache-2", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing,
software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND""", ("apache license version 2", "except in compliance with the license")),
    ("gpl-2", "licensed under the gnu general public license version 2", ("gnu general public license", "version 2")),
    ("gpl-3", "licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    ("gpl-2", """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as
published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.""", ("gnu general public license", "version 2 of the license")),
    ("gpl-3", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""", ("gnu general public license", "version 3 of the license")),
    ("lgpl", "licensed under the gnu lesser general public license", ("gnu lesser general public license",)),
    ("agpl-3", "licensed under the gnu affero general public license version 3", ("gnu affero general public license",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("redistribution and use in source and binary forms",)),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer
in the documentation and/or other materials provided with the distribution.""", ("redistributions of source code must retain", "redistributions in binary form must reproduce")),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("mpl-2", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed
with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""", ("source code form is subject to", "copy of the mpl was not distributed")),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
compile, sell, or distribute this software""", ("free and unencumbered software", "public domain")),
    ("cc-by", "licensed under cc by 4 0", ("cc by 4",)),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution 4",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ("creative commons attribution sharealike",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", ("creative commons attribution noncommercial",)),
    ("cc0", "cc0 1 0 universal public domain dedication", ("public domain dedication",)),
    ("all-rights-reserved", "all rights reserved", ("all rights reserved",)),
)
#: Mandatory words of a template that are looked up in a file, rarest first.
LOOKED_UP = 3
#: How many words a key phrase may stand off its place.
SLACK = 8
#: A template's least coverage.
LEAST = 0.5

_INSIDE = np.zeros(256, dtype=bool)
_INSIDE[48:58] = _INSIDE[97:123] = _INSIDE[128:] = True


def read(data: np.ndarray, offsets: np.ndarray) -> Words:
    data = LOWER[data]
    return Words(data, offsets, _INSIDE[data])


def hashed(phrase: str) -> np.ndarray:
    raw = np.frombuffer(phrase.encode(), dtype=np.uint8)
    return read(raw, np.array([0, len(raw)])).hash


def shift_of(phrase: np.ndarray, part: np.ndarray) -> int:
    """Where in a phrase its part begins."""
    return next(i for i in range(len(phrase)) if np.array_equal(phrase[i : i + len(part)], part))


class Index:
    """Base phrases and templates with the weights of their words. idf: by the hash of each licence word."""

    def __init__(self, base: Sequence[tuple[str, str]], templates: Sequence[tuple[str, str, tuple[str, ...]]], idf: dict[int, float]):
        self.idf = idf
        self.words = np.array(sorted(idf), dtype=np.uint64)
        self.base = [(label, phrase, self.rarest(phrase, range(len(phrase)))[0]) for label, text in base for phrase in [hashed(text)]]
        self.templates = []
        for label, text, keys in templates:
            body = hashed(text)
            phrases = [(shift_of(body, k), k) for k in map(hashed, keys)]
            mandatory = sorted({at + i for at, k in phrases for i in range(len(k))})
            looked = self.rarest(body, mandatory)[:LOOKED_UP]
            needed = np.searchsorted(self.words, np.unique(body[mandatory]))
            ids = np.searchsorted(self.words, body)
            keyed = [(shift, k, self.rarest(k, range(len(k)))[0]) for shift, k in phrases]
            self.templates.append((label, ids, [(shift, k, q, int(np.searchsorted(self.words, k[q]))) for shift, k, q in keyed], looked, needed))
        #: Of each licence word the templates that it leads to, as one array by word and its bounds.
        leads = np.array([ids[looked[0]] for _, ids, _, looked, _ in self.templates], dtype=np.int64)
        self.led = np.argsort(leads, kind="stable")
        self.bounds = np.searchsorted(leads[self.led], np.arange(len(self.words) + 1))
        self.leading = np.unique(leads)

    def rarest(self, phrase: np.ndarray, among) -> list[int]:
        """Positions by falling IDF of their words, ties to the left."""
        return sorted(among, key=lambda i: (-self.idf[int(phrase[i])], i))


def vocabulary(base=BASE, templates=TEMPLATES) -> list[int]:
    """The hashes of all licence words."""
    return sorted({int(h) for text in [*(b[1] for b in base), *(t[1] for t in templates)] for h in hashed(text)})


def stands(w: Words, start: np.ndarray, text: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """Whether the phrase stands at each start inside the given text."""
    good = (start >= w.text[text]) & (start + len(phrase) <= w.text[text + 1])
    for j, h in enumerate(phrase):
        at = np.clip(start + j, 0, max(len(w) - 1, 0))
        good &= w.hash[at] == h
    return good


def near(starts: np.ndarray, others: np.ndarray, slack: int) -> np.ndarray:
    """Which starts have one of the others, ascending, within slack."""
    at = np.searchsorted(others, starts - slack)
    return (at < len(others)) & (others[np.minimum(at, max(len(others) - 1, 0))] <= starts + slack) if len(others) else np.zeros(len(starts), dtype=bool)


class Postings:
    """Where the licence words of a slice of texts stand, by text and word."""

    def __init__(self, w: Words, index: Index):
        self.w, self.many = w, len(index.words)
        at = np.minimum(np.searchsorted(index.words, w.hash), self.many - 1)
        spots = np.flatnonzero(index.words[at] == w.hash)
        key = w.owner()[spots] * self.many + at[spots]
        order = np.argsort(key, kind="stable")
        self.key, self.spots = key[order], spots[order]
        self.held = np.unique(self.key)
        self.word = np.full(len(w.hash), -1, dtype=np.int32)
        self.word[spots] = at[spots]

    def holds(self, text: int, words: np.ndarray) -> bool:
        want = text * self.many + words
        at = np.searchsorted(self.held, want)
        return bool((at < len(self.held)).all() and (self.held[at] == want).all())

    def places(self, text: int, word: int) -> np.ndarray:
        """Ascending, counted from the text's first word."""
        lo, hi = np.searchsorted(self.key, [text * self.many + word, text * self.many + word + 1])
        return self.spots[lo:hi] - self.w.text[text]


def found(p: Postings, d: int, ids: np.ndarray, phrases: list[tuple[int, np.ndarray, int, int]], looked: list[int]) -> float:
    """The best coverage of a template (its words' numbers) in text d, or 0 where its key phrases don't stand."""
    start = p.places(d, int(ids[looked[0]])) - looked[0]
    for q in looked[1:]:
        start = start[near(start, p.places(d, int(ids[q])) - q, 2 * SLACK)]  # both lie within SLACK of the first phrase's place
    if not len(start):
        return 0.0
    lo, hi = int(p.w.text[d]), int(p.w.text[d + 1])
    first: np.ndarray | None = None
    for shift, phrase, q, word in phrases:
        at = p.places(d, word) - q
        at = at[stands(p.w, at + lo, np.full(len(at), d), phrase)] - shift
        first = at if first is None else first[near(first, at, SLACK)]
    first = first[near(first, start, SLACK)]
    distinct, best = np.unique(ids), 0.0
    for s in first.tolist():
        around = p.word[max(lo, lo + s - SLACK) : max(lo, min(hi, lo + s + len(ids) + SLACK))]
        best = max(best, float(np.isin(distinct, around).mean()))
    return best if best >= LEAST else 0.0


def scan(w: Words, index: Index) -> list[tuple[int, int, int | None, int | None, str, str, float]]:
    """For each text: words, places, first, last, base labels, labels, score."""
    n = len(w.text) - 1
    owner = w.owner()
    posted = Postings(w, index)
    spots = np.sort(posted.spots)
    spots = spots[np.argsort(w.hash[spots], kind="stable")]
    keys = w.hash[spots]
    places, first, last = np.zeros(n, dtype=np.int64), np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
    based: list[set] = [set() for _ in range(n)]
    labels: list[set] = [set() for _ in range(n)]
    score = np.zeros(n)
    for label, phrase, q in index.base:
        hit = spots[np.searchsorted(keys, phrase[q], "left") : np.searchsorted(keys, phrase[q], "right")]
        start, of = hit - q, owner[hit]
        good = stands(w, start, of, phrase)
        start, of = start[good], of[good]
        inside = start - w.text[of]
        np.add.at(places, of, 1)
        np.minimum.at(first, of, inside)
        np.maximum.at(last, of, inside)
        score[of] = 1.0
        for d in np.unique(of).tolist():
            based[d].add(label)
            labels[d].add(label)
    for at in posted.held[np.isin(posted.held % posted.many, index.leading)].tolist():
        d, word = divmod(at, posted.many)
        for k in index.led[index.bounds[word] : index.bounds[word + 1]].tolist():
            label, ids, phrases, looked, needed = index.templates[k]
            if posted.holds(d, needed) and (cover := found(posted, d, ids, phrases, looked)):
                labels[d].add(label)
                score[d] = max(score[d], cover)
    size = np.diff(w.text)
    return [(int(size[d]), int(places[d]), int(first[d]) if places[d] else None, int(last[d]) if places[d] else None, ",".join(sorted(based[d])), ",".join(sorted(labels[d])), float(score[d])) for d in range(n)]


def weighed(docs: DataFrame, text: str = "text", base=BASE, templates=TEMPLATES) -> Index:
    """The index, with each licence word's document frequency over all documents."""
    known = np.array(vocabulary(base, templates), dtype=np.uint64)

    def count(batches):
        total, rows = np.zeros(len(known), dtype=np.int64), 0
        for b in batches:
            rows += b.num_rows
            for _, data, offsets in chunks(b.column(0)):
                w = read(data, offsets)
                at = np.minimum(np.searchsorted(known, w.hash), len(known) - 1)
                hit = np.flatnonzero(known[at] == w.hash)
                total += np.bincount(np.unique(w.owner()[hit] * len(known) + at[hit]) % len(known), minlength=len(known))
        yield pa.RecordBatch.from_arrays([pa.array([*range(len(known)), -1], pa.int32()), pa.array([*total.tolist(), rows], pa.int64())], ["w", "n"])

    seen = {r["w"]: r["n"] for r in in_arrow(docs.select(text), count, "w int, n long").groupBy("w").agg(F.sum("n").alias("n")).collect()}
    rows = seen.get(-1, 0)
    return Index(base, templates, {int(h): math.log((rows + 1) / (seen.get(i, 0) + 1)) for i, h in enumerate(known.tolist())})


def scanned(docs: DataFrame, index: Index, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, n_base, first_word, last_word, base_labels, labels, score)."""

    def run(batches):
        for b in batches:
            rows = []
            for _, data, offsets in chunks(b.column(1)):
                rows += scan(read(data, offsets), index)
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], ["k", *NAMES])

    return in_arrow(docs.select(key, text), run, f"k {docs.schema[key].dataType.simpleString()}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double").withColumnRenamed("k", key)


NAMES = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scanned(docs, weighed(docs))
