"""Operator 13: licence scans by a positional index of rare tokens.

A first pass counts in how many documents each licence word stands. Of every template the words of highest
inverse document frequency are indexed with their positions: so many that no place with enough of the
template's words can do without one of them. The second pass looks a document's words up in that index.
Word i against posting j says that the template may start at i - j; around such relative positions, give or take
the drift, the postings of all the template's words are intersected, and what has enough of them counts if
every mandatory key phrase stands in it, word by word.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annealjobs.llm.shared import runs_of, small_batches, table, utf8

#: A word's bytes once A-Z are lower-cased.
WORD_BYTES = "0-9a-z\x80-\xff"
SHARE = 0.8


class Template(NamedTuple):
    label: str
    text: str
    keys: tuple[str, ...]


# Phrases with their labels, and notices that licences ask for.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
TEMPLATES = (
    Template("agpl-3", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License", ("gnu affero general public license", "version 3")),
    Template("all-rights-reserved", "All rights reserved", ("all rights reserved",)),
    Template("apache-2", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at", ("apache license version 2",)),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms", "conditions are met")),
    Template("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution 4 0",)),
    Template("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", ("creative commons attribution noncommercial",)),
    Template("gpl-3", "This work is licensed under the GNU General Public License, version 3", ("gnu general public license", "version 3")),
    Template("gpl-3", "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License", ("gnu general public license", "version 3")),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", ("with or without fee", "appear in all copies")),
    Template("lgpl-3", "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License", ("gnu lesser general public license", "version 3")),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction", ("permission is hereby granted free of charge", "without restriction")),
    Template("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at", ("mozilla public license v 2 0",)),
    Template("unlicense", "This is free and unencumbered software released into the public domain", ("unencumbered software", "public domain")),
)


def words_of(text: bytes) -> list[bytes]:
    return [w for some in runs_of(WORD_BYTES, text.lower()) for w in some]


def need(n: int, share: float = SHARE) -> int:
    """Words that a template of n must have somewhere."""
    return max(1, math.ceil(share * n - 1e-9))


def drift(n: int) -> int:
    """Words by which a template's word may stand off its place."""
    return n // 10


class Scanner:
    """What tasks need: numbers of licence words, templates and phrases in them, and the index of rare words."""

    def __init__(self, templates: Sequence[Template], phrases: Sequence[tuple[str, str]], documents: dict[bytes, int] | None = None, share: float = SHARE):
        self.number: dict[bytes, int] = {}
        ids = lambda text: np.array([self.number.setdefault(w, len(self.number) + 1) for w in words_of(text.encode())], np.int32)
        self.phrases = [(ids(text), label) for text, label in phrases]
        self.templates = [(t.label, ids(t.text), [ids(k) for k in t.keys]) for t in templates]
        self.share, self.rare = share, defaultdict(list)
        by_number = {self.number[w]: n for w, n in (documents or {}).items()}
        for t, (_, words, _) in enumerate(self.templates):
            rarest = sorted(range(len(words)), key=lambda j: (by_number.get(int(words[j]), 0), j))
            for j in rarest[: len(words) - need(len(words), share) + 1]:
                self.rare[int(words[j])].append((t, j))
        self.is_rare = np.zeros(len(self.number) + 1, bool)
        self.is_rare[list(self.rare)] = True

    def ids(self, text: bytes) -> np.ndarray:
        """The number of each word of a text, 0 for words of no licence."""
        get = self.number.get
        parts = [np.fromiter((get(w, 0) for w in some), np.int32, len(some)) for some in runs_of(WORD_BYTES, text.lower())]
        return np.concatenate(parts) if parts else np.zeros(0, np.int32)

    @staticmethod
    def places(ids: np.ndarray, phrase: np.ndarray) -> np.ndarray:
        """Where the phrase's words stand one after the other."""
        at = np.flatnonzero(ids[: max(0, len(ids) - len(phrase) + 1)] == phrase[0])
        for k, word in enumerate(phrase[1:].tolist()):
            at = at[ids[at + k + 1] == word]
        return at

    def found(self, ids: np.ndarray) -> list[tuple[str, float]]:
        """(label, share) of the templates that stand in a document, at their best place."""
        hits = np.flatnonzero(self.is_rare[ids])
        if not len(hits):
            return []
        starts: dict[int, set[int]] = defaultdict(set)
        for i in hits.tolist():
            for t, j in self.rare[int(ids[i])]:
                starts[t].add(i - j)
        order = np.argsort(ids, kind="stable")
        by_word = ids[order]
        out = []
        for t, anchors in starts.items():
            label, words, keys = self.templates[t]
            d = drift(len(words))
            starting = np.unique(np.array(sorted(anchors))[:, None] + np.arange(-d, d + 1))
            best, hit = need(len(words), self.share), np.zeros(len(starting), np.int64)
            for j, word in enumerate(words.tolist()):
                lo, hi = np.searchsorted(by_word, [word, word + 1])
                own = order[lo:hi]
                hit += np.searchsorted(own, starting + j + d, "right") > np.searchsorted(own, starting + j - d, "left")
            ok = hit >= best
            for key in keys if ok.any() else ():
                own = self.places(ids, key)
                ok &= np.searchsorted(own, starting + len(words) + d - len(key), "right") > np.searchsorted(own, starting - d, "left")
            if ok.any():
                out.append((label, int(hit[ok].max()) / len(words)))
        return out

    def judged(self, text: bytes) -> tuple:
        ids = self.ids(text)
        base = [(label, self.places(ids, phrase)) for phrase, label in self.phrases]
        n = sum(len(at) for _, at in base)
        own = {label for label, at in base if len(at)}
        more = self.found(ids)
        score = 1.0 if own else max((x for _, x in more), default=0.0)
        first, last = (min(int(at[0]) for _, at in base if len(at)), max(int(at[-1]) for _, at in base if len(at))) if n else (None, None)
        return len(ids), n, first, last, ",".join(sorted(own)), ",".join(sorted(own | {label for label, _ in more})), score


def document_frequencies(docs: DataFrame, vocabulary: Sequence[bytes]) -> dict[bytes, int]:
    """In how many rows of docs (text) each word of a vocabulary stands; counts are added up by Spark."""
    small_batches(docs.sparkSession)
    known = frozenset(vocabulary)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        for b in batches:
            for text in utf8(b.column(0)):
                own: set[bytes] = set()
                for some in runs_of(WORD_BYTES, text.lower()):
                    own |= known.intersection(some)
                n.update(own)
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64())], ["word", "n"])

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "word binary, n long")
    return {bytes(r.word): r.n for r in rows.groupBy("word").agg(F.sum("n").alias("n")).collect()}  # a row a word of the vocabulary


def scan(docs: DataFrame, templates: Sequence[Template] = TEMPLATES, phrases: Sequence[tuple[str, str]] = PHRASES, share: float = SHARE) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) for every row of docs (doc_id, text).

    A template stands where at least share of its words are within the drift (a tenth of its length) of their
    places and its key phrases are whole; labels have those of templates and of phrases. score: 1 with a
    phrase, else the largest share of a template that stands, else 0. Texts are read whole; null and empty texts
    have no words and no labels (''); rows that repeat, or have no doc_id, are judged alike; other columns are
    ignored; an empty table gives an empty result. Templates and phrases, which are parameters, go to every task.
    """
    small_batches(docs.sparkSession)
    documents = document_frequencies(docs, list(Scanner(templates, phrases).number))
    scanner = Scanner(templates, phrases, documents, share)
    kinds = [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = list(zip(*map(scanner.judged, utf8(b.column(1))))) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, (_, k) in zip(columns, kinds))], ["doc_id", *(n for n, _ in kinds)])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def op13_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def oracle(templates: Sequence[Template] = TEMPLATES, phrases: Sequence[tuple[str, str]] = PHRASES, share: float = SHARE) -> str:
    """DuckDB SQL for op13_license_scans: every start of every template is tried, without an index."""
    words = lambda text: [w.decode() for w in words_of(text.encode())]
    values = lambda rows: ", ".join("(" + ", ".join(repr(x) for x in row) + ")" for row in rows)
    tw = [(t, j, w) for t, x in enumerate(templates) for j, w in enumerate(words(x.text))]
    ts = [(t, x.label, n := len(words(x.text)), drift(n), need(n, share), len(x.keys)) for t, x in enumerate(templates)]
    kw = [(t, k, i, w, len(words(key))) for t, x in enumerate(templates) for k, key in enumerate(x.keys) for i, w in enumerate(words(key))]
    pw = [(p, label, i, w, len(words(text))) for p, (text, label) in enumerate(phrases) for i, w in enumerate(words(text))]
    return rf"""WITH d AS (SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
  w AS (SELECT id, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM d),
  tw(t, j, word) AS (VALUES {values(tw)}), ts(t, label, n, d, need, n_keys) AS (VALUES {values(ts)}), kw(t, k, x, word, n) AS (VALUES {values(kw)}), pw(p, label, x, word, n) AS (VALUES {values(pw)}),
  hits AS (SELECT id, t, j, unnest(range(i - j - d, i - j + d + 1)) AS o FROM w JOIN tw USING (word) JOIN ts USING (t)),
  starts AS (SELECT id, t, o, count(DISTINCT j) AS c FROM hits GROUP BY id, t, o),
  key_at AS (SELECT id, t, k, i - x AS pos, max(n) AS n FROM w JOIN kw USING (word) GROUP BY id, t, k, i - x HAVING count(*) = max(n)),
  ok AS (SELECT s.id, s.t, s.o, max(s.c) AS c FROM starts s JOIN ts USING (t) JOIN key_at a ON a.id = s.id AND a.t = s.t AND a.pos >= s.o - d AND a.pos + a.n <= s.o + ts.n + d WHERE s.c >= need GROUP BY s.id, s.t, s.o HAVING count(DISTINCT a.k) = max(n_keys)),
  found AS (SELECT id, label, max(c::DOUBLE / n) AS share FROM ok JOIN ts USING (t) GROUP BY id, label),
  base AS (SELECT id, p, i - x AS pos, max(label) AS label FROM w JOIN pw USING (word) GROUP BY id, p, i - x HAVING count(*) = max(n)),
  b AS (SELECT id, count(*) AS n, min(pos) AS first_word, max(pos) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY id),
  l AS (SELECT id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT id, label FROM found UNION ALL SELECT id, label FROM base) GROUP BY id),
  s AS (SELECT id, max(share) AS share FROM found GROUP BY id)
  SELECT doc_id, len(ws) AS n_words, coalesce(b.n, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CASE WHEN b.n > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0::DOUBLE) END AS score
  FROM d LEFT JOIN b USING (id) LEFT JOIN l USING (id) LEFT JOIN s USING (id)"""
