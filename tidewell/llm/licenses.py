"""License scans: exact phrase places, and an exact containment join of text blocks with license templates.

A block is a line of a text, each pair of neighbouring lines, and, since a statement may be wrapped over any number of
lines, each run of words as long as the template allows (its length / CONTAINMENT) in the whole text. A block holds a
template when at least CONTAINMENT of the template's distinct words are among the block's. Words are ordered by how many lines and pairs of the whole corpus have them, rarest first. Of a template's n words in that order, a block that holds it
must have one of the first n - need + 1 (prefix filter), must have `need` words at least (length filter), and, when
the first shared word stands at place i, can share n - i words at most (positional filter). Only what passes is
counted out; runs are slid over a text only for templates that the text's words as one block would hold. Templates are few and fixed, so they and their words' counts travel with the tasks.
"""

from __future__ import annotations

import math
import re
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CONTAINMENT = 0.8
# Phrases of the base scan, and statements commonly put in files under each license.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl-2", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2"),
    ("lgpl-3", "licensed under the gnu lesser general public license version 3"),
    ("agpl-3", "licensed under the gnu affero general public license version 3"),
    ("bsd-3", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license version 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("proprietary", "all rights reserved no part of this work may be reproduced without written permission"),
)
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
VOCABULARY = frozenset(w for _, t in TEMPLATES for w in WORD.findall(t))


def lower(text: str) -> str:
    return text.lower() if text.isascii() else text.translate(_LOWER)


def lines(text: str) -> list[tuple[int, int, list[str], set[str]]]:
    """Number, place of the first word, words and template words of every line that has any template word."""
    out, at = [], 0
    for k, line in enumerate(text.split("\n")):
        words = WORD.findall(line)
        here = VOCABULARY.intersection(words)
        if here:
            out.append((k, at, words, here))
        at += len(words)
    return out


def blocks(rows: list[tuple[int, int, list[str], set[str]]]):
    """Sets of template words of lines, then neighbours. Other words can't matter."""
    last, before = -2, set()
    for k, _, _, here in rows:
        yield here
        if k == last + 1 and not (here <= before or before <= here):
            yield here | before
        last, before = k, here


class Index:
    """Prefixes of the templates in the order of the counts."""

    def __init__(self, counts: dict[str, int], containment: float = CONTAINMENT):
        self.order = {w: i for i, w in enumerate(sorted(VOCABULARY, key=lambda w: (counts.get(w, 0), w)))}
        self.templates, self.prefixes = [], {}
        for label, text in TEMPLATES:
            words = sorted(set(WORD.findall(text)), key=self.order.__getitem__)
            need = math.ceil(containment * len(words) - 1e-9)
            for place, word in enumerate(words[: len(words) - need + 1]):
                self.prefixes.setdefault(word, []).append((len(self.templates), place))
            self.templates.append((label, frozenset(words), need, len(words)))
        self.runs = [math.ceil(len(WORD.findall(text)) / containment - 1e-9) for _, text in TEMPLATES]

    def _held(self, block: set[str]):
        """(template, shared words) of every template that the block holds."""
        first: dict[int, int] = {}
        for word in block:
            for t, place in self.prefixes.get(word, ()):
                if place < first.get(t, 1 << 30):
                    first[t] = place
        for t, place in first.items():
            _, words, need, n = self.templates[t]
            if len(block) < need or n - place < need:
                continue
            shared = len(words & block)
            if shared >= need:
                yield t, shared

    def matches(self, rows: list[tuple[int, int, list[str], set[str]]]):
        """(label, containment) of every template that a block of these lines holds."""
        for block in blocks(rows):
            for t, shared in self._held(block):
                yield self.templates[t][0], shared / self.templates[t][3]
        if len(rows) < 2:
            return
        text = None
        for t, _ in self._held(set().union(*(here for *_, here in rows))):
            label, words, need, n = self.templates[t]
            if text is None:
                text = [(at, w) for _, start, line, _ in rows for at, w in enumerate(line, start) if w in VOCABULARY]
            shared = self._most(text, words, self.runs[t])
            if shared >= need:
                yield label, shared / n

    @staticmethod
    def _most(text: list[tuple[int, str]], words: frozenset[str], run: int) -> int:
        """The most distinct words of a template in any run of that many words of the text."""
        window: deque[tuple[int, str]] = deque()
        counts: dict[str, int] = {}
        most = 0
        for at, word in text:
            if word not in words:
                continue
            window.append((at, word))
            counts[word] = counts.get(word, 0) + 1
            while window[0][0] <= at - run:
                gone = window.popleft()[1]
                counts[gone] -= 1
                if not counts[gone]:
                    del counts[gone]
            most = max(most, len(counts))
        return most


def base_places(text: str) -> tuple[int, list[tuple[int, str]]]:
    """Number of words, and (start, label) of every base phrase; words are looked at only where the phrase may stand."""
    words = WORD.findall(text)
    found = []
    if any(p.split()[-1] in text for p, _ in BASE):
        for phrase, label in BASE:
            parts = phrase.split()
            if all(p in text for p in parts):
                at = -1
                try:
                    while True:
                        at = words.index(parts[0], at + 1)
                        if words[at : at + len(parts)] == parts:
                            found.append((at, label))
                except ValueError:
                    pass
    return len(words), found


def word_counts(docs: DataFrame) -> dict[str, int]:
    """In how many lines and pairs of the corpus each template word stands: one row a word and task, then a sum."""

    def run(batches):
        counts: dict[str, int] = {}
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for block in blocks(lines(lower(text or ""))):
                    for word in block:
                        counts[word] = counts.get(word, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    rows = docs.selectExpr("cast(text as string) text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {r.word: r.n for r in rows}  # no more rows than VOCABULARY has words


def scan(docs: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """One row a document: words, base places, labels, and the largest containment as score (1 with a base label).

    Null and empty texts have 0 words, no labels and score 0; repeated rows are scanned as they come; an empty table gives
    none; other columns are left aside, so their names don't matter; very long texts are scanned whole.
    """
    index = Index(word_counts(docs), containment)
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())])

    def one(text: str):
        text = lower(text)
        n, found = base_places(text)
        own = {label for _, label in found}
        labels, score = set(own), 1.0 if own else 0.0
        for label, share in index.matches(lines(text)):
            labels.add(label)
            score = max(score, share)
        places = [at for at, _ in found]
        return n, len(found), min(places, default=None), max(places, default=None), ",".join(sorted(own)), ",".join(sorted(labels)), score

    def run(batches):
        for batch in batches:
            rows = [one(t or "") for t in batch.column(1).to_pylist()]
            columns = zip(*rows) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:]))], schema=schema)

    ddl = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, ddl)


def op6_license_scan(spark, sf_dir: str) -> DataFrame:
    """License statements in every whole text of the documents; see scan for awkward rows."""
    from .common import table

    return scan(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    """By brute force: every line, pair of lines and run of words against every template."""
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    lowered = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    base = " UNION ALL ".join(
        f"SELECT doc_id, row_no, i - 1 AS place, '{label}' AS label FROM starts WHERE " + " AND ".join(f"words[i + {k}] = '{p}'" for k, p in enumerate(phrase.split())) for phrase, label in BASE
    )
    values = ", ".join(f"({k}, '{label}', {sorted(set(WORD.findall(t)))!r}, {-(-len(WORD.findall(t)) * 5 // 4)})" for k, (label, t) in enumerate(TEMPLATES))
    return rf"""
WITH d AS (SELECT row_number() OVER () AS row_no, doc_id, {lowered} AS body FROM documents),
w AS (SELECT row_no, doc_id, regexp_extract_all(body, '{word}') AS words FROM d),
starts AS (SELECT row_no, doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM w),
base AS ({base}),
b AS (SELECT row_no, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY row_no),
lines AS (SELECT row_no, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) AS k FROM d),
sets AS (SELECT row_no, k, list_distinct(regexp_extract_all(line, '{word}')) AS s FROM lines),
blocks AS (SELECT row_no, s FROM sets UNION ALL SELECT a.row_no, list_distinct(list_concat(a.s, z.s)) FROM sets a JOIN sets z ON a.row_no = z.row_no AND z.k = a.k + 1),
templates(k, label, t, run) AS (VALUES {values}),
places AS (SELECT row_no, k, run, i, word FROM (SELECT row_no, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w) JOIN (SELECT k, run, unnest(t) AS word FROM templates) USING (word)),
runs AS (SELECT a.row_no, a.k, a.i, count(DISTINCT z.word) AS shared FROM places a JOIN places z ON a.row_no = z.row_no AND a.k = z.k AND z.i BETWEEN a.i AND a.i + a.run - 1 GROUP BY ALL),
shares AS (SELECT row_no, label, len(list_intersect(t, s)) AS shared, len(t) AS n FROM blocks, templates UNION ALL SELECT row_no, label, shared, len(t) FROM runs JOIN templates USING (k)),
m AS (SELECT row_no, label, max(CAST(shared AS DOUBLE) / n) AS share FROM shares WHERE 10 * shared >= 8 * n GROUP BY row_no, label),
al AS (SELECT row_no, label, share FROM m UNION ALL SELECT row_no, label, 1.0 FROM base),
g AS (SELECT row_no, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM al GROUP BY row_no)
SELECT w.doc_id, CAST(len(w.words) AS BIGINT) AS n_words, coalesce(b.n_base, 0) AS n_base, b.first_word, b.last_word, coalesce(b.base_labels, '') AS base_labels, coalesce(g.labels, '') AS labels, coalesce(g.score, 0.0) AS score
FROM w LEFT JOIN b USING (row_no) LEFT JOIN g USING (row_no)
"""


ORACLE = _oracle()
