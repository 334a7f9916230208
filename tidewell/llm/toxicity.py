"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text, normalised by length, with exception phrases.

Folding is letter by letter, so places in folded and plain text agree: lower case, look-alike letters of other
scripts, digits and signs put for letters, and i, l, 1, ! and | as one; accents stay, as they tell words apart. A match counts where no letter or digit of the
plain text touches it. The lexicon's words and weights, its exception phrases and the calibration are learned from a
bounded sample of labelled rows; where that sample has no toxic row, a small default lexicon is used.
"""

from __future__ import annotations

import math
import re
import zlib
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass, field
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .training import MAX_ROWS, held_out, labelled_texts

# What is folded to which letter.
_ALIKE = {
    "a": "4@аɑα", "b": "8ьв", "c": "сϲ", "d": "ԁ", "e": "3€е", "g": "9ɡ", "h": "һн", "i": "1!|lіӏιı", "k": "кκ", "m": "м", "n": "п",
    "o": "0оοσ", "p": "рρ", "s": "5$ѕ", "t": "7+тτ", "u": "υ", "v": "ν", "x": "хχ", "y": "у", "z": "2",
}
_INVISIBLE = re.compile("[­​-‍⁠﻿]")
#: Used only where no toxic row is labelled.
DEFAULT_LEXICON = {"idiot": 4.0, "moron": 4.0, "scum": 4.0, "stupid": 3.0, "pathetic": 3.0, "worthless": 3.0, "disgusting": 3.0, "loser": 3.0, "trash": 3.0, "clown": 3.0}
#: Harmless phrases with words of that kind.
DEFAULT_EXCEPTIONS = ("trash can", "trash bin", "trash collection", "clown fish", "clown car")
_WORD = re.compile(r"[^\W_]+")


def _folding() -> dict[int, str]:
    table = {}
    for code in range(0x250):
        lower = chr(code).lower()
        if len(lower) == 1:
            table[code] = lower
    for base, others in _ALIKE.items():
        for c in others:
            table[ord(c)] = base
            if len(c.upper()) == 1 and c.upper() != c:
                table[ord(c.upper())] = base
    table[ord("L")] = "i"
    for code in range(0xFF01, 0xFF5F):  # full-width forms
        plain = chr(code - 0xFEE0)
        table[code] = table.get(ord(plain), plain.lower())
    return table


FOLDING = _folding()


def fold(text: str) -> str:
    return text.translate(FOLDING)


def shown(text: str) -> str:
    """Without the characters that don't show."""
    return text if text.isascii() else _INVISIBLE.sub("", text)


def _near_key(words: list[str]) -> int:
    """The same for most near copies: the smallest hash of three words."""
    return min((zlib.crc32(" ".join(words[i : i + 3]).encode()) for i in range(max(1, len(words) - 2))), default=0)


@dataclass
class ToxicityModel:
    lexicon: dict[str, float]
    exceptions: tuple[str, ...] = DEFAULT_EXCEPTIONS
    power: float = 0.25
    slope: float = 2.0
    shift: float = -2.0
    automaton: object = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return self.__dict__ | {"automaton": None}

    def _machine(self):
        if self.automaton is None:
            import ahocorasick

            self.automaton = ahocorasick.Automaton()
            for word, weight in self.lexicon.items():
                self.automaton.add_word(fold(word), (len(word), weight))
            for phrase in self.exceptions:
                self.automaton.add_word(fold(phrase), (len(phrase), None))
            if len(self.automaton):
                self.automaton.make_automaton()
        return self.automaton

    def hits(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, weight) of the lexicon's words, those inside exception phrases left out."""
        machine = self._machine()
        if not len(machine):
            return []
        found, excused = [], []
        for last, (n, weight) in machine.iter(fold(text)):
            start, end = last + 1 - n, last + 1
            if (start and text[start - 1].isalnum()) or (end < len(text) and text[end].isalnum()):
                continue
            (excused if weight is None else found).append((start, end, weight))
        if excused:
            # Of the phrases that start at or before a hit, the furthest end tells whether one of them holds it.
            excused.sort(key=lambda x: x[0])
            starts, furthest = [x[0] for x in excused], list(accumulate((x[1] for x in excused), max))
            found = [h for h in found if not (k := bisect_right(starts, h[0])) or furthest[k - 1] < h[1]]
        return found

    def sums(self, text: str) -> tuple[float, int, int]:
        """Weight of the hits, number of words, number of hits."""
        text = shown(text)
        hits = self.hits(text)
        return sum(h[2] for h in hits), max(1, text.count(" ") + text.count("\n") + 1), len(hits)

    def level(self, text: str) -> tuple[float, int]:
        weight, words, n = self.sums(text)
        return math.log1p(weight * 20 / words**self.power), n

    def score(self, text: str) -> tuple[float, int]:
        level, n = self.level(text)
        z = max(-30.0, min(30.0, self.slope * level + self.shift))
        return 1 / (1 + math.exp(-z)), n


def learn(rows: list[tuple[str, int]], min_share: float = 0.01, min_z: float = 3.2) -> ToxicityModel:
    """Lexicon by log-odds of document frequency, near copies counted once; then a logistic fit of the level.

    A word joins when min_share of the toxic texts have it and its log-odds stand min_z standard errors above 0.
    The exponent of the length is the one with the least loss on the rows.
    """
    folded = lambda text: [fold(w) for w in _WORD.findall(shown(text))]
    seen, kept, sizes, toxic = set(), [], [0, 0], Counter()
    for text, label in rows:
        words = folded(text)
        key = (_near_key(words), label)
        if key not in seen:
            seen.add(key)
            kept.append((text, label))
            sizes[label] += 1
            if label:
                toxic.update(set(words))
    # Only words that enough toxic texts have are counted in the others: texts are read again rather than held as words.
    likely = {w: t for w, t in toxic.items() if len(w) >= 3 and t >= max(3, min_share * sizes[1])}
    clean = Counter()
    for text, label in kept:
        if not label:
            clean.update(likely.keys() & set(folded(text)))
    lexicon = {}
    for word, t in likely.items():
        c = clean[word]
        odds = math.log((t + 0.5) / (sizes[1] + 1)) - math.log((c + 0.5) / (sizes[0] + 1))
        if odds / math.sqrt(1 / (t + 0.5) + 1 / (c + 0.5)) >= min_z and t / (sizes[1] + 1) > 10 * c / (sizes[0] + 1):
            lexicon[word] = round(odds, 6)
    if not lexicon:
        return ToxicityModel(dict(DEFAULT_LEXICON))
    contexts = (Counter(), Counter())
    for text, label in kept:
        words = folded(text)
        for a, b in zip(words, words[1:]):
            if a in lexicon or b in lexicon:
                contexts[label][f"{a} {b}"] += 1
    learned = sorted(p for p, n in contexts[0].items() if n >= 2 and not contexts[1][p])
    model = ToxicityModel(lexicon, tuple(dict.fromkeys((*DEFAULT_EXCEPTIONS, *learned))))
    best, sums = None, [model.sums(text) for text, _ in rows]
    for power in (0.1, 0.25, 0.5):
        levels = [math.log1p(weight * 20 / words**power) for weight, words, _ in sums]
        slope, shift, loss = _logistic(levels, [label for _, label in rows])
        if best is None or loss < best[0] - 1e-9:
            best = (loss, power, slope, shift)
    _, model.power, model.slope, model.shift = best
    return model


def _logistic(x: list[float], y: list[int], ridge: float = 1e-3) -> tuple[float, float, float]:
    """Newton steps for one input with a small ridge, so that separable rows settle too."""
    import numpy as np

    x, y = np.asarray(x), np.asarray(y, dtype=float)
    a = np.stack([x, np.ones_like(x)], axis=1)
    w = np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        gradient = a.T @ (p - y) + ridge * w
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(2), gradient)
        w -= step
        if abs(step).max() < 1e-8:
            break
    p = np.clip(1 / (1 + np.exp(-np.clip(a @ w, -30, 30))), 1e-12, 1 - 1e-12)
    return float(w[0]), float(w[1]), float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())


def score_documents(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, score, n_hits of every whole text; null and empty texts score as texts without a hit. No shuffle.

    Repeated rows are scored as they come; an empty table gives none; other columns are left aside, so their names don't
    matter; very long texts are matched whole.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("n_hits", pa.int64())])

    def run(batches):
        for batch in batches:
            got = [model.score(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s for s, _ in got], pa.float64()), pa.array([n for _, n in got], pa.int64())], schema=schema)

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, score double, n_hits long")


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> ToxicityModel:
    return learn(labelled_texts(docs, labels, "toxic", 5, 0, max_rows))


def drop_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, whose text scores below the threshold. Works row by row: repeated rows stay or go
    alike, names of other columns don't matter, null and empty texts score as texts without a hit."""
    schema = docs.schema
    place = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            keep = [model.score(t.as_py() or "")[0] < threshold for t in batch.column(place)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, schema)


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text of the documents; see score_documents for awkward rows."""
    from .common import table

    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score_documents(docs, model).select("doc_id", held_out(5, 0), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "n_hits")
