"""Quality: random-indexing word vectors pooled per document, then a two-layer network with calibrated temperature.

A word's vector is the sum of the sparse random index vectors of its neighbours in the sample; index vectors come from
a hash, so nothing but counts is learned. Words outside the sample's vocabulary stand under their shape (runs of small
letters, capitals, digits and signs), and every word counts under its shape as well, as do repeats of words and lines.
A document is the mean of its words' vectors beside the mean of its shapes' vectors.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import _Remembered
from .training import MAX_ROWS, held_out, labelled_texts

DIM, NONZERO, WINDOW, HIDDEN = 64, 6, 2, 24
MEMORY = 300_000
_CAPS, _SMALL, _DIGITS, _TWICE = re.compile(r"[A-ZÀ-ÖØ-Þ]+"), re.compile(r"[^\W\d_A-ZÀ-ÖØ-Þ]+"), re.compile(r"\d+"), re.compile(r"(.)\1+", re.S)
REPEAT, LINE_REPEAT = "<again>", "<line again>"


def shape(word: str) -> str:
    return _TWICE.sub(r"\1", _DIGITS.sub("9", _CAPS.sub("A", _SMALL.sub("a", word))))


def index_vector(item: str) -> np.ndarray:
    """A sparse ternary vector from a hash of the item."""
    rng = np.random.default_rng(zlib.crc32(item.encode("utf-8")))
    out = np.zeros(DIM)
    out[rng.permutation(DIM)[:NONZERO]] = rng.choice([-1.0, 1.0], NONZERO)
    return out


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


@dataclass
class QualityModel:
    words: dict[str, int]
    shapes: dict[str, int]
    word_vectors: np.ndarray
    shape_vectors: np.ndarray
    mean: np.ndarray = None
    scale: np.ndarray = None
    layers: tuple = ()
    temperature: float = 1.0
    lookup: object = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return self.__dict__ | {"lookup": None}

    def _place(self, word: str) -> int:
        """Row of the word (or of its shape, after the words) and row of its shape, in one number."""
        kind = self.shapes.get(shape(word), 0)
        return self.words.get(word.lower(), len(self.words) + kind) << 32 | kind

    def pool(self, text: str) -> np.ndarray:
        if self.lookup is None:
            self.lookup = _Remembered(self._place, MEMORY)
        counts = Counter(text.split())
        n = sum(counts.values())
        if not n:
            return np.zeros(2 * DIM + 2)
        places = np.fromiter(map(self.lookup.__getitem__, counts), np.int64, len(counts))
        weights = np.fromiter(counts.values(), np.float64, len(counts))
        again, lines = n - len(counts), text.split("\n")
        line_again = (len(lines) - len(set(lines))) * n / len(lines)
        by_shape = weights @ self.shape_vectors[places & 0xFFFFFFFF] + again * self.shape_vectors[-2] + line_again * self.shape_vectors[-1]
        return np.concatenate([weights @ self.word_vectors[places >> 32] / n, by_shape / n, [np.log1p(n), again / n]])

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh((pooled - self.mean) / self.scale @ w1 + b1) @ w2 + b2

    def scores(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.logits(np.stack([self.pool(t) for t in texts])) / self.temperature, -30, 30)))


def _vectors(rows: list[tuple[str, int]], min_texts: int) -> QualityModel:
    in_texts, kinds = Counter(), Counter()
    for text, _ in rows:
        distinct = set(text.split())
        in_texts.update({w.lower() for w in distinct})
        kinds.update({shape(w) for w in distinct})
    words = {w: i for i, w in enumerate(sorted(w for w, n in in_texts.items() if n >= min_texts))}
    shapes = {s: i + 1 for i, s in enumerate(sorted(s for s, n in kinds.items() if n >= 2))}  # 0: any other
    items = [*words, *("shape " + s for s in ["", *shapes]), REPEAT, LINE_REPEAT]
    index = np.empty((len(items), DIM))
    for i, item in enumerate(items):
        index[i] = index_vector(item)
    model = QualityModel(words, shapes, index, index[len(words) :])
    context = np.zeros_like(index)
    lookup = _Remembered(model._place, MEMORY)
    for at in range(0, len(rows), 200):
        ids = np.concatenate([np.array([lookup[w] >> 32 for w in text.split()] + [-1] * WINDOW, dtype=np.int64) for text, _ in rows[at : at + 200]])
        for gap in range(1, WINDOW + 1):
            a, b = ids[:-gap], ids[gap:]
            both = (a >= 0) & (b >= 0)
            for to, of in ((a[both], b[both]), (b[both], a[both])):
                if len(to):
                    order = np.argsort(to, kind="stable")
                    starts = np.flatnonzero(np.r_[True, np.diff(to[order]) > 0])
                    context[to[order][starts]] += np.add.reduceat(index[of[order]], starts)
    model.word_vectors = _unit(_unit(context) + _unit(index))
    model.shape_vectors = _unit(index[len(words) :])
    return model


def learn(rows: list[tuple[str, int]], min_texts: int = 3, epochs: int = 150, seed: int = 7) -> QualityModel:
    """Vectors, network (full-batch Adam) and temperature; a fifth of the rows is kept for the temperature."""
    model = _vectors(rows, min_texts)
    x = np.stack([model.pool(t) for t, _ in rows]) if rows else np.zeros((0, 2 * DIM + 2))
    y = np.array([label for _, label in rows], dtype=float)
    model.mean = x.mean(axis=0) if len(x) else np.zeros(2 * DIM + 2)
    model.scale = (x.std(axis=0) if len(x) else np.ones(2 * DIM + 2)) + 1e-6
    rng = np.random.default_rng(seed)
    layers = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    rows_for_temperature = rng.random(len(x)) < 0.2
    if len(set(y[~rows_for_temperature])) < 2:  # one class or none: the prior is all there is to learn
        p = (y.sum() + 1) / (len(y) + 2)
        model.layers = (layers[0], layers[1], np.zeros(HIDDEN), np.array([np.log(p / (1 - p))]))
        return model
    z, t = (x[~rows_for_temperature] - model.mean) / model.scale, y[~rows_for_temperature]
    first, second = [np.zeros_like(v) for v in layers], [np.zeros_like(v) for v in layers]
    for epoch in range(1, epochs + 1):
        h = np.tanh(z @ layers[0] + layers[1])
        p = 1 / (1 + np.exp(-np.clip(h @ layers[2] + layers[3], -30, 30)))
        d = (p - t) / len(t)
        dh = np.outer(d, layers[2]) * (1 - h * h)
        gradients = [z.T @ dh + 1e-4 * layers[0], dh.sum(axis=0), h.T @ d + 1e-4 * layers[2], np.array([d.sum()])]
        for k, g in enumerate(gradients):
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            layers[k] = layers[k] - 0.02 * (first[k] / (1 - 0.9**epoch)) / (np.sqrt(second[k] / (1 - 0.999**epoch)) + 1e-8)
    model.layers = tuple(layers)
    if rows_for_temperature.any():
        logits, t = model.logits(x[rows_for_temperature]), y[rows_for_temperature]
        losses = {}
        for temperature in np.geomspace(0.25, 8, 41):
            p = np.clip(1 / (1 + np.exp(-np.clip(logits / temperature, -30, 30))), 1e-9, 1 - 1e-9)
            losses[float(temperature)] = -(t * np.log(p) + (1 - t) * np.log(1 - p)).mean()
        model.temperature = min(losses, key=losses.get)
    return model


def score_documents(docs: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id and score of every whole text; null texts count as empty, which pool to zeros. One pass, no shuffle.

    Repeated rows are scored as they come; an empty table gives none; other columns are left aside, so their names don't
    matter; very long texts count with all their words.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample's vocabulary

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(shared.value.scores([t or "" for t in part.column(1).to_pylist()]), pa.float64())], schema=schema)

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, score double")


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> QualityModel:
    return learn(labelled_texts(docs, labels, "quality", 3, 1, max_rows))


def op10_quality(spark, sf_dir: str) -> DataFrame:
    """Quality of every whole text of the documents; see score_documents for awkward rows."""
    from .common import table

    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score_documents(docs, model).select("doc_id", held_out(3, 1), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
