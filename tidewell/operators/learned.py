"""Learned ranking: boosted regression trees on the lambdas of nDCG.

Trees are grown level by level. A level is one aggregate over binned features: gradients and curvatures by (node,
feature, bin) are what the driver sees, a number of rows that doesn't depend on the data's size; it picks the splits.
Gradients are whole numbers, so that sums don't depend on their order and every run grows the same trees. A model is
scored as an expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.sources.scratch import Scratch

FEATURES = ("lexical_score", "lexical_rank", "vector_score", "vector_rank", "fused_score", "length", "words", "distinct_share", "n_tags")
TREES, DEPTH, BINS, RATE, RIDGE, LEAST = 10, 2, 16, 0.3, 1.0, 5
#: Gradients are kept in units of 2 ** -UNIT_BITS, values of features and leaves to DIGITS digits.
UNIT_BITS, DIGITS = 20, 4


@dataclass
class Ranker:
    """cuts: bounds between the bins of each feature. Trees: (feature, bin, left, right), left where the value is in that
    bin or an earlier one, or a leaf's value."""

    features: tuple[str, ...]
    cuts: list[list[float]]
    trees: list = field(default_factory=list)

    def bins(self) -> list[Column]:
        out = []
        for name, cuts in zip(self.features, self.cuts):
            value, column = _rounded(F.col(name)), F.lit(len(cuts))
            for k in range(len(cuts) - 1, -1, -1):
                column = F.when(value <= cuts[k], k).otherwise(column)
            out.append(column.cast("int"))
        return out

    def score(self, bins: list[Column] | None = None) -> Column:
        bins = bins or self.bins()
        total = F.lit(0.0)
        for tree in self.trees:
            total = total + _case(tree, bins)
        return F.floor(total * 1e6 + 0.5) / 1e6


def _rounded(value: Column) -> Column:
    """To DIGITS digits, by operations that every engine does alike."""
    return F.floor(value.cast("double") * float(10**DIGITS) + 0.5) / float(10**DIGITS)


def _case(tree, bins: list[Column]) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    feature, cut, left, right = tree
    return F.when(bins[feature] <= cut, _case(left, bins)).otherwise(_case(right, bins))


def cut_points(rows: DataFrame, features: tuple[str, ...] = FEATURES, bins: int = BINS) -> list[list[float]]:
    """Bounds of bins with about as many rows each: values that occur, from a sketch that is exact for some ten thousand rows."""
    shares = [k / bins for k in range(1, bins)]
    row = rows.agg(*[F.percentile_approx(_rounded(F.col(f)), shares, 1_000_000).alias(f) for f in features]).first()
    return [sorted(set(row[f])) if row[f] else [] for f in features]


def gradients(score: np.ndarray, grade: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lambda and curvature of each document of one query, in whole units.

    Every two documents of different grades pull apart by the change of nDCG that swapping them would make.
    """
    gain = 2.0**grade - 1
    place = np.empty(len(score))
    place[np.lexsort((doc, -score))] = np.arange(len(score))
    discount = 1 / np.log2(place + 2)
    ideal = (np.sort(gain)[::-1] / np.log2(np.arange(len(gain)) + 2)).sum()
    if ideal <= 0:
        return np.zeros(len(score), np.int64), np.zeros(len(score), np.int64)
    better = grade[:, None] > grade[None, :]
    weight = np.where(better, np.abs(gain[:, None] - gain[None, :]) * np.abs(discount[:, None] - discount[None, :]) / ideal, 0.0)
    chance = 1 / (1 + np.exp(score[:, None] - score[None, :]))
    push, bend = weight * chance, weight * chance * (1 - chance)
    units = lambda x: np.floor(x * (1 << UNIT_BITS) + 0.5).astype(np.int64)
    return units(push.sum(axis=1) - push.sum(axis=0)), units(bend.sum(axis=1) + bend.sum(axis=0))


def best_split(cells: dict, totals: tuple[int, int, int], features: int, bins: int, ridge: float = RIDGE, least: int = LEAST):
    """(feature, bin) with the largest gain, the earliest of those alike; None where nothing gains.
    cells: {(feature, bin): (gradient, curvature, rows)} of one node."""
    unit = float(1 << UNIT_BITS)
    value = lambda g, h: (g / unit) * (g / unit) / (h / unit + ridge)
    best, choice = 1e-9, None
    for f in range(features):
        g = h = n = 0
        for b in range(bins):
            dg, dh, dn = cells.get((f, b), (0, 0, 0))
            g, h, n = g + dg, h + dh, n + dn
            if n >= least and totals[2] - n >= least:
                gain = math.floor((value(g, h) + value(totals[0] - g, totals[1] - h) - value(totals[0], totals[1])) * 1e9 + 0.5) / 1e9
                if gain > best:
                    best, choice = gain, (f, b)
    return choice


def leaf_value(g: int, h: int, rate: float = RATE, ridge: float = RIDGE) -> float:
    unit = float(1 << UNIT_BITS)
    return math.floor(rate * (g / unit) / (h / unit + ridge) * 1e6 + 0.5) / 1e6


def _leaf_number(tree, bins: list[Column], numbers: dict) -> Column:
    """Which leaf a row is in; numbers maps a path to a number, and grows."""

    def walk(node, path):
        if not isinstance(node, tuple):
            return F.lit(numbers.setdefault(path, len(numbers)))
        feature, cut, left, right = node
        return F.when(bins[feature] <= cut, walk(left, (*path, 0))).otherwise(walk(right, (*path, 1)))

    return walk(tree, ())


def _put(tree, path: tuple, value):
    if not path:
        return value
    feature, cut, *sides = tree
    sides[path[0]] = _put(sides[path[0]], path[1:], value)
    return (feature, cut, *sides)


def grow(rows: DataFrame, bins: list[str], widths: list[int], depth: int = DEPTH, rate: float = RATE, ridge: float = RIDGE, least: int = LEAST):
    """One tree over rows of binned features, g and h: a pass a level, and the driver sees sums by node, feature and bin."""
    columns, tree, open_ = [F.col(b) for b in bins], 0.0, {()}
    cell = F.explode(F.array(*[F.struct(F.lit(k).alias("feature"), c.alias("bin")) for k, c in enumerate(columns)])).alias("cell")
    for level in range(depth + 1):
        numbers: dict = {}
        node = _leaf_number(tree, columns, numbers)
        paths = {v: k for k, v in numbers.items()}
        sums: dict = {}
        if level < depth:
            got = rows.select(node.alias("node"), cell, "g", "h").groupBy("node", "cell.feature", "cell.bin")
        else:
            got = rows.select(node.alias("node"), F.lit(0).alias("feature"), F.lit(0).alias("bin"), "g", "h").groupBy("node", "feature", "bin")
        for r in got.agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.count("*").alias("n")).collect():
            sums.setdefault(paths[r.node], {})[r.feature, r.bin] = (r.g, r.h, r.n)
        for path, cells in sums.items():
            totals = tuple(sum(v[i] for (f, _), v in cells.items() if f == 0) for i in range(3))
            choice = best_split(cells, totals, len(bins), max(widths), ridge, least) if level < depth and path in open_ else None
            tree = _put(tree, path, (*choice, 0.0, 0.0) if choice else leaf_value(totals[0], totals[1], rate, ridge))
            open_.discard(path)
            if choice:
                open_ |= {(*path, 0), (*path, 1)}
        if not open_:
            break
    return tree


def train(rows: DataFrame, features: tuple[str, ...] = FEATURES, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE) -> Ranker:
    """A ranker from judged hits: query_id, doc_id, grade (0, 1, 2 ...) and the features, of which a null counts as 0.

    A query's hits come together in one task; search hands out some hundred a query. Queries whose hits all have one
    grade teach nothing; without any rows the model scores 0.
    """
    clean = rows.where("grade is not null").select("query_id", "doc_id", F.col("grade").cast("double").alias("grade"), *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features])
    with Scratch(rows.sparkSession) as scratch:
        clean = scratch.stored(clean)
        model = Ranker(tuple(features), cut_points(clean, features, bins))
        names = [f"b{k}" for k in range(len(features))]
        binned = scratch.stored(clean.select("query_id", "doc_id", "grade", *[b.alias(n) for b, n in zip(model.bins(), names)]))
        columns = [F.col(n) for n in names]

        def pull(group: pa.Table) -> pa.Table:
            g, h = gradients(*(group.column(c).to_numpy() for c in ("score", "grade", "doc_id")))
            return group.select(names).append_column("g", pa.array(g)).append_column("h", pa.array(h))

        schema = ", ".join(f"{n} int" for n in names) + ", g long, h long"
        for _ in range(trees):
            scored = binned.withColumn("score", model.score(columns))
            pulled = scratch.stored(scored.groupBy("query_id").applyInArrow(pull, schema))
            model.trees.append(grow(pulled, names, [len(c) + 1 for c in model.cuts], depth, rate))
        return model


def features(lexical: DataFrame, vector: DataFrame, fused: DataFrame, docs: DataFrame) -> DataFrame:
    """A row a candidate with what the ranker is fed: both channels, their fusion, and the document."""
    lex = lexical.select("query_id", "doc_id", F.col("score").alias("lexical_score"), F.col("rank").alias("lexical_rank"))
    vec = vector.select("query_id", "doc_id", F.col("score").alias("vector_score"), F.col("rank").alias("vector_rank"))
    words = F.size("w")
    about = docs.select("doc_id", F.length("content").alias("length"), F.filter(F.split("content", r"\s+"), lambda w: w != "").alias("w"), F.size("tags").alias("n_tags"))
    about = about.select("doc_id", "length", words.alias("words"), F.when(words > 0, F.size(F.array_distinct("w")) / words).otherwise(F.lit(0.0)).alias("distinct_share"), "n_tags")
    every = fused.select("query_id", "doc_id", F.col("score").alias("fused_score")).join(lex, ["query_id", "doc_id"], "left").join(vec, ["query_id", "doc_id"], "left")
    return every.join(about, "doc_id").fillna(0.0, ["lexical_score", "vector_score", "distinct_share"]).fillna(0, ["lexical_rank", "vector_rank"])


def rerank(candidates: DataFrame, model: Ranker, most: int = 200) -> DataFrame:
    """query_id, doc_id, score, rank by the model; ties by the fused score, then the id."""
    from tidewell.operators.search import ranked

    scored = candidates.select("query_id", "doc_id", "fused_score", model.score().alias("score"))
    return ranked(scored, most, F.desc("score"), F.desc("fused_score"), F.col("doc_id")).select("query_id", "doc_id", "score", "rank")


def ndcg(ranking: DataFrame, judged: DataFrame, k: int = 10) -> DataFrame:
    """query_id, ndcg over the judged hits of each query, in the ranking's order; queries without a good hit are left out."""
    from pyspark.sql import Window

    w = Window.partitionBy("query_id")
    hits = ranking.join(judged.select("query_id", "doc_id", "grade"), ["query_id", "doc_id"])
    placed = hits.withColumn("at", F.row_number().over(w.orderBy("rank"))).withColumn("best", F.row_number().over(w.orderBy(F.desc("grade"), "doc_id")))
    gain = lambda at: F.sum(F.when(F.col(at) <= k, (F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(F.col(at) + 1)))
    return placed.groupBy("query_id").agg(gain("at").alias("got"), gain("best").alias("ideal")).where("ideal > 0").select("query_id", F.round(F.coalesce(F.col("got"), F.lit(0.0)) / F.col("ideal"), 6).alias("ndcg"))
