"""Learned ranking: gradients by actually swapping, trees by trying every split, scores as expressions."""

import math

import numpy as np
import pytest
from compare import SF_DIR
from pyspark.sql import functions as F

from tidewell.operators import learned as L

UNIT = 2**L.UNIT_BITS


def dcg(grades):
    return sum((2**g - 1) / math.log2(i + 2) for i, g in enumerate(grades))


def test_gradients_are_swaps():
    rng = np.random.default_rng(1)
    score, grade, doc = rng.integers(0, 3, 9).astype(float), rng.integers(0, 3, 9).astype(float), rng.permutation(9)
    order = sorted(range(9), key=lambda i: (-score[i], doc[i]))
    ideal, g, h = dcg(sorted(grade, reverse=True)), np.zeros(9), np.zeros(9)
    for i in range(9):
        for j in range(9):
            if grade[i] > grade[j]:
                swapped = list(order)
                a, b = order.index(i), order.index(j)
                swapped[a], swapped[b] = j, i
                change = abs(dcg(grade[swapped]) - dcg(grade[order])) / ideal
                p = 1 / (1 + math.exp(score[i] - score[j]))
                g[i] += change * p
                g[j] -= change * p
                h[[i, j]] += change * p * (1 - p)
    got = L.gradients(score, grade, doc)
    assert got[0] / UNIT == pytest.approx(g, abs=1e-6) and got[1] / UNIT == pytest.approx(h, abs=1e-6)
    assert not L.gradients(score, np.zeros(9), doc)[0].any()


def plain_tree(rows, n, depth, rate=L.RATE, ridge=L.RIDGE, least=L.LEAST):
    """rows of (bins, g, h)."""
    value = lambda rs: (sum(r[1] for r in rs) / UNIT) ** 2 / (sum(r[2] for r in rs) / UNIT + ridge)
    best = None
    for f in range(n) if depth else ():
        for b in sorted({r[0][f] for r in rows}):
            left, right = [r for r in rows if r[0][f] <= b], [r for r in rows if r[0][f] > b]
            if len(left) >= least and len(right) >= least:
                gain = round(value(left) + value(right) - value(rows), 9)
                if gain > max(1e-9, best[0] if best else 0):
                    best = gain, f, b, left, right
    if best is None:
        return round(rate * sum(r[1] for r in rows) / UNIT / (sum(r[2] for r in rows) / UNIT + ridge), 6)
    return (best[1], best[2], *[plain_tree(side, n, depth - 1, rate, ridge, least) for side in best[3:]])


@pytest.mark.parametrize("depth", [0, 1, 3])
def test_growth_against_every_split(spark, depth):
    rng = np.random.default_rng(depth)
    bins = rng.integers(0, 6, size=(300, 4))
    g = ((bins[:, 0] > 2) * 2 - 1 + (bins[:, 2] % 2) * (bins[:, 1] > 3) + rng.normal(size=300)) * UNIT // 4
    rows = [([int(x) for x in b], int(y), int(UNIT // 5)) for b, y in zip(bins, g)]
    df = spark.createDataFrame([(*b, y, h) for b, y, h in rows], "b0 int, b1 int, b2 int, b3 int, g long, h long").repartition(3)
    got = L.grow(df, [f"b{k}" for k in range(4)], [6] * 4, depth)
    flat = lambda t: [round(t, 5)] if not isinstance(t, tuple) else [t[0], t[1], *flat(t[2]), *flat(t[3])]
    assert flat(got) == pytest.approx(flat(plain_tree(rows, 4, depth)), abs=1e-5)


def test_a_ranker_learns_what_orders_the_documents(spark):
    rng = np.random.default_rng(7)
    rows = [(q, d, float(x > 0.5), x, float(y), None) for q in range(12) for d, (x, y) in enumerate(rng.random((20, 2)).tolist())]
    df = spark.createDataFrame(rows, "query_id long, doc_id long, grade double, a double, b double, c double")
    model = L.train(df.where("query_id < 8"), ("a", "b", "c"), trees=5)
    assert model.trees[0][0] == 0 and model == L.train(df.where("query_id < 8").repartition(5), ("a", "b", "c"), trees=5)
    ranked = L.rerank(df.where("query_id >= 8").withColumn("fused_score", F.lit(0.0)), model)
    means = L.ndcg(ranked, df).agg(F.avg("ndcg")).first()[0]
    assert means > 0.98 and ranked.count() == 80
    # The expression gives each row the sum of its leaves.
    row = df.withColumn("s", model.score()).first()
    walk = lambda t: t if not isinstance(t, tuple) else walk(t[2] if sum(c < math.floor(row[("a", "b", "c")[t[0]]] * 1e4 + 0.5) / 1e4 for c in model.cuts[t[0]]) <= t[1] else t[3]) if row[("a", "b", "c")[t[0]]] is not None else walk(t[3])
    assert row.s == pytest.approx(sum(map(walk, model.trees)), abs=1e-6)


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, 1, None, 1.0), (1, 2, 1.0, 2.0), (1, 3, 1.0, None)], "query_id long, doc_id long, grade double, a double")
    assert L.train(df, ("a",), trees=2).trees == [0.0, 0.0]
    assert L.train(df.limit(0), ("a",), trees=1).trees == [0.0]
    assert L.rerank(df.withColumn("fused_score", F.lit(1.0)), L.train(df.limit(0), ("a",), trees=1)).count() == 3


def test_learned_order_beats_the_fused_one(spark):
    from tidewell.plans.catalogue import QUERIES

    got = {r.strategy: r.ndcg for r in QUERIES["learned_rank_eval"](spark, SF_DIR.replace("sf0.001", "sf0.1")).collect()}
    assert got["learned"] > got["rrf"] + 0.03
