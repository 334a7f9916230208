"""Ops 4, 7 and 9 against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from compare import same
from pyspark.sql import functions as F

from tidewell.llm import itq, ngram_join, queries, topk
from tidewell.llm.common import connected_components


def roots(n, links):
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components(spark):
    rng = random.Random(7)
    edges = [(i, i + 1) for i in range(0, 60)] + [(rng.randint(100, 400), rng.randint(100, 400)) for _ in range(250)] + [(500, k) for k in range(501, 560)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = roots(600, [e for e in edges if None not in e])
    assert got == {i: want[i] for e in edges if None not in e and e[0] != e[1] for i in e}


def plain_set(text, n):
    """Shingles as text, by the contract's words: nothing of the operator's."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def brute(rows, n, percent):
    sets, index, links = [plain_set(t, n) for _, t in rows], {}, []
    for i, s in enumerate(sets):
        shared = Counter(j for h in s for j in index.get(h, ()))
        links += [(i, j) for j, o in shared.items() if 100 * o >= percent * (len(s) + len(sets[j]) - o)]
        for h in s:
            index.setdefault(h, []).append(i)
    of = roots(len(rows), links)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[of[i]] = min(least.get(of[i], d), d)
    return {d: (len(sets[i]), least[of[i]]) for i, (d, _) in enumerate(rows)}


def test_shingles_are_told_apart_like_their_words():
    rng = random.Random(8)
    parts = [*"aAbBéÉ日😀\u2028\x1c\x85\xa0\u3000", " ", "\t", "\n", "\x0b", "\x0c", "\r", "  ", "ab", "ba", "aab", "x" * 70]
    texts = [None, "", " ", "a", "A\x0bb", "ab ba", "ba ab", "y" * 700000 + " z", "w " * 400000, *("".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(900))]
    for n in (1, 4):
        column = pa.array(texts, pa.string())
        got = list(ngram_join.shingle_sets(column, n))
        assert [s.tolist() for s in ngram_join.shingle_sets(column.slice(5, 40), n)] == [s.tolist() for s in got[5:45]]
        seen = {}
        for text, s in zip(texts, got):
            want = plain_set(text, n)
            assert len(s) == len(want) and (np.diff(s.astype(object)) > 0).all()
            if len(want) == 1:
                assert seen.setdefault(int(s[0]), next(iter(want))) == next(iter(want))
        alike = {}
        for text, s in zip(texts, got):
            assert alike.setdefault(s.tobytes(), plain_set(text, n)) == plain_set(text, n)


@pytest.mark.parametrize("n, percent", [(4, 85), (5, 80)])
def test_ngram_join(spark, n, percent):
    rng = random.Random(5)
    words, rows = [f"w{i}" for i in range(300)], []
    for _ in range(40):
        base = [rng.choice(words) for _ in range(rng.choice([3, 6, 7, 12, 40, 90, 200]))]
        for _ in range(rng.randint(1, 12)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                w[rng.randrange(len(w))] = rng.choice(words)
            rows.append((len(rows) * 3 + 1, " ".join(w + ["released", "under", "the", "mit", "license", "here"] * rng.randint(0, 1))))
    rows += [(10000, ""), (10001, None), (10002, " \n"), (10003, "A b"), (10004, "a B"), (10005, "a")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.components(spark.createDataFrame(rows, "doc_id long, text string"), n, percent).collect()}
    assert got == brute(rows, n, percent)


def test_trie_prunes_nothing_that_links():
    rng = np.random.default_rng(3)
    sets = [(i, np.unique(rng.integers(0, 60, rng.integers(1, 50)).astype(np.uint64))) for i in range(120)]
    trie = ngram_join.Trie(sets)
    for _, probe in sets:
        want = sorted(i for i, s in sets if 100 * len(np.intersect1d(s, probe)) >= 60 * len(np.union1d(s, probe)))
        assert sorted(trie.linked(probe, 60)) == want


def test_ngram_join_awkward(spark, awkward, nothing):
    got = {(r.doc_id, r.component_id) for r in ngram_join.components(awkward).collect()}
    assert (2, 1) in got and (3, 3) in got and (None, None) in got and ngram_join.components(nothing).count() == 0
    kept = ngram_join.keep_one(awkward)
    assert kept.columns == awkward.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3, 4, 5, 6, 7, 8]
    twice = spark.createDataFrame([(5, "a b c d e f g"), (3, "a b c d e f g"), (5, "p q r s t u v"), (9, "p q r s t u v")], "doc_id long, text string")
    assert {r.component_id for r in ngram_join.components(twice).collect()} == {3}


def test_keep_one_goes_by_text_where_ids_repeat_or_lack(spark):
    words = [f"w{i}" for i in range(400)]
    a, b, c, d, e = (" ".join(words[k : k + 60]) for k in (0, 70, 140, 210, 280))
    near = lambda text: text + " more"
    rows = [(5, a), (5, b), (5, near(a)), (7, near(b)), (7, c), (None, d), (None, near(d)), (None, near(c)), (2, e), (None, e), (9, ""), (9, ""), (9, " "), (None, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("clash"))
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    want = [(5, a), (5, b), (7, c), (None, d), (2, e), (9, ""), (9, " "), (None, None), (None, "")]
    for parts in (1, 3):
        got = [(r.doc_id, r.text) for r in ngram_join.keep_one(docs.repartition(parts)).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)


def near_vectors():
    rng = np.random.default_rng(1)
    rows = []
    for _ in range(60):
        base = rng.normal(size=64)
        for _ in range(int(rng.integers(1, 20))):
            rows.append((base + rng.normal(size=64) * rng.choice([0, 0.1, 0.25, 0.34]) * np.linalg.norm(base) / 8).tolist())
    return [(i, v, int(i % 7 == 0)) for i, v in enumerate(rows)]


def found_and_there(got, rows):
    x, labels = np.array([v for _, v, _ in rows]), np.array([g for _, _, g in rows])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T >= 0.93) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(near, False)
    found = np.array([got[i].n_links for i, _, _ in rows])
    assert (found <= near.sum(axis=1)).all()
    return found.sum() / near.sum()


def test_embedding_dedup_recall(spark):
    rows = near_vectors()
    odd = [(9001, None, 1), (9002, [0.0] * 64, 1), (9003, [float("nan")] * 64, 1), (9004, [None] + [1.0] * 63, 1), (9005, rows[0][1], None), (None, rows[0][1], 0)]
    other = [(9100 + i, (np.array(v[:40]) if i % 2 else np.array(v + v[:9])).tolist(), g) for i, (_, v, g) in enumerate(rows[:60])] + [(9300, [1.0, 2.0], 1), (9301, [2.0, 4.0], 1)]
    schema = "vec_id long, embedding array<double>, label int"
    got = {r.vec_id: r for r in itq.near_duplicates(spark.createDataFrame(rows + odd + other, schema).withColumn("rep", F.lit(1))).collect()}
    assert len(got) == len(rows + odd + other) and found_and_there(got, rows) >= 0.97  # vectors of other lengths change nothing
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in (9001, 9002, 9003, 9004, 9005))
    assert (got[9300].component_id, got[9301].component_id, got[9301].n_links) == (9300, 9300, 1)
    assert itq.near_duplicates(spark.createDataFrame([], schema)).count() == 0


@pytest.mark.parametrize("tables, flips", [itq.shape(n) for n in (10**5, 10**6, 10**8)])
def test_embedding_dedup_recall_with_longer_substrings(spark, tables, flips):
    """What many rows would make of the tables, on few."""
    rows = near_vectors()
    got = {r.vec_id: r for r in itq.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), tables=tables, flips=flips).collect()}
    assert found_and_there(got, rows) >= 0.9


def test_embedding_dedup_repeated_ids(spark):
    a, b = [1.0] * 64, [1.0] * 32 + [-1.0] * 32
    rows = [(7, a, 1), (9, a, 1), (9, b, 2), (8, b, 2), (8, b, 2), (5, b, 1)]
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in itq.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())
    assert got == [(5, 0, 5), (7, 1, 7), (8, 2, 8), (8, 2, 8), (9, 1, 7), (9, 2, 8)]


def test_topk_exact(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=16) * rng.choice([0.1, 1, 4])).round(1).tolist()) for i in range(700)] + [(700, [1.0] * 16), (720, [1.0] * 16), (740, [1.0] * 16)]
    odd = [(760, None), (780, [float("inf")] * 16), (800, [None] * 16), (None, [1.0] * 16), (820, [])]
    vectors = topk.integers(spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash")))
    got = {}
    for r in topk.top_k(vectors, 20, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    ids, v = np.array([i for i, _ in rows]), np.floor(64 * np.array([e for _, e in rows])).astype(int)
    assert set(got) == {i for i in ids.tolist() if i % 20 == 0}
    for q in got:
        s, others = v @ v[list(ids).index(q)], ids != q
        order = np.lexsort((ids[others], -s[others]))[:20]
        assert sorted(got[q]) == [(k + 1, int(ids[others][j]), int(s[others][j])) for k, j in enumerate(order)]
    assert topk.top_k(vectors.limit(0), 20, F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("sample", [5, 20_000])
def test_topk_of_several_lengths(spark, sample):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=9 if i % 50 == 7 else 8).round(1).tolist()) for i in range(150)] + [(160, [9.0] * 30), (180, [1.0] * 9)]
    vectors = topk.integers(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = {}
    for r in topk.top_k(vectors, 20, F.col("vec_id") % 20 == 0, sample).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    whole = {i: np.floor(64 * np.array(e)).astype(int) for i, e in rows}
    for q in (i for i in whole if i % 20 == 0):
        order = sorted((-int(v @ whole[q]), i) for i, v in whole.items() if i != q and len(v) == len(whole[q]))[:20]
        assert sorted(got.get(q, [])) == [(k + 1, i, -s) for k, (s, i) in enumerate(order)]


def test_oracles(spark, oracle):
    for name in ("op4_exact_topk", "op7_embedding_dedup"):
        same(queries.QUERIES[name](spark, "/root/testdata/sf0.001"), oracle.sql(queries.ORACLES[name]))
