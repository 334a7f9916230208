"""Hand-computed cases: formulas, ties, nulls, empty inputs."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.functions import stats, text, vectors
from tidewell.operators import evaluation, events, indexing, profiles, search, service
from tidewell.streaming import jobs


def hits(spark, rows):
    return spark.createDataFrame(rows, "query_id long, doc_id long, score double, rank int")


def test_rrf(spark):
    lex, vec = hits(spark, [(1, 10, 5.0, 1), (1, 11, 4.0, 2)]), hits(spark, [(1, 10, 0.9, 1)])
    got = {r.doc_id: (r.score, r.rank) for r in search.rrf(lex, vec).collect()}
    assert got[10] == (pytest.approx(2 / 61, abs=1e-8), 1) and got[11] == (pytest.approx(1 / 62, abs=1e-8), 2)
    assert search.rrf(lex, vec, k=1).where("doc_id = 10").first().score == 1.0


@pytest.mark.parametrize("lex, vec, alpha, want", [
    ([(1, 1, 3.0, 1)], [(1, 1, 0.2, 1)], 0.5, {1: 1.0}),
    ([(1, 1, 3.0, 1)], [], 0.5, {1: 0.5}),
    ([(1, 1, 5.0, 1), (1, 2, 5.0, 2)], [(1, 3, 5.0, 1), (1, 4, 5.0, 2)], 0.5, {1: 0.0, 2: 0.0, 3: 0.0, 4: 0.0}),
    ([(1, 1, 20.0, 1), (1, 2, 10.0, 2)], [], 1.0, {1: 1.0, 2: 0.0}),
])
def test_weighted(spark, lex, vec, alpha, want):
    assert {r.doc_id: r.score for r in search.weighted(hits(spark, lex), hits(spark, vec), alpha).collect()} == want


@pytest.mark.parametrize("count, query, want", [(1000, "hi", (50, 20)), (2_000_000, "x" * 36, (90, 120)), (None, "hi", (70, 40))])
def test_adaptive_k(spark, count, query, want):
    lexical, vector = stats.adaptive_k(F.col("n"), F.col("q"))
    assert tuple(spark.createDataFrame([(count, query)], "n long, q string").select(lexical, vector).first()) == want


def test_mmr_and_diversity(spark):
    v = np.array([[1, 0, 0], [0.9, 0.1, 0], [0, 1, 0], [0, 0.9, 0.1], [0, 0, 1]])
    scores = np.array([0.9, 0.8, 0.7, 0.6, 0.5])
    assert search.mmr_order(scores, v, 1.0, 5) == [0, 1, 2, 3, 4]
    assert search.mmr_order(scores, v, 0.5, 3)[:2] == [0, 2]
    assert search.diversity(v[:1]) == 1.0 and search.diversity(v[:0]) == 0.0 and search.diversity(v[[0, 2]]) > 0.9
    docs = spark.createDataFrame([(i, v[i].tolist()) for i in range(4)], "doc_id long, vector array<double>")
    out = search.mmr(hits(spark, [(1, i, float(scores[i]), i + 1) for i in range(5)] + [(2, 99, 0.1, 1)]), docs).collect()
    assert sorted(r.doc_id for r in out if r.query_id == 1) == [0, 1, 2, 3] and [r.doc_id for r in out if r.query_id == 2] == [99]


def test_significance(spark):
    rows = spark.createDataFrame([("A", 120, 60), ("B", 120, 6)], "variant string, searches long, clicks long")
    r = events.significance(rows, ["A", "B"]).first()
    assert r.winner == "A" and r.significant and r.enough_samples and r.p_value < 1e-6
    r = events.significance(spark.createDataFrame([("A", 3, 1)], rows.schema), ["A", "B"]).first()
    assert not r.enough_samples and not r.significant


def test_strategy_words():
    assert events.parse_strategy("weighted+rerank+alpha:0.3") == {"fusion": "weighted", "rerank": True, "fusion_alpha": 0.3}
    with pytest.raises(ValueError):
        events.parse_strategy("weighted+magic")
    assert events.overlay({"user_id": 1, "fusion": "rrf"}, {"fusion": "weighted", "top_k": 5}) == {"user_id": 1, "fusion": "weighted"}
    assert events.overlay({"fusion": "rrf"}, {"fusion": "weighted"}) == {"fusion": "rrf"}


def test_pushdown():
    d = search.pushdown_decision
    assert [d(10000, 500), d(10000, 3000), d(1000000, 5001), d(10000, 0)] == ["used", "not_selective", "too_large", "used"]
    assert d(10, 1, enabled=False) == "disabled" and d(10, 1, has_filters=False) == "no_filters"
    assert search.pushdown_cap(100) == 10000 and search.pushdown_cap(50) == 5000


def test_digest_merge_and_errors(spark):
    kinds = spark.createDataFrame([("Qdrant down",), ("timeout",), ("model missing",), ("payload bad",), ("x",), (None,)], "e string").select(indexing.error_type(F.col("e")).alias("t"))
    assert [r.t for r in kinds.collect()] == ["qdrant_unavailable", "qdrant_unavailable", "embedding_failed", "payload_invalid", "other", "other"]


def test_chunk_windows_and_point_ids(spark):
    import uuid

    docs = spark.createDataFrame([(1, "t", " ".join(f"w{i}" for i in range(512)), "{}"), (2, "t", "a b", '{"abstract": "s"}'), (3, "t", "", "{}")], "doc_id long, title string, content string, attributes string")
    plan = {r.doc_id: (r.strategy, r.n_chunks, r.weights) for r in indexing.chunk_plan(docs).collect()}
    assert plan == {1: ("multi", 2, None), 2: ("weighted", 1, "3.0,2.0,1.0"), 3: ("single", 1, None)}
    texts = [r.text.split() for r in indexing.chunk_windows(docs).orderBy("chunk_idx").collect()]
    assert [len(t) for t in texts] == [512, 50] and texts[1][0] == "w462"
    ids = spark.createDataFrame([("abc", 0), ("abc", 3)], "d string, c int").select(indexing.point_id(F.col("d"), F.col("c")).alias("i"))
    assert [r.i for r in ids.collect()] == ["abc", str(uuid.uuid5(uuid.NAMESPACE_URL, "abc:3"))]


def test_vectors(spark):
    row = spark.createDataFrame([([0.6, 0.8], [0.8, 0.6], [0.0, 0.0])], "a array<double>, b array<double>, z array<double>")
    mean = row.select(vectors.weighted_mean(F.array("a", "b"), F.array(F.lit(3.0), F.lit(1.0))).alias("m")).first().m
    want = (3 * np.array([0.6, 0.8]) + np.array([0.8, 0.6])) / 4
    assert mean == pytest.approx((want / np.linalg.norm(want)).tolist())
    assert row.select(vectors.cosine(F.col("a"), F.col("z")).alias("c")).first().c == 0.0


def test_relevance(spark):
    judged = spark.createDataFrame([(1, d) for d in (1, 2, 3, 4)], "query_id long, doc_id long")
    got = hits(spark, [(1, 1, 0.0, 1), (1, 2, 0.0, 2), (1, 3, 0.0, 3), (1, 4, 0.0, 11)])
    r = evaluation.relevance(got, judged).first()
    assert r.recall == 0.75 and r.mrr == 1.0 and evaluation.relevance(hits(spark, []), judged).first().ndcg == 0.0


def test_filters_with_bad_values(spark):
    docs = spark.createDataFrame([(1, "AI", '{"category":"AI","price":99}'), (2, "AI", '{"category":"AI","price":1500}'), (3, "F", '{"category":"F","price":"much"}'), (4, "F", None), (5, "F", "not json")], "doc_id long, tenant_id string, attributes string")
    assert [r.doc_id for r in search.matching(docs, price_min=100, price_max=5000).collect()] == [2]
    assert sorted(r.doc_id for r in search.matching(docs, category="AI").collect()) == [1, 2]


def test_scripts_and_transliteration(spark):
    words = ["iphone15", "15", "@home", "привет", "helloпривет", "приветhello"]
    got = [r.s for r in spark.createDataFrame([(w,) for w in words], "w string").select(text.script(F.col("w")).alias("s")).collect()]
    assert got == ["latin", "neutral", "neutral", "cyrillic", "latin", "neutral"]
    row = spark.createDataFrame([("щука", "shchuka")], "c string, l string").select(text.to_latin(F.col("c")).alias("l"), text.to_cyrillic(F.col("l")).alias("c")).first()
    assert (row.l, row.c) == ("shchuka", "щука")
    docs = spark.createDataFrame([(1, "kniga Smith"), (2, "книга smith"), (3, "книга")], "doc_id long, content string")
    asked = spark.createDataFrame([(7, "книга smith")], "query_id long, query string")
    assert sorted(r.doc_id for r in search.mixed_match(docs, asked).collect()) == [1, 2]


def test_profiles():
    first = profiles.moved(None, 0, [1.0, 0.0], 0.5, 0.05, 10)
    assert first.tolist() == [1.0, 0.0] and profiles.moved(first, 1, [0.0, 1.0], 0.5, 0.05, 10).tolist() == pytest.approx([2**-0.5, 2**-0.5])
    assert profiles.moved(first, 10, [0.0, 1.0], 0.5, 0.05, 10).tolist() == pytest.approx((np.array([0.95, 0.05]) / np.hypot(0.95, 0.05)).tolist())


def test_breaker_states():
    rows = [(i * 1000, i % 2 == 0, 10.0) for i in range(6)] + [(70_000, True, 10.0), (71_000, True, 10.0)]
    states = [s for _, s in jobs.breaker_steps(rows)]
    assert states[4] == "open" and states[-2:] == ["closed", "closed"]


def test_gate(spark):
    runs = spark.createDataFrame([("d", "s", 1, 0.5, 0.5), ("d", "s", 2, 0.48, 0.49), ("d", "s", 3, 0.459, 0.49)], "dataset string, strategy string, run_at int, recall double, ndcg double")
    assert [r.regression for r in evaluation.gate(runs).orderBy("run_at").collect()] == [False, False, True]


def test_vector_search_against_plain_products(spark):
    rng = np.random.default_rng(3)
    points = [(i, i // 3, rng.integers(-2, 3, size=6 if i % 11 else 4).astype(float).tolist()) for i in range(400)] + [(900, 300, [0.0] * 6), (901, 301, [float("nan")] * 6), (902, 302, None)]
    asked = [(q, rng.integers(-2, 3, size=6).astype(float).tolist()) for q in range(7)] + [(7, [1.0, 0.0, 1.0, 2.0]), (8, None), (9, [0.0] * 6)]
    got = {}
    frame = spark.createDataFrame(points, "point_id long, doc_id long, vector array<double>")
    for r in search.vector_search(frame, spark.createDataFrame(asked, "query_id long, query_vector array<double>"), k=15).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.doc_id, r.score))
    for q, v in asked:
        best = {}
        for _, doc, p in points:
            if v is not None and p is not None and len(p) == len(v) and np.isfinite(p).all():
                lengths = np.linalg.norm(v) * np.linalg.norm(p)
                best[doc] = max(best.get(doc, -2), float(np.dot(v, p) / lengths) if lengths else 0.0)
        want = sorted((-round((c + 1) / 2, 6), d) for d, c in best.items())[:15]
        assert sorted(got.get(q, [])) == [(k + 1, d, -s) for k, (s, d) in enumerate(want)]


def test_trigram_scores_against_plain_sets(spark):
    import random
    import re

    rng = random.Random(2)
    tri = lambda text: {f"  {w} "[i : i + 3] for w in re.findall(text_token, text.lower()) for i in range(len(w) + 1)}
    text_token = "[a-z0-9]+"
    words = ["alpha", "beta", "gamma", "al", "a", "alphabet", "be", "x1"]
    docs = [(i, "t", rng.choice(words), " ".join(rng.choice(words[: rng.randint(1, 8)]) for _ in range(rng.choice([0, 1, 2, 3, 5, 400])))) for i in range(200)] + [(500, "t", "zz", " ".join(f"w{i}" for i in range(500)))]
    asked = [(q, "t", " ".join(rng.choice(words) for _ in range(rng.randint(1, 3)))) for q in range(20)]
    frame = spark.createDataFrame(docs, "doc_id long, tenant_id string, title string, content string")
    rows = search.trigram_scores(frame, spark.createDataFrame(asked, "query_id long, tenant_id string, query string")).collect()
    want = {}
    for q, _, query in asked:
        for d, _, title, content in docs:
            a, b = tri(query), tri(f"{title} {content}")
            if round(len(a & b) / len(a | b), 6) > 0.3 and min(len(a), len(b)) > 0.3 * max(len(a), len(b)):
                want[q, d] = round(len(a & b) / len(a | b), 6)
    assert want and {(r.query_id, r.doc_id): r.similarity for r in rows} == want


def test_strategies_over_a_table(spark):
    rows = spark.createDataFrame([(1, 5, "weighted+rerank+alpha:0.3"), (2, None, "weighted"), (3, 5, "")], "query_id long, user_id long, strategy string").select("*", F.lit("rrf").alias("fusion"), F.lit(0.5).alias("fusion_alpha"), *[F.lit(False).alias(c) for c in ("rerank", "personalize", "diversify")])
    got = [(r.fusion, r.fusion_alpha, r.rerank) for r in events.overlaid(rows).orderBy("query_id").collect()]
    assert got == [("weighted", 0.3, True), ("rrf", 0.5, False), ("rrf", 0.5, False)]
    with pytest.raises(Exception, match="unknown strategy word"):
        events.overlaid(rows.withColumn("strategy", F.lit("weighted+magic"))).collect()


def test_bad_judgment_lines_fail(spark, tmp_path):
    (tmp_path / "j.json").write_text('{"query_id": "1", "query": "a"}\n\n{"query_id": 2, broken\n')
    with pytest.raises(Exception):
        evaluation.load_judgments(spark, f"file://{tmp_path}/j.json").collect()


def test_embedding_through_caches(spark):
    now = "2024-01-01 00:00:00"
    key = lambda rows, ddl: spark.createDataFrame(rows, ddl).withColumn("expires_at", F.col("expires_at").cast("timestamp_ntz"))
    wanted = spark.createDataFrame([("a", "x y"), ("a", "x y"), ("b", "x"), ("c", "z"), ("d", "..."), ("e", "old")], "key string, text string")
    cache = key([("b", [9.0], "2024-01-02"), ("e", [9.0], "2023-01-01")], "key string, vector array<double>, expires_at string")
    failed = key([("c", "2024-01-02")], "key string, expires_at string")
    rows = service.embed_cached(wanted, cache, failed, now)
    assert {r.key: r.outcome for r in rows.collect()} == {"a": "computed", "b": "hit", "c": "negative", "d": "failed", "e": "computed"}
    assert rows.where("key = 'b'").first().vector == [9.0] and rows.where("key = 'd'").first().vector is None
    kept, negative = service.cache_rows(rows, now)
    assert {r.key: str(r.expires_at) for r in kept.collect()} == dict.fromkeys("ae", "2024-01-31 00:00:00")
    assert 50 <= (negative.first().expires_at - datetime.datetime(2024, 1, 1)).seconds <= 70
    with pytest.raises(Exception, match="fewer vectors"):
        service.embed_texts(wanted, lambda c: F.lit(None).cast("array<double>")).collect()


def test_streamed_profiles_are_those_of_the_batch(spark):
    from compare import SF_DIR

    from tidewell.plans.catalogue import QUERIES

    rows = [{r.user_id: (tuple(r.vector), r.click_count) for r in QUERIES[name](spark, SF_DIR).collect()} for name in ("ema_profiles", "stream_profiles")]
    assert rows[0] == rows[1] and rows[0]


def test_migration_names(spark):
    rows = [("d", "promoted", "d_new"), ("d", "cleaned", "d_v2"), ("e", "init", "e_new"), ("f", "rolled_back", "f_v2")]
    got = {r.base: (r.accepted, r.collection) for r in service.begin(spark.createDataFrame(rows, "base string, status string, collection string")).collect()}
    assert got == {"d": (True, "d_v3"), "e": (False, None), "f": (True, "f_new")}
