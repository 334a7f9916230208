"""Cases that a reviewer found wrong."""

import pytest
from compare import SF_DIR
from pyspark.sql import functions as F

from tidewell.plans.catalogue import ORACLES, QUERIES
from tidewell.sources import tables as T

EVERY_MODEL = "rerank_candidates mock_rerank speculative_rerank cascade_gate personalize_scores diversity_score facet_tags ndcg_at_10 mrr_at_10 history_boost rank_features nightly_eval".split()


@pytest.mark.parametrize("name", EVERY_MODEL)
def test_vector_channel_has_every_model(name):
    assert "is_default" not in ORACLES[name]


def test_documents_of_the_other_model_are_found(spark):
    from tidewell.plans.search_queries import models

    active = T.points(spark, SF_DIR).join(models(spark, SF_DIR).where("is_active"), "model_name", "left_semi").select("doc_id")
    assert QUERIES["rank_features"](spark, SF_DIR).where("vector_rank > 0").join(active, "doc_id", "left_anti").count()


def test_vectors_round_as_their_sql(spark, oracle):
    from tidewell.functions import vectors

    values = [-1e-7, 1e-7, -0.0, 0.0, 0.1234565, -0.1234565, 2.5e-6, 4.9999999e-7, 1e300, float("nan")]
    got = spark.createDataFrame([(values,)], "v array<double>").select(vectors.rounded(F.col("v"))).first()[0]
    assert list(map(repr, got)) == [repr(oracle.sql(f"SELECT round(CAST('{v!r}' AS DOUBLE), 6)").fetchall()[0][0]) for v in values]


def test_profile_length_is_summed_in_order():
    import math

    import numpy as np

    from tidewell.operators.profiles import moved

    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = rng.normal(size=64), rng.normal(size=64)
        mixed, total = [(1 - 0.5) * x + 0.5 * y for x, y in zip(a.tolist(), b.tolist())], 0.0
        for x in mixed:
            total += x * x
        assert moved(a, 1, b, 0.5, 0.05, 10).tolist() == [x / math.sqrt(total) for x in mixed]


def test_mixed_match_meets_on_the_rarest_token(spark):
    from tidewell.operators import search

    docs = spark.createDataFrame([(d, f"common {'rare' if d == 3 else ''} i mir") for d in range(40)] + [(40, "common rare мир"), (41, None)], "doc_id long, content string")
    asked = spark.createDataFrame([(1, "common rare и"), (2, "absent и"), (3, "common"), (4, "rare мир"), (5, "mir и i")], "query_id long, query string")
    matched = search.mixed_match(docs, asked)
    assert "hashpartitioning(query_id" not in matched._jdf.queryExecution().executedPlan().toString()  # pairs aren't shuffled
    got = sorted(tuple(r) for r in matched.collect())
    assert got == [(1, 3), (4, 3), (4, 40)] + [(5, d) for d in range(40)]


def test_mixed_match_meets_in_cells_and_alike_requests_as_one(spark, monkeypatch):
    import random

    import pyarrow as pa

    from tidewell.operators import search

    for name, value in {"ALIKE": 2, "FORM_ROWS": 8, "MATCH_PAIRS": 1000, "DOC_BLOCK": 64, "FORM_BLOCK": 5, "OUT_ROWS": 7}.items():
        monkeypatch.setattr(search, name, value, raising=False)  # those after the third hold here, not in a worker
    rng, other = random.Random(5), {"i": "и", "mir": "мир", "da": "да"}
    words, back = [*other, *other.values(), "ж", "x1"], {c: a for a, c in other.items()} | {"ж": "zh"}
    texts = {d: [rng.choice(words) for _ in range(rng.randrange(9))] for d in range(150)}
    asked = {q: [rng.choice(words[:7]) for _ in range(rng.randrange(1, 5))] for q in range(90)}
    asked |= {q: ["da"] * (q % 3 + 1) + ["мир"] for q in range(90, 100)}
    forms = {}
    for q, tokens in asked.items():
        latin, cyrillic = [t for t in tokens if t in other], [t for t in tokens if t in back]
        if latin and cyrillic:
            forms[q] = [set(latin + cyrillic), {other[t] for t in latin} | set(cyrillic), set(latin) | {back[t] for t in cyrillic}]
    want = sorted((q, d) for q, f in forms.items() for d, t in texts.items() if any(x <= set(t) for x in f))
    docs = spark.createDataFrame([(d, " ".join(t)) for d, t in texts.items()] + [(None, "da мир")], "doc_id long, content string")
    matched = search.mixed_match(docs, spark.createDataFrame([(q, " ".join(t)) for q, t in asked.items()], "query_id long, query string"))
    # The partitions of pairs are counted by pairs and not put together by the bytes of the documents' tokens.
    assert "REPARTITION_BY_NUM" in matched._jdf.queryExecution().executedPlan().toString()
    got = [tuple(r) for r in matched.collect()]
    assert sorted(p for p in got if p[1] is not None) == want and {q for q, d in got if d is None} >= set(range(90, 100))
    cell, lists = search.Forms(), [sorted(map(sorted, f)) for f in forms.values()]
    for at in range(0, len(lists), 20):
        cell.ask(pa.array(lists[at : at + 20]), pa.array([[{"query_id": q}] for q in list(forms)[at : at + 20]]))
    pairs = list(cell.matches(pa.array(texts), pa.array([list(t) for t in texts.values()], pa.list_(pa.string()))))
    assert max(len(b) for b in pairs) == 7 and sorted((q, d) for b in pairs for q, d in zip(*(c.to_pylist() for c in b.columns))) == want


def test_exact_search_of_the_index(spark, tmp_path):
    import numpy as np

    from tidewell.operators import search
    from tidewell.sources.vector_index import VectorIndex

    rng = np.random.default_rng(7)
    rows = [(i, i // 2, "m0", rng.normal(size=8).tolist()) for i in range(600)]
    points = spark.createDataFrame(rows, "point_id long, doc_id long, model_name string, vector array<double>")
    asked = points.where("point_id % 20 = 0").select(F.col("point_id").alias("query_id"), F.col("vector").alias("query_vector"))
    index = VectorIndex(spark, str(tmp_path / "v"))
    index.build(points, 8, lists=24)
    key = lambda r: (r.query_id, r["rank"])
    want = sorted(search.vector_search(points, asked, k=10).collect(), key=key)
    got = sorted(index.search(asked, 10, probes=1, full_scan=0, exact=True).collect(), key=key)
    assert [(r.query_id, r["rank"], r.doc_id) for r in got] == [(r.query_id, r["rank"], r.doc_id) for r in want]


def test_every_score_of_odd_and_long_documents(spark):
    import numpy as np

    from tidewell.operators import search

    rng = np.random.default_rng(3)
    rows = [(d, rng.normal(size=3).tolist()) for d in range(50) for _ in range(1 + d % 3)] + [(60, rng.normal(size=3).tolist()) for _ in range(700)]
    rows += [(7, None), (70, None), (71, [1.0, None, 2.0]), (72, [0.0, 0.0, 0.0])]
    asked = [(q, rng.normal(size=3).tolist()) for q in range(5)] + [(9, None)]
    points, requests = spark.createDataFrame(rows, "doc_id long, vector array<double>"), spark.createDataFrame(asked, "query_id long, query_vector array<double>")
    cos = lambda a, b: float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b))) if any(a) else 0.0
    # A vector without a cosine counts as 0, as vectors.cosine has it.
    plain = lambda v: v if v is not None and None not in v else [0.0] * 3
    want = {(q, d): max((cos(plain(v), a) + 1) / 2 for e, v in rows if e == d) for q, a in asked[:5] for d in {d for d, _ in rows}}
    scored = search.every_score(points, requests)
    got = {(r.query_id, r.doc_id): r.score for r in scored.collect()}
    assert scored.count() == len(got) and got == pytest.approx(want, abs=2e-6)


def test_nfc_of_texts_that_stay_and_that_change(spark):
    import unicodedata

    from tidewell.functions import text

    assert all(unicodedata.is_normalized("NFC", chr(c)) for c in range(0x300))
    values = [None, "", "plain é", "é", "가", "Ω", "quote ’ é", "ạ̀"]
    rows = spark.createDataFrame(list(enumerate(values)), "i long, t string").select("i", text.nfc("t").alias("n")).orderBy("i").collect()
    assert [r.n for r in rows] == [None if t is None else unicodedata.normalize("NFC", t) for t in values]


def test_language_cuts_a_text_once(spark):
    from tidewell.functions import text

    df = spark.createDataFrame([("the cat and le chat",), (None,), ("",)], "t string").select(text.language(F.col("t")).alias("l")).select("l.language", "l.confidence")
    assert df._jdf.queryExecution().executedPlan().toString().count("regexp_extract_all") <= 2  # once in each expression of the plan
    assert [tuple(r) for r in df.collect()] == [("en", 0.0), ("en", 0.0), ("en", 0.0)]


def test_language_sums_in_slices(spark):
    import numpy as np

    from tidewell.operators import language

    model = language.LanguageModel(["a", "b"], {"_x_": 0, "_y_": 1}, np.array([[-1.0, -2.0], [-3.0, -4.0]]))
    texts = [None, "", "x", "x " * 300_000, "y z", "", "y " * 150_000]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string").coalesce(1).select("i", model.sums(F.col("t")).alias("s")).orderBy("i").collect()
    assert [r.s for r in rows] == [[0.0] * 3] * 2 + [[-1.0, -2.0, 1.0], [-3e5, -6e5, 3e5], [-3.0, -4.0, 1.0], [0.0] * 3, [-4.5e5, -6e5, 1.5e5]]


def test_the_index_is_built_without_a_shuffle_and_evaluated_by_range(spark, tmp_path, monkeypatch):
    from pyspark.sql.readwriter import DataFrameWriter

    from tidewell.operators import search
    from tidewell.sources.lexical_index import LexicalIndex

    plan, plans, plain = lambda df: df._jdf.queryExecution().executedPlan().toString(), [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, *a, **k: (plans.append(plan(self._df)), plain(self, *a, **k))[1])
    rows = [(d, f"t{d % 3}", "title", f"common {'rare ' * (d % 4)}w{d % 50}", None) for d in range(5000)]
    docs = spark.createDataFrame(rows, "doc_id long, tenant_id string, title string, content string, deleted_at timestamp_ntz")
    index = LexicalIndex(spark, f"file://{tmp_path}/i")
    index.add(docs)
    assert len(plans) == 3 and not any("hashpartitioning" in p for p in plans)
    asked = spark.createDataFrame([(q, f"t{q % 3}", text) for q in range(6) for text in ("common rare",)], "query_id long, tenant_id string, query string")
    evaluated, seen = index._evaluated, []
    monkeypatch.setattr(index, "_evaluated", lambda *a: (seen.append(evaluated(*a)), seen[-1])[1])
    key = lambda df: sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in df.collect())
    assert key(index.search(docs, asked)) == key(search.lexical_search(docs, asked))
    assert len(seen) == 2 and not any("hashpartitioning(query_id" in plan(df) and "doc_id" in plan(df).split("hashpartitioning(query_id")[1][:60] for df in seen)  # pairs aren't shuffled
    index.update(docs.where("doc_id % 2 = 0").withColumn("content", F.concat("content", F.lit(" rare"))).unionByName(docs.where("doc_id % 2 = 1")))
    assert index._replaced().select(F.sum(F.size("ids"))).first()[0] == 2500


def test_the_index_cuts_trigrams_once_and_reads_its_tokens_once(spark, tmp_path, monkeypatch):
    from pyspark.sql.readwriter import DataFrameWriter

    from tidewell.functions import text
    from tidewell.sources.lexical_index import LexicalIndex

    plans, plain = [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, *a, **k: (plans.append((path, self._df._jdf.queryExecution().executedPlan().toString())), plain(self, path, *a, **k))[1])
    rows = [(d, "t", "a title", f"common w{d % 50}" + " word" * (d % 3) * 300, None) for d in range(200)]
    index = LexicalIndex(spark, f"file://{tmp_path}/i")
    index.add(spark.createDataFrame(rows, "doc_id long, tenant_id string, title string, content string, deleted_at timestamp_ntz"))
    # Of the beginning and of the whole, not once more for a filter or a size.
    assert [p.count("regexp_extract_all(lower") for path, p in plans if "/trigrams/" in path] == [2]
    blocks = index._blocks(spark.createDataFrame([(1, "t", 1, "common")], "query_id long, tenant_id string, n int, token string")).blocks
    assert not any("/tokens/segment" in f for f in blocks.inputFiles()) and blocks.select(F.sum(F.size("postings"))).first()[0] == 200
    values = [None, "", " - ", "a", "мир мир-x1", "\n ab\tÀÿ 😀é😀 \n"]
    pieces = lambda t: list(dict.fromkeys(f"  {w} "[i : i + 3] for w in t for i in range(len(w) + 1)))
    words = [None, [], [], ["a"], ["мир", "мир", "x1"], ["ab", "àÿ", "é"]]
    got = spark.createDataFrame(list(enumerate(values)), "i long, t string").select("i", text.trigrams(F.col("t")).alias("d")).orderBy("i").collect()
    assert [r.d for r in got] == [None if w is None else pieces(w) for w in words]


def test_a_consumer_takes_many_batches_a_trigger(spark, tmp_path):
    from tidewell.streaming import stateful

    at, numbers = f"file://{tmp_path}", []
    stateful.publish(spark.range(0, 200).coalesce(1), f"{at}/in", 5)
    put = stateful.by_batch(f"{at}/out")
    stateful.consume(spark, "id long", f"{at}/in", lambda rows, n: (numbers.append(n), put(rows, n))[1], f"{at}/state", files=16, name="file").awaitTermination()
    assert numbers == [0, 1, 2]
    done = spark.read.parquet(f"{at}/out")
    assert sorted(r.id for r in done.collect()) == list(range(200)) and {r["count"] for r in done.groupBy("batch", "file").count().collect()} == {5}


def test_a_key_costs_few_calls_to_its_state():
    from pyspark.sql import Row

    from tidewell.streaming.stateful import Sessions

    calls = []

    class Fake:
        value = None

        def getValueState(self, name, schema):
            return self

        def get(self):
            return calls.append("get") or self.value

        def update(self, value):
            calls.append("update")
            self.value = value

        def registerTimer(self, at):
            calls.append(("register", at))

        def deleteTimer(self, at):
            calls.append(("delete", at))

    sessions = Sessions(1000)
    sessions.init(Fake())
    assert list(sessions.handleInputRows((1,), iter([Row(micros=20, event_id=2), Row(micros=10, event_id=1)]), None)) == []
    assert calls == ["get", "update", ("register", 2)]
    calls.clear()
    assert [tuple(r) for r in sessions.handleInputRows((1,), iter([Row(micros=5000, event_id=3)]), None)] == [(1, 10, 20, 2)]
    assert calls == ["get", "update", ("delete", 2), ("register", 6)]


def test_a_merge_shuffles_texts_once_and_writes_none_aside(spark, tmp_path, monkeypatch):
    from tidewell.sources import store as D

    aside, documents, stored, replace = [], [], D.Scratch.stored, D.DocumentStore._replace
    monkeypatch.setattr(D.Scratch, "stored", lambda self, df: (aside.append(df.columns), stored(self, df))[1])
    monkeypatch.setattr(D.DocumentStore, "_replace", lambda self, df, name, by: (name == "documents" and documents.append(df._jdf.queryExecution().executedPlan().toString()), replace(self, df, name, by)))
    ddl = "tenant_id string, external_ref string, title string, content string, attributes string, updated_at timestamp_ntz, deleted_at timestamp_ntz"
    rows = spark.createDataFrame([("a", str(i), "t", f"text {i}", "{}", None, None) for i in range(40)], ddl)
    target = D.DocumentStore(spark, f"file://{tmp_path}/s", 3)
    assert target.upsert(rows, "l1") == {"inserted": 40}
    odd = rows.withColumn("content", F.when(F.col("external_ref") % 2 == 1, F.lit("new")).otherwise(F.col("content")))
    assert target.upsert(odd.unionByName(odd), "l2") == {"updated": 20, "no_change": 20} and target.upsert(odd, "l2") == {"no_change": 40}
    assert aside and not any("content" in columns for columns in aside)
    assert len(documents) == 2 and all(p.count("Exchange") == 1 for p in documents)
    assert sorted((r.external_ref, r.content) for r in target.documents().collect()) == sorted((r.external_ref, r.content) for r in odd.collect())


def test_token_matches_shuffles_no_pairs(spark):
    import re

    from tidewell.operators import search

    rows = [(d, "t", f"common {'rare ' * (d % 3)}word") for d in range(30)] + [(99, "u", "common rare"), (100, "t", None)]
    docs = spark.createDataFrame(rows, "doc_id long, tenant_id string, content string")
    asked = spark.createDataFrame([(1, "t", "common rare"), (2, "t", "common absent"), (3, "t", ""), (4, None, "rare"), (5, "t", None), (6, "u", "rare rare")], "query_id long, tenant_id string, query string")
    matched = search.token_matches(docs, asked)
    assert not re.search(r"hashpartitioning\(query_id#\d+L?, doc_id", matched._jdf.queryExecution().executedPlan().toString())
    assert sorted(map(tuple, matched.collect())) == sorted([(1, d, round((0.5 + k / (k + 1)) / 2, 6)) for d in range(30) for k in (d % 3,) if k] + [(6, 99, 0.5)])


def test_lexical_search_cuts_pairs_before_they_are_shuffled(spark):
    import random

    from tidewell.operators import search

    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "al", "be"]
    rows = [(d, f"t{d % 3}", rng.choice(words), " ".join(rng.choices(words, k=rng.randrange(1, 9))), None) for d in range(300)] + [(300, None, "a", "alpha", None), (301, "t0", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, tenant_id string, title string, content string, deleted_at timestamp_ntz")
    asked = spark.createDataFrame([(q, f"t{q % 2}", " ".join(rng.choices(words, k=1 + q % 2))) for q in range(20)] + [(20, None, "alpha"), (21, "t0", None), (22, "t0", "")], "query_id long, tenant_id string, query string")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    similar = search.trigram_scores(docs, asked)
    assert "hashpartitioning(query_id" not in plan(similar)
    got = search.lexical_search(docs, asked, 4)
    assert any("WindowGroupLimit" in line and "alone" in line and "Partial" in line for line in plan(got).split("\n"))
    sets = lambda t: {f"  {w} "[i : i + 3] for w in t.split() for i in range(len(w) + 1)}
    want = []
    for q in asked.collect():
        found = {}
        for d, tenant, title, content, _ in rows:
            if q.query and tenant and tenant == q.tenant_id and content:
                tokens, have, a, b = list(dict.fromkeys(q.query.split())), content.split(), sets(q.query), sets(f"{title} {content}")
                rank = round(sum(have.count(t) / (have.count(t) + 1) for t in tokens) / len(tokens), 6) if all(t in have for t in tokens) else None
                near = round(len(a & b) / len(a | b), 6)
                if rank is not None or near > 0.3:
                    found[d] = round(0.7 * (rank or 0) + 0.3 * (near if near > 0.3 else 0), 6)
        want += [(q.query_id, d, s) for d, s in sorted(found.items(), key=lambda x: (-x[1], x[0]))[:4]]
    flat = lambda rows: [x for row in sorted(rows) for x in row]
    assert flat((r.query_id, r.doc_id, r.score) for r in got.collect()) == pytest.approx(flat(want), abs=2e-6)  # a half rounds otherwise in Python


def test_the_join_writes_no_plan_of_many_shuffles(spark, monkeypatch):
    from pyspark.sql.readwriter import DataFrameWriter

    from tidewell.llm import ngram_join

    plans, plain = [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, *a, **k: (plans.append(self._df._jdf.queryExecution().executedPlan().toString().count("Exchange ")), plain(self, *a, **k))[1])
    texts = [" ".join(f"w{(d // 2 * 7 + k) % 90}" for k in range(12 + d // 2 % 3)) + (" end" if d % 2 else "") for d in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.components(docs, 2, 80).collect()}
    assert all(got[d] == got[d - 1] for d in range(1, 60, 2))
    assert plans and max(plans) <= 8, plans


def test_stars_take_no_round_and_chains_end_with_their_last(spark, monkeypatch):
    from tidewell.llm import common

    written, plain = [], common.materialize
    monkeypatch.setattr(common, "materialize", lambda df, name: (written.append(name), plain(df, name))[1])
    label = lambda edges: {r.node: r.component for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert label([(1, k) for k in range(2, 30)] + [(40, 41), (41, 40), (41, 41)]) == {k: 1 for k in range(1, 30)} | {40: 40, 41: 40}
    assert written == ["edges"]
    written.clear()
    assert label([(1, 3), (2, 3), (5, 6)]) == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5}
    assert written == ["edges", "stars", "edges"]
