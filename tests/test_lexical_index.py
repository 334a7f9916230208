"""The stored index against the search without one: pruning, updates, restarts, long requests, awkward rows."""

import random

import pytest
from pyspark.sql import functions as F

from tidewell.operators import search as S
from tidewell.sources import lexical_index as I

DDL = "doc_id long, tenant_id string, title string, content string, deleted boolean"


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(9)
    words = ["alpha", "beta", "gamma", "delta", "al", "alphabet", "be", "x1", "мир"]
    rows = [(i, f"t{i % 2}", rng.choice(words), " ".join(rng.choice(words[: rng.randint(1, 9)]) for _ in range(rng.choice([0, 1, 2, 3, 30, 200]))), i % 9 == 4) for i in range(400)]
    rows += [(900, "t0", "long", " ".join(f"w{i}" for i in range(700)), False), (901, "t1", None, None, False), (902, "t0", "", "", False), (903, "t0", "-", "alpha", None)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, DDL).withColumn("deleted_at", F.when(F.col("deleted"), F.lit("2024-01-02").cast("timestamp_ntz"))).withColumn("segment", F.lit("clash"))


@pytest.fixture(scope="module")
def asked(spark):
    texts = ["alpha", "beta gamma", "alphabet al", "x1", "", "мир alpha", "nothing here", "alpha beta gamma delta", "gamma gamma", " ".join(f"w{i}" for i in range(300)), None]
    return spark.createDataFrame([(2 * k + t, f"t{t}", q) for k, q in enumerate(texts) for t in (0, 1)], "query_id long, tenant_id string, query string")


def rows_of(df):
    return sorted(tuple(r) for r in df.select("query_id", "rank", "doc_id", "score", "title", "snippet").collect())


@pytest.mark.parametrize("k", [1, 5, 50])
def test_search_equals_the_one_without_an_index(spark, corpus, asked, tmp_path, monkeypatch, k):
    monkeypatch.setattr(I, "RANGE", 8)
    monkeypatch.setattr(I, "FIRST", 1)
    docs = frame(spark, corpus)
    index = I.LexicalIndex(spark, f"file://{tmp_path}/i")
    index.add(docs)
    want = rows_of(S.lexical_search(docs.drop("segment"), asked, k))
    assert rows_of(index.search(docs, asked, k)) == want and len(want) > 5 * min(k, 5)
    assert rows_of(I.LexicalIndex.open(spark, index.path).search(docs, asked, k)) == want


def test_bounds_leave_ranges_unread(spark, asked, tmp_path, monkeypatch):
    """One range has documents that repeat the word; the others can't reach the fifth best of it."""
    monkeypatch.setattr(I, "RANGE", 8)
    monkeypatch.setattr(I, "FIRST", 1)
    rows = [(i, "t0", "t", "alpha " * (50 if i < 8 else 1) + "filler words that differ " + " ".join(f"v{i}{j}" for j in range(60)), False) for i in range(80)]
    docs, read = frame(spark, rows), []
    index = I.LexicalIndex(spark, f"file://{tmp_path}/i")
    index.add(docs)
    plain = index._evaluated
    monkeypatch.setattr(index, "_evaluated", lambda blocks, ranges: (read.append(ranges.where("query_id = 0").count()), plain(blocks, ranges))[1])
    got = rows_of(index.search(docs, asked.where("query_id = 0"), 5))
    assert got == rows_of(S.lexical_search(docs.drop("segment"), asked.where("query_id = 0"), 5)) and [r[2] for r in got] == [0, 1, 2, 3, 4]
    assert read == [1, 0]


def test_updates_write_what_changed(spark, corpus, asked, tmp_path):
    before = [(i, "t1" if i % 17 == 0 else t, title, f"{c} more" if i % 5 == 0 else c, not d if i % 7 == 0 else d) for i, t, title, c, d in corpus if i % 11]
    index = I.LexicalIndex(spark, f"file://{tmp_path}/i")
    old, docs = frame(spark, before), frame(spark, corpus)
    index.add(old)
    assert index.update(old) is None and index.segments == 1
    want = rows_of(S.lexical_search(docs.drop("segment"), asked, 20))
    assert index.update(docs) == 1 and rows_of(index.search(docs, asked, 20)) == want
    assert index.update(docs) is None
    second = index._read("docs", I._DOCS).where("segment = 1").count()
    assert 0 < second < len(corpus) * 2 // 3
    gone = frame(spark, [(*r[:4], True) for r in corpus])
    assert index.update(gone) == 2 and index.search(gone, asked, 20).count() == 0
    assert index.update(docs) == 3 and rows_of(index.search(docs, asked, 20)) == want
    whole = index.compact(docs, f"file://{tmp_path}/j")
    assert whole.segments == 1 and rows_of(whole.search(docs, asked, 20)) == want


def test_an_empty_index(spark, asked, tmp_path):
    docs = frame(spark, [])
    index = I.LexicalIndex(spark, f"file://{tmp_path}/i")
    index.add(docs)
    assert index.search(docs, asked).collect() == [] and index.search(docs, asked.limit(0)).collect() == []
