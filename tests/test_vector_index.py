"""The stored vector index: recall against the exact search, filters, added points, awkward rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.operators import search as S
from tidewell.sources import vector_index as I

DDL = "point_id long, doc_id long, model_name string, vector array<float>, list string"


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(11)
    centers = rng.normal(size=(12, 16)) * 3
    v = (centers[rng.integers(0, 12, 1500)] + rng.normal(size=(1500, 16))).astype(np.float32)
    v[700:1200] = v[700]  # a third of all points are copies of one
    rows = [(i, i // 2, f"m{i % 2}", x.tolist(), "clash") for i, x in enumerate(v)]
    rows += [(5000, 2500, "m0", None, ""), (5001, 2501, "m0", [0.0] * 16, ""), (5002, 2502, "m0", [float("nan")] * 16, ""), (5003, 2503, "m1", [1.0] * 5, ""), (5004, 2504, "m1", [], "")]
    asked = [(i, rng.normal(size=16).tolist() if i % 3 == 0 else (centers[i % 12] + rng.normal(size=16)).tolist()) for i in range(24)] + [(90, None), (91, [0.0] * 16), (92, [1.0] * 3)]
    return spark.createDataFrame(rows, DDL), spark.createDataFrame(asked, "query_id long, query_vector array<double>")


@pytest.fixture(scope="module")
def index(spark, clustered, tmp_path_factory):
    index = I.VectorIndex(spark, f"file://{tmp_path_factory.mktemp('v')}/i")
    index.build(clustered[0].where("point_id < 1400 or point_id >= 5000"), 16)
    index.add(clustered[0].where("point_id between 1400 and 1499"), 16)
    return index


def test_every_usable_point_is_in_the_list_of_its_nearest_center(index):
    rows = index.points().collect()
    assert sorted(r.point_id for r in rows) == list(range(1500))
    centers, v = index.centers(), I._units(np.array([r.vector for r in rows]))
    assert np.allclose((v @ centers.T).max(axis=1), (v * centers[[r.list for r in rows]]).sum(axis=1), atol=1e-6)
    codes = I._units(np.array([np.frombuffer(r.code, np.int8) for r in rows], np.float32))
    assert (codes * v).sum(axis=1).min() > 0.999


def test_recall_and_exact_scores(index, clustered, monkeypatch):
    points, asked = clustered
    usable = points.where("point_id < 5000")
    exact, got = S.vector_search(usable, asked.where("query_id < 90"), k=10), index.search(asked, k=10, full_scan=0)
    assert I.recall(got, exact).agg(F.avg("recall")).first()[0] >= 0.95
    scores = {(r.query_id, r.doc_id): r.score for r in S.vector_search(usable, asked, k=200).collect()}
    rows = got.collect()
    assert {r.query_id for r in rows} == set(range(24)) and all(abs(scores.get((r.query_id, r.doc_id), r.score) - r.score) < 1e-5 for r in rows)
    # Large lists are dealt to several cells, with the same result.
    monkeypatch.setattr(I, "CELL_ROWS", 40)
    assert sorted(map(tuple, index.search(asked, k=10, full_scan=0).collect())) == sorted(map(tuple, rows))


def test_all_lists_probed_are_exact_up_to_codes(index, clustered):
    points, asked = clustered
    exact = S.vector_search(points.where("point_id < 5000"), asked.where("query_id < 90"), k=5)
    assert I.recall(index.search(asked, k=5, probes=10_000, full_scan=0), exact).agg(F.avg("recall")).first()[0] >= 0.98


def test_filters_and_the_small_case(spark, index, clustered):
    points, asked = clustered
    models = spark.createDataFrame([("m0", True), ("m1", False)], "model_name string, is_active boolean")
    docs = spark.range(0, 750).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 1, F.lit("2024-01-01").cast("timestamp_ntz")).alias("deleted_at"))
    got = index.search(asked, k=10, docs=docs, models=models, full_scan=0, probes=10_000).collect()
    assert got and all(r.doc_id % 2 == 0 for r in got)
    exact = S.vector_search(index.points(), asked, docs, 10, models=models)
    assert sorted(map(tuple, index.search(asked, k=10, docs=docs, models=models).collect())) == sorted(map(tuple, exact.collect()))


def test_an_empty_index(spark, clustered, tmp_path):
    index = I.VectorIndex(spark, f"file://{tmp_path}/i")
    index.build(clustered[0].limit(0), 16)
    assert index.search(clustered[1]).collect() == []
