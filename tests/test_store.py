"""The merge job: what it writes, what it leaves alone, and what a second try after a failure does."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

from tidewell.sources import store as D

DAY = datetime.datetime(2024, 1, 1)
DDL = "tenant_id string, external_ref string, title string, content string, attributes string, updated_at timestamp_ntz, deleted_at timestamp_ntz, bucket string"


def load(spark, rows):
    """(tenant, ref, content, deleted) rows; one more column with a clashing name."""
    return spark.createDataFrame([(t, r, "t", c, None, DAY + datetime.timedelta(days=k), DAY if gone else None, "clash") for k, (t, r, c, gone) in enumerate(rows)], DDL)


def state(store):
    docs = {(r.tenant_id, r.external_ref): (r.content, r.deleted_at is None) for r in store.documents().collect()}
    queue = sorted((r.load, r.tenant_id, r.external_ref, r.op) for r in store.queue().collect())
    return docs, queue, sorted((r.tenant_id, r.external_ref, r.chunk_idx) for r in store.points().collect())


def files(tmp_path, name):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(tmp_path / "s" / name) for f in fs if f.endswith(".parquet")}


@pytest.fixture
def store(spark, tmp_path):
    store = D.DocumentStore(spark, f"file://{tmp_path}/s", 6)
    store.upsert(load(spark, [("a", str(i), f"text {i}", False) for i in range(20)] + [("b", "0", "other", False), ("b", "1", "gone", True), ("a", "0", "text 0", False), (None, "1", "x", False), ("a", None, "x", False), ("a", "99", None, False)]), "l1")
    store.write_points(spark.createDataFrame([("a", str(i), c, [1.0]) for i in range(20) for c in range(3)], "tenant_id string, external_ref string, chunk_idx int, vector array<double>"))
    return store


def test_a_load_and_its_second_try(spark, store, tmp_path):
    docs, queue, points = state(store)
    assert len(docs) == 22 and docs["a", "3"] == ("text 3", True) and docs["a", "99"] == (None, True) and ("b", "1") not in docs
    assert len(queue) == 22 and len(points) == 60
    before = files(tmp_path, "documents"), files(tmp_path, "queue"), files(tmp_path, "points")
    again = load(spark, [("a", str(i), f"text {i}", False) for i in range(20)])
    assert store.upsert(again, "l1") == {"no_change": 20} and store.upsert(again, "l2") == {"no_change": 20}
    assert (files(tmp_path, "documents"), files(tmp_path, "queue"), files(tmp_path, "points")) == before


def test_only_touched_buckets_are_rewritten(spark, store, tmp_path):
    before = files(tmp_path, "documents"), files(tmp_path, "points")
    rows = load(spark, [("a", "3", "text 3 new", False), ("a", "4", "text 4", True), ("a", "5", "older", False), ("a", "5", "newer", False), ("c", "1", "first", False), ("a", "6", "text 6", False)])
    assert store.upsert(rows, "l2") == {"updated": 2, "deleted": 1, "inserted": 1, "no_change": 1}
    docs, queue, points = state(store)
    assert docs["a", "3"] == ("text 3 new", True) and docs["a", "4"][1] is False and docs["a", "5"] == ("newer", True) and docs["c", "1"] == ("first", True) and len(docs) == 23
    assert [q for q in queue if q[0] == "l2"] == [("l2", "a", "3", "upsert"), ("l2", "a", "4", "delete"), ("l2", "a", "5", "upsert"), ("l2", "c", "1", "upsert")] and len(queue) == 26
    # One chunk is left of each changed text, none of the deleted one.
    assert [p for p in points if p[1] in "345"] == [("a", "3", 0), ("a", "5", 0)] and len(points) == 60 - 2 - 3 - 2
    touched = {r.b for r in rows.where("external_ref <> '6'").select(store._bucket().alias("b")).collect()}
    for name, old in zip(("documents", "points"), before):
        now = files(tmp_path, name)
        kept = {f for f in old if int(f.split("bucket=")[1].split("/")[0]) not in touched}
        assert kept and all(now.get(f) == old[f] for f in kept)
    assert store.upsert(load(spark, [("a", "4", "text 4", False)]), "l3") == {"updated": 1} and state(store)[0]["a", "4"] == ("text 4", True)


def test_a_job_that_dies_before_the_documents_are_written(spark, store, monkeypatch):
    rows = load(spark, [("a", "3", "text 3 new", False), ("a", "4", "text 4", True), ("z", "1", "first", False)])
    plain = D.DocumentStore._replace

    def dies(self, df, name, by):
        if name == "documents":
            raise RuntimeError("executor lost")
        plain(self, df, name, by)

    monkeypatch.setattr(D.DocumentStore, "_replace", dies)
    with pytest.raises(RuntimeError):
        store.upsert(rows, "l2")
    monkeypatch.setattr(D.DocumentStore, "_replace", plain)
    assert store.upsert(rows, "l2") == {"updated": 1, "deleted": 1, "inserted": 1}
    docs, queue, points = state(store)
    assert len([q for q in queue if q[0] == "l2"]) == 3 and docs["z", "1"] == ("first", True) and docs["a", "3"][0] == "text 3 new"
    assert not [p for p in points if p[1] == "4"]


def test_nothing_to_load(spark, tmp_path):
    store = D.DocumentStore(spark, f"file://{tmp_path}/s")
    assert store.upsert(load(spark, [("a", "1", "x", False)]).limit(0), "l1") == {} and state(store) == ({}, [], [])
