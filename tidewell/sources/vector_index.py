"""A stored approximate vector index: coarse lists, one-byte codes, exact cosines for what the codes put first.

Lists are the cells of a k-means over a bounded sample of the unit vectors; every vector is in the list of its nearest
centre. Its code has a byte a component. A search probes the lists nearest to each request, ranks their codes, and works
out exact cosines for the best of them. How many lists that takes depends on how the data cluster, so it is measured when
the index is built: exact neighbours of some of its vectors, and in which of their nearest lists those lie. Under
FULL_SCAN vectors a search compares all instead, and is exact. An exact search goes on from there: what was found bounds
the hits from below, a list's centre and widest angle bound its vectors from above, and lists that may hold more are compared whole.

Folders: centers (list, center), points by bucket of lists (point_id, doc_id, model_name, list, close: its
cosine with the centre, code, vector), probes.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions import vectors as V
from tidewell.operators import search as S
from tidewell.sources.scratch import stored

#: Vectors under which a search compares all.
FULL_SCAN = 10_000
#: Sampled vectors a list, and lists at most: the bounds of what the k-means sees and of the centers that tasks hold.
SAMPLE, MOST_LISTS, ROUNDS = 64, 32_768, 12
#: Lists probed at least, and candidates by codes for each hit asked for.
PROBES, SPARE = 4, 4
#: Vectors that the number of probes is measured on, their neighbours, and the share of those that probes must reach.
TRIALS, NEIGHBOURS, REACH = 64, 50, 0.985
#: Folders of the points, and rows from which on a list's points are scored by several tasks.
BUCKETS, CELL_ROWS = 32, 50_000
#: Candidates that a task gathers over its lists before it hands some on.
HELD_ROWS = 1_000_000

_POINTS = "point_id long, doc_id long, model_name string, list int, close float, code binary, vector array<float>, bucket int"


def _rows(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float32).reshape(len(column), width)


def _units(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n > 0, n, 1)


@dataclass
class VectorIndex:
    spark: SparkSession
    path: str

    # ---- writing

    @staticmethod
    def _usable(points: DataFrame, width: int) -> DataFrame:
        return points.where((F.size("vector") == width) & V.finite(F.col("vector")) & (V.norm(F.col("vector")) > 0))

    def build(self, points: DataFrame, width: int, lists: int | None = None, seed: int = 5) -> None:
        """Fit the lists and write every point (point_id, doc_id, model_name, vector). Vectors that are null, zero, of
        another width or with null or non-finite components are left out, as no cosine with them means anything."""
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector, vector_to_array

        usable = self._usable(points, width).select("point_id", "doc_id", "model_name", "vector")
        n = usable.count()
        lists = max(1, min(lists or math.ceil(math.sqrt(n)), MOST_LISTS, max(n, 1)))
        # Ordered by a hash, so the sample is the same on every run.
        sample = usable.orderBy(F.xxhash64("point_id", F.lit(seed)), "point_id").limit(SAMPLE * lists).select(array_to_vector(V.unit(F.col("vector"))).alias("features"))
        if n:
            model = KMeans(k=lists, maxIter=ROUNDS, seed=seed).fit(sample)
            centers = self.spark.createDataFrame([(k, [float(x) for x in c]) for k, c in enumerate(model.clusterCenters())], "list int, center array<double>")
        else:
            centers = self.spark.createDataFrame([], "list int, center array<double>")
            self.spark.createDataFrame([], _POINTS).write.partitionBy("bucket").parquet(f"{self.path}/points")
        centers.write.parquet(f"{self.path}/centers")
        self.add(usable, width, checked=True)
        self.spark.createDataFrame([(self._measured(seed) if n else PROBES,)], "probes int").write.mode("overwrite").parquet(f"{self.path}/probes")

    def _measured(self, seed: int) -> int:
        """Lists to probe so that REACH of the exact neighbours of TRIALS vectors lie in them."""
        points = self.points()
        trials = stored(points.orderBy(F.xxhash64("point_id", F.lit(seed + 1)), "point_id").limit(TRIALS).select(F.col("point_id").alias("query_id"), F.col("vector").alias("query_vector")))
        exact = S.vector_search(points.select(F.col("point_id").alias("doc_id"), "vector"), trials, k=NEIGHBOURS).select("query_id", F.col("doc_id").alias("point_id"))
        order = self.probes(trials, MOST_LISTS).select("query_id", "list", "place")
        places = exact.join(points.select("point_id", "list"), "point_id").join(order, ["query_id", "list"])
        at = places.agg(F.percentile("place", REACH)).first()[0]
        return max(PROBES, math.ceil(at) + 1)

    def centers(self) -> np.ndarray:
        """MOST_LISTS rows at most, by list."""
        rows = self.spark.read.schema("list int, center array<double>").parquet(f"{self.path}/centers").orderBy("list").collect()
        return _units(np.array([r.center for r in rows], dtype=np.float32)) if rows else np.zeros((0, 0), np.float32)

    def add(self, points: DataFrame, width: int, checked: bool = False) -> None:
        """Put points into the lists there are; ids must be new. The lists' fit wears off as data drifts: build anew then."""
        points = points if checked else self._usable(points, width)
        centers = self.centers()
        if not len(centers):
            return

        def place(batches):
            for batch in batches:
                v = _units(_rows(batch.column(3), width))
                at = np.concatenate([(v[i : i + 2048] @ centers.T).argmax(axis=1) for i in range(0, len(v), 2048)] or [np.zeros(0, int)])
                close = (v * centers[at]).sum(axis=1)
                codes = np.clip(np.rint(v * 127 / np.maximum(np.abs(v).max(axis=1, keepdims=True), 1e-30)), -127, 127).astype(np.int8)
                columns = [*batch.columns[:3], pa.array(at, pa.int32()), pa.array(close, pa.float32()), pa.array([c.tobytes() for c in codes], pa.binary()), batch.column(3)]
                yield pa.RecordBatch.from_arrays(columns, names=["point_id", "doc_id", "model_name", "list", "close", "code", "vector"])

        rows = points.select(F.col("point_id").cast("long"), F.col("doc_id").cast("long"), F.col("model_name").cast("string"), F.col("vector").cast("array<float>").alias("vector"))
        placed = rows.mapInArrow(place, "point_id long, doc_id long, model_name string, list int, close float, code binary, vector array<float>")
        # By id within a bucket too, so a list with a third of all points doesn't make one file.
        spread = placed.withColumn("bucket", F.pmod("list", F.lit(BUCKETS)).cast("int")).repartition("bucket", F.pmod(F.xxhash64("point_id"), F.lit(8)))
        spread.sortWithinPartitions("bucket", "list", "point_id").write.mode("append").partitionBy("bucket").parquet(f"{self.path}/points")

    def points(self) -> DataFrame:
        return self.spark.read.schema(_POINTS).parquet(f"{self.path}/points")

    # ---- searching

    def probes(self, requests: DataFrame, probes: int) -> DataFrame:
        """query_id, list, place, v: the lists nearest to each request's unit vector, the first at place 0."""
        centers = self.centers()
        width = centers.shape[1]

        def near(batches):
            for batch in batches:
                q = _units(_rows(batch.column(1), width))
                best = np.argsort(-(q @ centers.T), axis=1, kind="stable")[:, :probes]
                ids = np.repeat(batch.column(0).to_numpy(), best.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(best.reshape(-1), pa.int32()), pa.array(np.tile(np.arange(best.shape[1]), len(q)), pa.int32()), batch.column(1).take(pa.array(np.repeat(np.arange(len(q)), best.shape[1])))], names=["query_id", "list", "place", "v"])

        asked = self._usable(requests.withColumnRenamed("query_vector", "vector"), width).select("query_id", F.col("vector").cast("array<float>").alias("v"))
        return asked.mapInArrow(near, "query_id long, list int, place int, v array<float>")

    def candidates(self, points: DataFrame, probed: DataFrame, most: int) -> DataFrame:
        """query_id, point_id: of the probed lists the `most` best codes of each request.

        A list is dealt to cells by point, so that a large one is scored by several tasks; each task hands on its best over
        all its cells, so what meets grows with the requests and not with the lists that they probe."""
        sizes = points.groupBy("list").agg(F.count("*").alias("n")).select("list", F.least(F.expr(f"n div {CELL_ROWS} + 1"), F.lit(4096)).alias("cells"))
        some = probed.select("list").distinct()
        sizes = stored(sizes.join(S.small(some), "list", "left_semi"))  # a row a list
        left = probed.join(F.broadcast(sizes), "list").select("list", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1)).alias("cell"), F.lit(0).alias("role"), F.col("query_id").alias("id"), F.col("v"), F.lit(None).cast("binary").alias("code"))
        right = points.join(F.broadcast(sizes), "list").select("list", F.pmod(F.xxhash64("point_id"), "cells").alias("cell"), F.lit(1).alias("role"), F.col("point_id").alias("id"), F.lit(None).cast("array<float>").alias("v"), "code")
        dealt = left.unionByName(right).repartition("list", "cell").sortWithinPartitions("list", "cell", "role", "id")

        def run(batches):
            key, ids, q, found, held = None, None, None, [], []

            def best():
                if not found:
                    return
                points_, scores = np.concatenate([p for p, _ in found]), np.concatenate([s for _, s in found], axis=1)
                top = np.argsort(-scores, axis=1, kind="stable")[:, :most]
                held.append((np.repeat(ids, top.shape[1]), points_[top].reshape(-1), np.take_along_axis(scores, top, 1).reshape(-1).astype(np.float64)))
                if sum(len(h[0]) for h in held) >= HELD_ROWS:
                    held[:] = [merged()]
                    if len(held[0][0]) >= HELD_ROWS // 2:
                        yield batch_of(held.pop())

            def merged():
                """The `most` best of each request over the lists that this task has seen."""
                ids_, points_, near_ = (np.concatenate(c) for c in zip(*held))
                order = np.lexsort((points_, -near_, ids_))
                new = np.flatnonzero(np.r_[True, np.diff(ids_[order]) != 0])
                place = np.arange(len(order)) - np.repeat(new, np.diff(np.r_[new, len(order)]))
                return tuple(c[order[place < most]] for c in (ids_, points_, near_))

            def batch_of(columns):
                return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "point_id", "near"])

            for batch in batches:
                lists, cells, roles = (batch.column(i).to_numpy() for i in range(3))
                cuts = np.flatnonzero(np.r_[True, (np.diff(lists) != 0) | (np.diff(cells) != 0) | (np.diff(roles) != 0)]) if len(lists) else []
                for low, high in zip(cuts, np.r_[cuts[1:], len(lists)].astype(int)):
                    here = (lists[low], cells[low])
                    if here != key:
                        yield from best()
                        key, ids, q, found = here, None, None, []
                    part = batch.slice(low, high - low)
                    if roles[low] == 0:
                        v = _units(np.asarray(part.column(4).flatten(), np.float32).reshape(high - low, -1))
                        ids, q = (part.column(3).to_numpy(), v) if ids is None else (np.r_[ids, part.column(3).to_numpy()], np.r_[q, v])
                    elif ids is not None:
                        codes = np.frombuffer(b"".join(part.column(5).to_pylist()), np.int8).reshape(high - low, -1).astype(np.float32)
                        # Rounded, as equal codes may differ in the last digit by their place in the product.
                        scores, numbers = np.round(q @ _units(codes).T, 5), part.column(3).to_numpy()
                        if len(numbers) > most:  # keep what can still be among the best; of those alike the smaller ids
                            kept = np.unique(np.argsort(-scores, axis=1, kind="stable")[:, :most])
                            scores, numbers = scores[:, kept], numbers[kept]
                        found.append((numbers, scores))
            yield from best()
            if held:
                yield batch_of(merged())

        near = dealt.mapInArrow(run, "query_id long, point_id long, near double")
        from pyspark.sql import Window

        w = Window.partitionBy("query_id").orderBy(F.desc("near"), "point_id")
        return near.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).select("query_id", "point_id")

    def search(self, requests: DataFrame, k: int = 50, probes: int | None = None, docs: DataFrame | None = None, models: DataFrame | None = None, full_scan: int = FULL_SCAN, exact: bool = False) -> DataFrame:
        """query_id, doc_id, score, rank as search.vector_search has it: the best chunk of a document, cosines scaled to
        0..1. Filters on documents and models apply before lists are ranked. Approximate from full_scan points on unless
        exact; probes are those that were measured unless given."""
        points = self.points()
        if points.limit(full_scan + 1).count() <= full_scan:
            return S.vector_search(points, requests, docs, k, models=models)
        if models is not None:
            points = points.join(S.small(models.where("is_active").select("model_name")), "model_name", "left_semi")
        if docs is not None:
            points = points.join(S.live(docs).select("doc_id"), "doc_id", "left_semi")
        if probes is None:
            row = self.spark.read.schema("probes int").parquet(f"{self.path}/probes").first()
            probes = row.probes if row else PROBES
        asked = stored(requests.where("query_vector is not null").select("query_id", "query_vector"))
        first = self.candidates(points, stored(self.probes(asked, probes)), SPARE * k)
        met = points.select("point_id", "doc_id", "vector").join(first, "point_id").join(S.small(asked), "query_id")
        scored = met.groupBy("query_id", "doc_id").agg(F.max(V.cosine(F.col("vector"), F.col("query_vector"))).alias("c"))
        top = S.ranked(scored.select("query_id", "doc_id", F.round((F.col("c") + 1) / 2, 6).alias("score")), k, F.desc("score"), F.col("doc_id"))
        return self._completed(points, asked, top, k) if exact else top

    def _completed(self, points: DataFrame, asked: DataFrame, found: DataFrame, k: int) -> DataFrame:
        """The exact hits, given what was found: each request meets the lists that may hold a hit no worse than its k-th."""
        lists = stored(points.groupBy("list").agg(F.min("close").alias("close"), (F.count("*") / CELL_ROWS).cast("int").alias("more")))
        reach = {r.list: r.close for r in lists.collect()}  # MOST_LISTS at most
        centers = self.centers().astype(np.float64)
        ids = np.array(sorted(reach), np.int32)
        width, wide = centers.shape[1], np.arccos(np.clip([reach[i] for i in ids], -1, 1))
        kth = found.where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
        usable = self._usable(asked.withColumnRenamed("query_vector", "vector"), width).select("query_id", F.col("vector").cast("array<double>").alias("v"))
        floored = usable.join(S.small(kth), "query_id", "left").select("query_id", "v", F.coalesce("floor", F.lit(-1.0)).alias("floor"))

        def open_lists(batches):
            for batch in batches:
                q = np.asarray(batch.column(1).flatten()).reshape(len(batch), width)
                angle = np.arccos(np.clip(_units(q) @ centers[ids].T, -1, 1))
                most = (np.cos(np.maximum(angle - wide, 0)) + 1) / 2 + 1e-3  # float32 angles near 0 are off by that much at most
                row, at = np.nonzero(most >= np.asarray(batch.column(2))[:, None])
                rows = batch.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(ids[at], pa.int32())], names=["query_id", "v", "floor", "list"])

        pairs = floored.mapInArrow(open_lists, "query_id long, v array<double>, floor double, list int")
        dealt = self._dealt(points, pairs, F.broadcast(lists))
        best = S.best_of_cells(dealt, k).groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))
        return S.ranked(best, k, F.desc("score"), F.col("doc_id"))

    @staticmethod
    def _dealt(points: DataFrame, pairs: DataFrame, lists: DataFrame) -> DataFrame:
        """Requests and points by list and cell, as search.best_of_cells takes them; all chunks of a document that are in
        one list are in one cell."""
        left = pairs.join(lists.select("list", "more"), "list").select(F.col("list").alias("part"), F.explode(F.sequence(F.lit(0), F.col("more"))).alias("shard"), F.lit(0).alias("role"), F.col("query_id").alias("id"), "v", "floor")
        right = points.join(lists.select("list", "more"), "list").select(F.col("list").alias("part"), F.pmod(F.xxhash64("doc_id"), F.col("more") + 1).cast("int").alias("shard"), F.lit(1).alias("role"), F.col("doc_id").alias("id"), F.col("vector").cast("array<double>").alias("v"), F.lit(0.0).alias("floor"))
        return left.unionByName(right).repartition("part", "shard").sortWithinPartitions("part", "shard", "role", "id")


def recall(got: DataFrame, exact: DataFrame) -> DataFrame:
    """query_id, recall: the share of the exact hits that were found."""
    both = exact.select("query_id", "doc_id").join(got.select("query_id", "doc_id").withColumn("hit", F.lit(1)), ["query_id", "doc_id"], "left")
    return both.groupBy("query_id").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
