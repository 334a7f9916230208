"""Exact top-k by inner product: vectors by falling length, rotated by an SVD, pruned by Cauchy-Schwarz.

Rotation by the right singular vectors of a sample moves most of every product into the first coordinates. A query
meets the candidates in blocks of falling length. It is done when |q| * |c| of the next block's longest vector can't
reach its k-th score. Inside a block a partial product over the leading coordinates plus the product of the lengths of
what remains bounds each score; only candidates whose bound reaches the k-th score get the exact product. Bounds carry
a slack for rounding, and exact scores are integer products, so the result is exact for any sample and any rotation.

Queries and candidates meet in a grid: a candidate is copied once for each QUERY_ROWS queries, a query once for each
shard of candidates. Both counts come from the rows, so more partitions don't mean more copies.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors that rotations are learned from at most.
SAMPLE_ROWS = 20_000
#: Candidates in a block, queries that are scored together, and queries that a task holds at most.
BLOCK, QUERIES, QUERY_ROWS = 4096, 512, 16_384
LEADING = 16


def integers(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id and v: floor(scale * x) of each component. Vectors that are null, empty or hold null or non-finite
    components, and rows without an id, are left out; other columns too, so their names don't matter."""
    usable = F.expr("embedding is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where("vec_id is not null").where(usable).select(
        "vec_id", F.expr(f"transform(embedding, x -> cast(floor({scale} * cast(x as double)) as long))").alias("v")
    )


def rotations(vectors: DataFrame, rows: int = SAMPLE_ROWS) -> dict[int, np.ndarray]:
    """Right singular vectors, strongest first, of up to `rows` vectors in order of a hash, for each length that has as
    many of them as components. Vectors of other lengths are searched as they are."""
    lists = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(rows).select("v").toArrow().column("v").to_pylist()
    some = {w: [v for v in lists if len(v) == w] for w in {len(v) for v in lists}}
    return {w: np.linalg.svd((x := np.array(of, dtype=np.float64)).T @ x)[0] for w, of in some.items() if len(of) >= w}


def top_k(vectors: DataFrame, k: int, is_query, rows: int = SAMPLE_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best other vectors, smaller ids first among equal scores.

    vectors: vec_id and v (whole numbers). A query scores against the vectors of its own length, whatever lengths there
    are. Of rows that share an id, all are candidates and all are asked for; a query never meets rows of its own id. An
    empty table gives no rows.
    Each cell of the grid sees its shard by falling length and stops early; k rows a query and shard go to the merge.
    """
    spark = vectors.sparkSession
    turns = rotations(vectors, rows)
    vectors = vectors.withColumn("width", F.size("v"))
    n, asked_for = vectors.agg(F.count("*"), F.count_if(is_query)).first()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(1, math.ceil(asked_for / QUERY_ROWS))
    shards = max(1, min(math.ceil(tasks / blocks), math.ceil(n / BLOCK)))
    queries = vectors.where(is_query).withColumn("part", F.pmod(F.hash("vec_id"), F.lit(blocks)).cast("int"))
    asked = queries.select("width", "part", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(0).alias("role"), "vec_id", "v")
    offered = vectors.select("width", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("part"), F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard"), F.lit(1).alias("role"), "vec_id", "v")
    dealt = asked.unionByName(offered).withColumn("norm", F.expr("aggregate(v, 0D, (a, x) -> a + cast(x as double) * x)"))
    dealt = dealt.repartition(max(tasks, min(blocks * shards, 100_000)), "width", "part", "shard").sortWithinPartitions("width", "part", "shard", "role", F.desc("norm"), "vec_id")
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(batches):
        key, search = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            width, part, shard, role, ids = (np.asarray(batch.column(i)) for i in range(5))
            cuts = np.flatnonzero(np.r_[True, (np.diff(width) != 0) | (np.diff(part) != 0) | (np.diff(shard) != 0) | (np.diff(role) != 0)])
            for low, high in zip(cuts, np.r_[cuts[1:], len(ids)]):
                here = int(width[low])
                if (here, part[low], shard[low]) != key:
                    if search:
                        yield from search.results(schema)
                    key, search = (here, part[low], shard[low]), Search(k, turns.get(here), here)
                v = np.asarray(batch.column(5).slice(low, high - low).flatten()).reshape(-1, here)
                (search.offer if role[low] else search.ask)(ids[low:high], v)
        if search:
            yield from search.results(schema)

    partial = dealt.select("width", "part", "shard", "role", "vec_id", "v").mapInArrow(run, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return partial.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


class Search:
    """One block of queries against candidates that arrive by falling length; holds k candidates a query."""

    def __init__(self, k: int, turn: np.ndarray | None, width: int):
        self.k, self.turn, self.width, self.lead = k, turn, width, min(LEADING, width)
        self.asked: list[tuple[np.ndarray, np.ndarray]] = []
        self.ids = None

    def ask(self, ids: np.ndarray, v: np.ndarray) -> None:
        self.asked.append((ids.copy(), v.copy()))

    def _turned(self, v: np.ndarray) -> np.ndarray:
        return v.astype(np.float64) if self.turn is None else v.astype(np.float64) @ self.turn

    def _start(self) -> None:
        width = self.width
        self.ids = np.concatenate([i for i, _ in self.asked]) if self.asked else np.zeros(0, np.int64)
        self.v = np.concatenate([v for _, v in self.asked]) if self.asked else np.zeros((0, width), np.int64)
        n = len(self.ids)
        r = self._turned(self.v)
        self.head, self.tail = r[:, : self.lead], np.linalg.norm(r[:, self.lead :], axis=1)
        self.norm = np.linalg.norm(r, axis=1)
        self.scores = np.full((n, self.k), np.iinfo(np.int64).min)
        self.found = np.full((n, self.k), np.iinfo(np.int64).max)
        self.least = np.full(n, -math.inf)
        self.going = np.arange(n)

    def offer(self, ids: np.ndarray, v: np.ndarray) -> None:
        if self.ids is None:
            self._start()
        for at in range(0, len(ids), BLOCK):
            if len(self.going):
                self._block(ids[at : at + BLOCK], v[at : at + BLOCK])

    def _block(self, ids: np.ndarray, v: np.ndarray) -> None:
        r = self._turned(v)
        norm = np.linalg.norm(r, axis=1)
        slack = 1e-9 * (1 + self.norm.max() * norm.max())
        # Later candidates are no longer than the longest here: queries that it can't reach are done.
        self.going = self.going[self.norm[self.going] * norm.max() + slack >= self.least[self.going]]
        head, tail = r[:, : self.lead].T, np.linalg.norm(r[:, self.lead :], axis=1)
        exact = v.astype(np.float64).T if np.abs(v).max(initial=0) < 2**20 else None
        for low in range(0, len(self.going), QUERIES):
            some = self.going[low : low + QUERIES]
            bound = self.head[some] @ head + np.outer(self.tail[some], tail) + slack
            open_ = (bound >= self.least[some][:, None]) & (ids[None, :] != self.ids[some][:, None])
            columns = np.flatnonzero(open_.any(axis=0))
            if not len(columns):
                continue
            if exact is not None and np.abs(self.v[some]).max(initial=0) < 2**20:
                scores = np.rint(self.v[some].astype(np.float64) @ exact[:, columns]).astype(np.int64)  # below 2**53: exact
            else:
                scores = self.v[some] @ v[columns].T
            scores[~open_[:, columns]] = np.iinfo(np.int64).min
            if len(columns) > 4 * self.k:  # those below the k-th of the block can't be among the best, ties kept
                limit = np.partition(scores, len(columns) - self.k, axis=1)[:, len(columns) - self.k]
                limit = np.maximum(limit, self.scores[some].min(axis=1))
                rows, cols = np.nonzero((scores >= limit[:, None]) & (scores > np.iinfo(np.int64).min))
            else:
                rows, cols = np.nonzero(scores > np.iinfo(np.int64).min)
            self._merge(some, rows, scores[rows, cols], ids[columns[cols]])

    def _merge(self, some: np.ndarray, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        kept = np.repeat(np.arange(len(some)), self.k)
        rows = np.concatenate([kept, rows])
        scores = np.concatenate([self.scores[some].ravel(), scores])
        ids = np.concatenate([self.found[some].ravel(), ids])
        empty = scores == np.iinfo(np.int64).min
        order = np.lexsort((ids, np.where(empty, np.iinfo(np.int64).max, -scores), rows))
        rows, scores, ids = rows[order], scores[order], ids[order]
        starts = np.searchsorted(rows, np.arange(len(some)))
        take = starts[:, None] + np.arange(self.k)
        self.scores[some], self.found[some] = scores[take], ids[take]
        last = self.scores[some][:, -1]
        self.least[some] = np.where(last == np.iinfo(np.int64).min, -math.inf, last.astype(np.float64))

    def results(self, schema: pa.Schema):
        if self.ids is None:
            self._start()
        rows, cols = np.nonzero(self.scores > np.iinfo(np.int64).min)
        if len(rows):
            yield pa.RecordBatch.from_arrays([pa.array(self.ids[rows]), pa.array(self.found[rows, cols]), pa.array(self.scores[rows, cols])], schema=schema)


def op4_exact_topk(spark, sf_dir: str) -> DataFrame:
    """The 20 best of every twentieth vector; see integers and top_k for awkward rows."""
    from .common import table

    return top_k(integers(table(spark, sf_dir, "embeddings")), 20, F.col("vec_id") % 20 == 0)


#: By brute force over all pairs.
ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""
