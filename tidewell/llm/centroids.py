"""Centroid clustering in whole numbers: float32 products screen the centroids, exact integers decide what is left open.

A round is one pass: each task screens its vectors against the centroids and sums them by centroid, and what meets in a
shuffle is a number a centroid and component, however many vectors a cluster has. The screen gives each distance as an
interval that its rounding errors cannot leave; a centroid whose interval begins above another's end is out, and only
vectors with several left are compared in integers.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

CLUSTERS, ROUNDS, SCALE, WIDTH, SEED = 8, 10, 1024, 64, 3
#: Components below this are handled as 64-bit integers (128 squared differences fit); larger ones as Python's.
SAFE = 2**26
#: Pairs of a vector and a centroid that are compared in whole numbers at a time.
BLOCK = 32_768
#: Totals travel in digits of this base, so that no sum overflows.
BASE = 2**40


def whole(x: float, scale: int = SCALE) -> int:
    """floor(scale * x) of a finite double, without overflow or rounding beyond the product's own."""
    return int(x) * scale if abs(x) >= 2.0**60 else math.floor(x * scale)


def matrices(vectors: pa.Array, width: int = WIDTH, scale: int = SCALE):
    """(rows, their vectors in whole numbers) of those with `width` finite components: a 64-bit matrix, and one of
    Python's integers where components are too large for it. Others are left out."""
    lengths = vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(lengths == width)
    if not len(rows):
        return
    values = vectors.take(pa.array(rows)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(rows), width)  # nulls become NaN
    sound = np.isfinite(values).all(axis=1)
    rows, values = rows[sound], values[sound]
    near = (np.abs(values) < SAFE / scale - 1).all(axis=1)
    if near.any():
        yield rows[near], np.floor(values[near] * scale).astype(np.int64)
    if not near.all():
        far = values[~near]
        yield rows[~near], np.array([[whole(x, scale) for x in v] for v in far.tolist()], dtype=object).reshape(far.shape)


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distance of each row of x to the same row of c, exact."""
    if x.dtype == object or c.dtype == object:
        x, c = x.astype(object), c.astype(object)
    apart = x - c
    return (apart * apart).sum(axis=1)


def screen(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Which centroids may be a vector's nearest: those whose interval of the distance isn't wholly above another's.

    The product of n components in float32 is off by at most g(n + 2) |x| |c|, where g(n) = n u / (1 - n u) and
    u = 2^-24: a rounding of each factor, of each product and of each addition, in whatever order they are made. What is
    worked out in double precision adds some 2^-50 of the terms' sizes. No product is small enough to underflow, as
    whole numbers other than 0 are at least 1.
    """
    n, u = x.shape[1] + 8, 2.0**-24
    slack = n * u / (1 - n * u)
    product = (x.astype(np.float32) @ c.astype(np.float32).T).astype(np.float64)
    squares = (c.astype(np.float64) ** 2).sum(axis=1)
    lengths = np.outer(np.sqrt((x.astype(np.float64) ** 2).sum(axis=1)), np.sqrt(squares))
    value = squares - 2 * product
    off = 2 * slack * (1 + 2.0**-20) * lengths + 2.0**-44 * (squares + 2 * lengths)
    return value - off <= (value + off).min(axis=1, keepdims=True)


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Number of the nearest centroid of each row, the smaller one of those alike."""
    if x.dtype == object or c.dtype == object:
        left = np.ones((len(x), len(c)), bool)
    else:
        left = screen(x, c)
    chosen = left.argmax(axis=1)
    row, col = np.nonzero(left & (left.sum(axis=1) > 1)[:, None])
    for at in range(0, len(row), BLOCK):  # a block ends wherever: the better of what it and the last one found stays
        r, k = row[at : at + BLOCK], col[at : at + BLOCK]
        d = distances(x[r], c[k])
        if at and r[0] == row[at - 1]:
            again = np.array([chosen[r[0]]])
            r, k, d = np.r_[r[:1], r], np.r_[again, k], np.r_[distances(x[r[:1]], c[again]), d]
        order = np.lexsort((k, d, r)) if d.dtype != object else np.array(sorted(range(len(r)), key=lambda i: (r[i], d[i], k[i])))
        first = order[np.r_[True, np.diff(r[order]) != 0]]
        chosen[r[first]] = k[first]
    return chosen


def _matrix(centroids: list[list[int]]) -> np.ndarray:
    large = any(abs(v) >= SAFE for c in centroids for v in c)
    return np.array(centroids, dtype=object if large else np.int64)


def _digits(value: int):
    place = 0
    while not -BASE < value < BASE:
        yield place, value % BASE
        value, place = value // BASE, place + 1
    yield place, value


def next_centroids(vectors: DataFrame, centroids: list[list[int]], scale: int = SCALE) -> list[list[int]]:
    """Each centroid replaced by the floor of its vectors' mean; one without vectors stays.

    vectors has the vector column alone. The driver takes a total a centroid, component and digit: their number does
    not depend on the rows.
    """
    width, k = len(centroids[0]), len(centroids)

    def run(batches):
        c, totals = _matrix(centroids), [[0] * (width + 1) for _ in range(k)]
        for batch in batches:
            for _, x in matrices(batch.column(0), width, scale):
                label = nearest(x, c)
                for j in np.unique(label):
                    mine = x[label == j]
                    totals[j] = [a + int(b) for a, b in zip(totals[j], [*mine.sum(axis=0), len(mine)])]
        rows = [(j, at, digit, v) for j, t in enumerate(totals) if t[-1] for at, total in enumerate(t) for digit, v in _digits(total)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.int64()))], names=["cluster", "place", "digit", "total"])

    parts = vectors.mapInArrow(run, "cluster int, place int, digit int, total long")
    sums = [[0] * (width + 1) for _ in range(k)]
    for r in parts.groupBy("cluster", "place", "digit").agg(F.sum("total").alias("total")).collect():
        sums[r.cluster][r.place] += r.total * BASE**r.digit
    return [[v // s[-1] for v in s[:-1]] if s[-1] else c for c, s in zip(centroids, sums)]


def first_centroids(vectors: DataFrame, id: str, column: str, clusters: int, width: int, scale: int, seed: int) -> list[list[int]]:
    """The vectors with the smallest digests of seed and id; those without an id come last, ties go by components."""
    sound = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id).cast("string")), 256)
    some = vectors.where((F.size(column) == width) & sound).select(digest.alias("digest"), F.col(column).cast("array<double>").alias("v"))
    return [[whole(x, scale) for x in r.v] for r in some.orderBy(F.asc_nulls_last("digest"), "v").limit(clusters).collect()]


def cluster(vectors: DataFrame, id: str = "vec_id", column: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept vector.

    Kept are vectors of `width` components, none null or non-finite. Repeated rows are vectors of their own, also among
    the first centroids; rows without an id are clustered like others; fewer kept vectors than clusters make fewer
    centroids; an empty table gives none; other columns aren't read, so their names don't matter. A distance or sum that
    no long holds is null.
    """
    spark = vectors.sparkSession
    only = vectors.select(F.col(id).cast("long").alias("id"), F.col(column).alias("v"))
    centroids = first_centroids(only, "id", "v", clusters, width, scale, seed)
    for _ in range(rounds if centroids else 0):
        centroids = next_centroids(only.select("v"), centroids, scale)

    def assign(batches):
        c = _matrix(centroids) if centroids else None
        for batch in batches:
            for rows, x in matrices(batch.column(1), width, scale) if centroids else ():
                label = nearest(x, c)
                far = [int(d) if d < 2**63 else None for d in distances(x, c[label])]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(label, pa.int32()), pa.array(far, pa.int64())], names=["id", "cluster", "distance"])

    done, _ = materialize(only.mapInArrow(assign, "id long, cluster int, distance long"), "assigned")
    # A row a cluster; a sum beyond a long, or of a distance beyond one, is null.
    per = done.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(28,0)")).alias("s"), F.count_if(F.col("distance").isNull()).alias("n"))
    sums = {r.cluster: (int(r.s or 0), r.n) for r in per.collect()}
    held = lambda *parts: s if (s := sum(p[0] for p in parts)) < 2**63 and not any(p[1] for p in parts) else None
    total = held(*sums.values())
    named = [(j, held(sums.get(j, (0, 0))), total, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(centroids)]
    table = spark.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return done.join(F.broadcast(table), "cluster").select(F.col("id").alias(id), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op11_centroid_clustering(spark, sf_dir: str) -> DataFrame:
    """Ten rounds over all embeddings; see cluster for awkward rows."""
    from .common import table

    return cluster(table(spark, sf_dir, "embeddings"))


def _oracle() -> str:
    """The rounds written out; a centroid is a list of whole numbers, and // of a sum and a count is made a floor."""
    near = lambda c: f"""SELECT id, row, v, c.cluster, list_sum(list_transform(range(1, {WIDTH + 1}), lambda i: (v[i] - c.c[i]) * (v[i] - c.c[i]))) AS distance
      FROM kept, {c} c QUALIFY row_number() OVER (PARTITION BY row ORDER BY distance, c.cluster) = 1"""  # noqa: E731
    parts = [
        f"""kept AS MATERIALIZED (SELECT vec_id AS id, row_number() OVER (ORDER BY vec_id) AS row, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
      WHERE len(embedding) = {WIDTH} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY digest NULLS LAST, v) - 1 AS INT) AS cluster, v AS c FROM (SELECT sha256('{SEED}:' || id) AS digest, v FROM kept ORDER BY digest NULLS LAST, v LIMIT {CLUSTERS}))""",
    ]
    for k in range(ROUNDS):
        parts.append(f"a{k} AS MATERIALIZED ({near(f'c{k}')})")
        parts.append(f"""s{k} AS (SELECT cluster, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT cluster, unnest(v) AS x, unnest(range(1, {WIDTH + 1})) AS i FROM a{k}) GROUP BY cluster, i)""")
        parts.append(f"""c{k + 1} AS MATERIALIZED (SELECT cluster, coalesce(m, c) AS c FROM c{k} LEFT JOIN (SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY i) AS m FROM s{k} GROUP BY cluster) USING (cluster))""")
    parts.append(f"last AS MATERIALIZED ({near(f'c{ROUNDS}')})")
    return f"""WITH {", ".join(parts)} SELECT id AS vec_id, cluster, CAST(distance AS BIGINT) AS distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
      sha256(array_to_string(c.c, ',')) AS centroid_sha256 FROM last JOIN c{ROUNDS} c USING (cluster)"""


ORACLE = _oracle()
