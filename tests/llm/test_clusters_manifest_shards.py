"""Clustering, manifest and sharding against plain code, on rows of every awkward kind, and against their SQL."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from compare import SF_DIR, same
from pyspark.sql import functions as F

from tidewell.llm import centroids, manifest, queries, sharding

sha = lambda t: hashlib.sha256(t.encode()).hexdigest()


@pytest.mark.parametrize("name", ["op11_centroid_clustering", "op12_merkle_manifest", "op13_sharding"])
def test_query_against_sql(spark, oracle, name):
    same(queries.QUERIES[name](spark, SF_DIR), oracle.sql(queries.ORACLES[name]))


# ---- centroids


def plain_clusters(rows, k=8, rounds=10, scale=1024, width=64, seed=3):
    kept = [(i, [math.floor(x * scale) if abs(x) < 2**60 else int(x) * scale for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, sha(f"{seed}:{r[0]}"), r[1]))
    c = [v for _, v in order[:k]]
    far = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m)), j) for j, m in enumerate(c))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[far(v)[1]].append(v)
        c = [[sum(x) // len(groups[j]) for x in zip(*groups[j])] if groups[j] else m for j, m in enumerate(c)]
    return sorted(((-1 if i is None else i), far(v)[1], far(v)[0]) for i, v in kept), [sha(",".join(map(str, m))) for m in c]


@pytest.mark.parametrize("kind", ["plain", "ties", "large", "few"])
def test_clusters_against_plain_code(spark, kind):
    rng = np.random.default_rng(4)
    n = {"few": 3}.get(kind, 90)
    v = {"plain": rng.normal(size=(n, 64)), "ties": rng.integers(0, 2, size=(n, 64)).astype(float) * 0.25, "large": rng.normal(size=(n, 64)) * 10.0 ** rng.integers(0, 8, size=(n, 1)), "few": rng.normal(size=(n, 64))}[kind].astype(np.float32)
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(5, v[0].tolist()), (5, v[0].tolist()), (None, v[1].tolist()), (200, None), (201, [0.0] * 63), (202, [float("nan")] * 64), (203, [None] * 64), (204, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("cluster", F.lit("clash")).withColumn("distance", F.lit(1)).repartition(5)
    got = centroids.cluster(df).collect()
    want, digests = plain_clusters(rows)
    assert sorted((-1 if r.vec_id is None else r.vec_id, r.cluster, r.distance) for r in got) == [(i, j, d if d < 2**63 else None) for i, j, d in want]
    assert all(r.centroid_sha256 == digests[r.cluster] for r in got)
    sums = Counter()
    for _, j, d in want:
        sums[j] += d
    held = lambda s: s if s < 2**63 else None
    if kind != "large":
        assert all((r.cluster_inertia, r.inertia) == (held(sums[r.cluster]), held(sum(sums.values()))) for r in got)


def test_no_vectors(spark):
    assert centroids.cluster(spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>")).collect() == []


def test_screen_keeps_every_nearest(spark):
    """Vectors a rounding error apart: what the screen leaves always holds the exact nearest, and blocks agree."""
    rng = np.random.default_rng(8)
    c = rng.integers(-(2**20), 2**20, size=(8, 64))
    c[4:] = c[:4] + rng.integers(-1, 2, size=(4, 64))
    x = c[rng.integers(0, 8, 500)] + rng.integers(-1, 2, size=(500, 64))
    exact = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
    left = centroids.screen(x, c)
    assert left[np.arange(500), exact.argmin(axis=1)].all() and 1 < left.sum(axis=1).mean() < 4
    assert (centroids.nearest(x, c) == exact.argmin(axis=1)).all()
    block, centroids.BLOCK = centroids.BLOCK, 3
    try:
        assert (centroids.nearest(x, c) == exact.argmin(axis=1)).all()
    finally:
        centroids.BLOCK = block
    assert [v for v in centroids._digits(-(2**90))] and sum(v * centroids.BASE**p for p, v in centroids._digits(-(2**90) + 7)) == -(2**90) + 7
    assert list(centroids.matrices(pa.array([None, [], [1.0]], pa.list_(pa.float32())))) == []


# ---- manifest


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def plain_manifest(rows):
    """rows of doc_id, source, lang, n_chars, text."""

    def leaf(r, text):
        return sha("".join(map(field, (r[0], r[1], r[2], r[3], text))))

    def tree(nodes):
        """Levels, and for each node its proof as (left, right) a level."""
        at = [nodes]
        while len(at[-1]) > 1:
            at.append([sha("".join(at[-1][i : i + 8])) for i in range(0, len(at[-1]), 8)])
        proofs = []
        for i in range(len(nodes)):
            steps = []
            for level in at[:-1]:
                run = level[i // 8 * 8 : i // 8 * 8 + 8]
                steps.append(("".join(run[: i % 8]), "".join(run[i % 8 + 1 :])))
                i //= 8
            proofs.append(steps)
        return at[-1][0], proofs

    langs, out = defaultdict(list), []
    for r in rows:
        langs[r[2]].append((r[0] is not None, r[0] or 0, leaf(r, r[4]), r))
    order = sorted(langs, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([x[2] for x in sorted(langs[g], key=lambda x: x[:3])]) for g in order}
    root, above = tree([trees[g][0] for g in order])
    for k, g in enumerate(order):
        for (_, _, mine, r), steps in zip(sorted(langs[g], key=lambda x: x[:3]), trees[g][1]):
            steps, again = steps + above[k], mine
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None:
                again = leaf(r, "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]))
            for a, b in steps:
                again = sha(a + again + b)
            out.append((r[0], mine, trees[g][0], root, sha("".join(a + b for a, b in steps)), again, again == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_manifest_against_plain_code(spark, awkward, depth):
    extra = spark.range(150).selectExpr("id + 100 AS doc_id", "concat('Text ', id) AS text", "if(id < 80, 'en', concat('l', id % 13)) AS lang", "'é' AS source", "if(id % 9 = 0, null, id) AS n_chars")
    docs = awkward.select("doc_id", "text", "lang", "source", "n_chars").unionByName(extra).withColumn("leaf", F.lit("clash")).withColumn("place", F.lit(1)).repartition(6)
    rows = [tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    got = sorted((tuple(r) for r in manifest.manifest(docs, depth).collect()), key=repr)
    assert got == plain_manifest(rows) and any(not r[-1] for r in got) and any(r[-1] for r in got)


def test_no_documents(nothing):
    assert manifest.manifest(nothing).collect() == [] and sharding.shard(nothing).collect() == []


def test_one_document_is_its_own_root(spark):
    r = manifest.manifest(spark.createDataFrame([(1, "a", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")).first()
    assert r.leaf == r.subroot == r.root == r.folded_root and r.proof_sha256 == sha("") and r.verified


# ---- shards


def plain_shards(rows, shards=8, seed=13):
    """rows of doc_id, source, text."""
    strata = defaultdict(list)
    for i, s, t in rows:
        body = (t or "").encode()
        strata["" if s is None else "=" + s].append((hashlib.md5(f"{seed}:{'-' if i is None else i}".encode()).digest(), i is not None, i or 0, len(body) + 1, zlib.crc32(body)))
    spread = []
    for s, members in strata.items():
        u = int(hashlib.md5(f"{seed}|{s}".encode()).hexdigest()[:4], 16)
        spread += [((2 * (65536 * k + u) + 1) / (131072 * len(members)), s.encode(), m) for k, m in enumerate(sorted(members))]
    out, n = [], len(rows)
    for p, (_, _, m) in enumerate(sorted(spread)):
        k = p * shards // n
        out.append((m[2] if m[1] else None, m[3], m[4], "rows", k, p - -(-k * n // shards), None))
    return sorted(out, key=repr)


def test_shards_against_plain_code(spark, awkward):
    extra = spark.range(300).selectExpr("id + 100 AS doc_id", "repeat('x', cast(id % 7 as int)) AS text", "if(id % 3 = 0, 'hot', concat('s', id % 11)) AS source")
    docs = awkward.select("doc_id", "text", "source").unionByName(extra).withColumn("shard", F.lit("clash")).withColumn("_part", F.lit(2)).repartition(7)
    got = sharding.shard(docs).drop("source").collect()
    rows = [(r.doc_id, r.source, r.text) for r in docs.collect()]
    assert sorted((tuple(r) for r in got), key=repr) == plain_shards(rows)
    counts = Counter(r.shard for r in got)
    assert max(counts.values()) - min(counts.values()) <= 1
    assert all(sorted(r.slot for r in got if r.shard == k) == list(range(n)) for k, n in counts.items())
    hot = Counter(r.shard for r in sharding.shard(docs).where("source = 'hot'").collect())
    assert max(hot.values()) - min(hot.values()) <= 3
    lone = docs.limit(0).select("doc_id", "text", "source").unionByName(spark.range(400).selectExpr("id AS doc_id", "'t' AS text", "concat('only', id) AS source"))
    assert {r.shard for r in sharding.shard(lone).where("source like 'only%'").collect()} == set(range(8))
