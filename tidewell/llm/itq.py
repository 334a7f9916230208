"""Embedding near-dedup: iterative quantisation, multi-index Hamming tables, rerank with the original vectors.

A rotation is learned for each vector length (principal axes, then alternating between codes and the best rotation to
them) so that the signs of the turned coordinates make balanced binary codes. A code is cut into substrings, each the
key of a table beside the label; the substrings get longer with the rows, so that buckets don't grow with them. A
vector stands in each table under its substring and under those with any of its least certain bits turned.

Two steps, so that vectors travel only where they are needed. First codes meet in their buckets, a bucket at a time in
blocks, and rows that have a partner within the Hamming radius there are noted; then the noted rows meet again with
their vectors and the cosines decide. A pair counts in one bucket only, the first where the two meet. Exact copies are
one row with a count. Buckets give counts and spanning links, never all their pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import beside, connected_components, discard, materialize, salts

#: Vectors that rotations are learned from at most; every row is indexed. A length with fewer than LEAST_ROWS of them
#: gets a random rotation.
SAMPLE_ROWS, LEAST_ROWS = 20_000, 16
BITS = 64
#: Rows that a bucket has on average, and rows of a bucket block.
BUCKET, BLOCK = 256, 2048
#: Share of a code's bits in which two codes may differ; at a cosine of 0.93 an eighth of the bits is expected to, and of
#: random codes one pair in thirty thousand stays below it.
RADIUS = 0.25
THRESHOLD = 0.93


def shape(rows: int, bits: int = BITS) -> tuple[int, int]:
    """(tables, least certain bits turned) for this many rows: substrings of log2(rows / BUCKET) bits, 8 at least."""
    length = max(8, math.ceil(math.log2(max(rows, 1) / BUCKET)))
    return max(2, bits // length), 1 + (length - 7) // 2


def usable() -> str:
    """SQL condition for rows that can link. Null or zero vectors, those with null or non-finite components, and rows
    without a label or an id can't."""
    return "coalesce(label is not null and vec_id is not null and embedding is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0), false)"


def _units(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def learn_rotation(x: np.ndarray, rounds: int = 40, seed: int = 11) -> np.ndarray:
    """Columns turn unit vectors so that their signs lose least: the first BITS principal axes times an orthogonal matrix.

    The mean isn't taken off: near-duplicates are told by their angle at the origin, which codes then keep.
    """
    axes = np.linalg.svd(x.T @ x)[0][:, :BITS]
    y = x @ axes
    turn = np.linalg.qr(np.random.default_rng(seed).normal(size=(axes.shape[1],) * 2))[0]
    for _ in range(rounds):
        u, _, vt = np.linalg.svd(np.where(y @ turn >= 0, 1.0, -1.0).T @ y)
        turn = vt.T @ u.T
    return axes @ turn


def any_rotation(width: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(width).normal(size=(width, min(width, BITS))))[0]


def cuts(width: int, tables: int) -> list[tuple[int, int]]:
    """(first bit, number of bits) of each table's substring for vectors of this length."""
    parts = np.array_split(np.arange(min(width, BITS)), min(tables, width))
    return [(int(p[0]), len(p)) for p in parts]


def codes(turned: np.ndarray, tables: int, flips: int) -> tuple[np.ndarray, np.ndarray]:
    """Code, and the bits that are turned in probes: of each substring the `flips` least certain."""
    n, width = turned.shape
    bit = np.uint64(1) << np.arange(width, dtype=np.uint64)
    code = np.where(turned >= 0, bit, np.uint64(0)).sum(axis=1, dtype=np.uint64)
    unsure = np.zeros(n, np.uint64)
    for low, size in cuts(width, tables):
        order = np.argsort(np.abs(turned[:, low : low + size]), axis=1, kind="stable")[:, : min(flips, size)]
        unsure |= bit[low + order].sum(axis=1, dtype=np.uint64)
    return code, unsure


def _pairs_of_bucket(a_code, a_free, b_code, b_free, where: list[tuple[int, int]], table: int, key: np.uint64) -> np.ndarray:
    """Whether this bucket is the first where each of a meets each of b: tables in order, then the smallest key."""
    a_code, a_free, b_code, b_free = a_code[:, None], a_free[:, None], b_code[None, :], b_free[None, :]
    apart = (a_code ^ b_code) & ~(a_free | b_free)
    first = np.ones(apart.shape, bool)
    for low, size in where[:table]:
        first &= (apart & _mask(low, size)) != 0
    here = _mask(*where[table])
    meet = ((a_code & ~a_free) | (b_code & a_free & ~b_free)) & here
    return first & ((apart & here) == 0) & (meet == key)


def _mask(low: int, size: int) -> np.uint64:
    return np.uint64(((1 << size) - 1) << low)


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, rows: int = SAMPLE_ROWS, tables: int | None = None, flips: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row.

    Rows that can't link (see usable) have 0 links and are their own component. Vectors of different lengths don't link.
    Rows that share an id are vectors of their own, and their components are named by the smallest id in them; a row's
    links count the other rows, repeated ones too. Ties don't arise; an empty table gives none; of other columns none is
    read, so their names don't matter. `tables` and `flips` come from the number of rows unless given.
    """
    spark = vectors.sparkSession
    every = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), "embedding")
    rest = every.where(f"not {usable()}").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    # Equal vectors are told by 128 bits; the salt is drawn once and written, so that copies of one are dealt to many tasks.
    digest = [F.xxhash64(F.lit(k), "label", "embedding").alias(f"d{k}") for k in (1, 2)]
    listed, _ = materialize(every.where(usable()).select("vec_id", *digest, F.floor(F.rand(5) * salts(spark)).cast("int").alias("salt"), "label", "embedding"), "rows")
    found = listed.groupBy("d1", "d2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.any_value("label").alias("label"), F.any_value("embedding").alias("v"))
    classes, _ = materialize(found.withColumn("node", F.monotonically_increasing_id()), "classes")
    parts = listed.groupBy("d1", "d2", "salt").agg(F.count("*").alias("_n"))
    names = parts.drop("_n").join(classes.select("d1", "d2", "node"), ["d1", "d2"])
    total = classes.count()
    if not total:
        return rest
    if tables is None or flips is None:
        tables, flips = shape(total)
    sample = [np.array(v, float) for v in classes.orderBy(F.xxhash64("d1"), "d1", "d2").limit(rows).select("v").toArrow().column("v").to_pylist()]
    turns = {w: learn_rotation(_units(np.stack(some))) for w in {len(v) for v in sample} if len(some := [v for v in sample if len(v) == w]) >= LEAST_ROWS}
    links, to = _compare(classes, turns, tables, flips, threshold)
    counts = links.groupBy("node").agg(F.sum("links").alias("links"))
    # Components of classes, named by the smallest id of any of their rows.
    component = connected_components(to)
    named = component.join(classes.select("node", "rep"), "node")
    named = beside(named, "component", "node", F.min("rep").alias("least"), F.min("least").alias("least")).select("node", "least")
    result, _ = materialize(
        classes.select("node", "rep", "copies").join(counts, "node", "left").join(named, "node", "left")
        .select("node", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"), F.coalesce("least", "rep").alias("component_id")), "result"
    )
    out = listed.select("vec_id", "d1", "d2", "salt").join(names.join(result, "node"), ["d1", "d2", "salt"])
    return out.select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept")).unionByName(rest)


def _compare(classes: DataFrame, turns: dict[int, np.ndarray], tables: int, flips: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(node, links) to add up, and spanning (node, other) links."""
    spark = classes.sparkSession
    bucket, cell = ["label", "width", "table", "key"], ["label", "width", "table", "key", "x", "y"]
    ddl = "label string, width int, table int, key long, node long, code long, free long"
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "array<double>": pa.list_(pa.float64())}
    fields = lambda text: pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in text.split(", ")])
    placed_schema = fields(ddl)

    def place(batches):
        known = dict(turns)
        for batch in batches:
            lengths = np.asarray(batch.column(2).value_lengths())
            for width in np.unique(lengths).tolist():
                some = batch.filter(pa.array(lengths == width))
                turn = known.setdefault(width, turns.get(width) if width in turns else any_rotation(width))
                for at in range(0, some.num_rows, 2000):
                    part = some.slice(at, 2000)
                    v = np.asarray(part.column(2).flatten(), float).reshape(-1, width)
                    code, free = codes(_units(v) @ turn, tables, flips)
                    for t, (low, size) in enumerate(cuts(width, tables)):
                        here = _mask(low, size)
                        own, choice = code & here, free & here
                        subset = choice.copy()  # every subset of the free bits, from all down to none
                        going = np.arange(len(v))
                        while len(going):
                            yield pa.RecordBatch.from_arrays(
                                [part.column(1).take(pa.array(going)), pa.array(np.full(len(going), width, np.int32)), pa.array(np.full(len(going), t, np.int32)), pa.array((own[going] ^ subset[going]).view(np.int64)),
                                 part.column(0).take(pa.array(going)), pa.array(code[going].view(np.int64)), pa.array(free[going].view(np.int64))], schema=placed_schema,
                            )
                            going = going[subset[going] != 0]
                            subset[going] = (subset[going] - np.uint64(1)) & choice[going]

    placed = classes.select("node", "label", "v").mapInArrow(place, ddl)
    # Blocks by the size of the bucket; each row goes to the pairs of blocks that it is part of.
    sized = beside(placed, bucket, "node", F.count("*").alias("n"), F.sum("n").alias("n")).where("n > 1")
    sized = sized.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    cells = sized.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(*bucket, F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), "mine", "node", "code", "free")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def by_cell(judge):
        """A function of batches that are sorted by cell: judge(head, columns) for the rows of each."""

        def run(batches):
            key, group = None, []
            for batch in batches:
                heads = list(zip(*(batch.column(i).to_pylist() for i in range(6))))
                ends = [0, *(i for i in range(1, len(heads)) if heads[i] != heads[i - 1]), len(heads)]
                for low, high in zip(ends, ends[1:]):
                    if low < high:
                        if heads[low] != key:
                            if key:
                                yield from judge(key, group)
                            key, group = heads[low], []
                        group.append(batch.slice(low, high - low))
            if key:
                yield from judge(key, group)

        return run

    def columns(group, names):
        return [np.concatenate([np.asarray(b.column(b.schema.get_field_index(n))) for b in group]) for n in names]

    def sides(head, mine):
        a = np.flatnonzero(mine == head[4])
        return a, a if head[4] == head[5] else np.flatnonzero(mine == head[5])

    noted_ddl = "label string, width int, table int, key long, x int, y int, mine int, node long, code long, free long"
    noted_schema = fields(noted_ddl)

    def note(head, group):
        label, width, table, key, x, y = head
        mine, node, code, free = columns(group, ["mine", "node", "code", "free"])
        code, free, where = code.view(np.uint64), free.view(np.uint64), cuts(width, tables)
        radius = math.ceil(RADIUS * min(width, BITS))
        a, b = sides(head, mine)
        near = np.zeros(len(node), bool)
        for low in range(0, len(a), 512):
            some = a[low : low + 512]
            met = np.bitwise_count(code[some][:, None] ^ code[b][None, :]) <= radius
            met &= some[:, None] < b[None, :] if x == y else True
            if met.any():
                met &= _pairs_of_bucket(code[some], free[some], code[b], free[b], where, table, np.uint64(key % 2**64))
                near[some] |= met.any(axis=1)
                near[b] |= met.any(axis=0)
        at = np.flatnonzero(near)
        if len(at):
            heads = [pa.array([v] * len(at), f.type) for v, f in zip(head, noted_schema)]
            yield pa.RecordBatch.from_arrays([*heads, pa.array(mine[at], pa.int32()), pa.array(node[at]), pa.array(code[at].view(np.int64)), pa.array(free[at].view(np.int64))], schema=noted_schema)

    order = [*cell, "mine", "node"]
    dealt = cells.select(*order, "code", "free").repartition(tasks, *cell).sortWithinPartitions(*order)
    noted, noted_path = materialize(dealt.mapInArrow(by_cell(note), noted_ddl), "noted")
    met_ddl = "node long, links long, to long"
    met_schema = fields(met_ddl)

    def decide(head, group):
        label, width, table, key, x, y = head
        mine, node, copies, code, free = columns(group, ["mine", "node", "copies", "code", "free"])
        code, free, where = code.view(np.uint64), free.view(np.uint64), cuts(width, tables)
        u = _units(np.concatenate([np.asarray(b.column(b.schema.get_field_index("v")).flatten(), float).reshape(-1, width) for b in group]))
        a, b = sides(head, mine)
        links, parent = np.zeros(len(node), np.int64), np.arange(len(node))
        for low in range(0, len(a), 512):
            some = a[low : low + 512]
            near = u[some] @ u[b].T >= threshold
            near &= some[:, None] < b[None, :] if x == y else True
            if not near.any():
                continue
            near &= _pairs_of_bucket(code[some], free[some], code[b], free[b], where, table, np.uint64(key % 2**64))
            links[some] += near @ copies[b]
            np.add.at(links, b, copies[some] @ near)
            for i in np.flatnonzero(near.any(axis=1)):  # spanning links: each set of meeting rows hangs from its root
                roots = np.append(parent[b[near[i]]], parent[some[i]])
                parent[np.isin(parent, roots)] = roots.min()
        at = np.flatnonzero((links > 0) | (parent != np.arange(len(node))))
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(links[at]), pa.array(node[parent[at]])], schema=met_schema)

    again = noted.join(classes.select("node", "copies", F.col("v").cast("array<double>").alias("v")), "node").select(*order, "copies", "code", "free", "v")
    met, _ = materialize(again.repartition(tasks, *cell).sortWithinPartitions(*order).mapInArrow(by_cell(decide), met_ddl), "met")
    discard(spark, noted_path)
    return met.select("node", "links"), met.where("node <> to").select("node", "to")


def op7_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings; see near_duplicates for awkward rows."""
    from .common import table

    return near_duplicates(table(spark, sf_dir, "embeddings"))


#: By brute force over all pairs of a label; components by walking the links.
ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id, b.vec_id AS other FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
w AS (SELECT vec_id, vec_id AS reached FROM embeddings UNION SELECT w.vec_id, l.other FROM w JOIN l ON w.reached = l.vec_id),
c AS (SELECT vec_id, min(reached) AS component_id FROM w GROUP BY vec_id), n AS (SELECT vec_id, count(*) AS n_links FROM l GROUP BY vec_id)
SELECT e.vec_id, coalesce(n.n_links, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept FROM embeddings e JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)
"""
