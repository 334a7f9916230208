"""Merkle dataset manifest: a tree of digests a language, their roots in one tree, and for every row its proof.

Leaves lie in order in aligned blocks of FANOUT ** DEPTH, each a row with a contiguous matrix of 64-byte hexadecimal
digests. A block is reshaped by the fanout and hashed row by row, level by level; its top is a node of the next pass,
until each language has one node. Block borders fall on runs of every level, so a language of any size is dealt over
as many tasks as it has blocks. On the way down each block gets what stands beside it further up, once, and works out
siblings by index arithmetic: of node j the run is j // 8, and the siblings are the run's places other than j % 8.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, table
from .ordering import placed
from .sharding import crc32_sql

FANOUT, DEPTH, HEX = 8, 3, 64
#: Blocks up to which their paths are sent to every task (a few KB each); beyond it they join by shuffle.
BROADCAST_ROWS = 2048
#: The other places of a run, by place.
OTHERS = np.array([[k for k in range(FANOUT) if k != p] for p in range(FANOUT)])

BLOCKS = "g string, block long, members long, ids array<long>, digests binary, altered binary, top string"


# ---- one block


def matrix(data: bytes) -> np.ndarray:
    """Digests one after the other as rows of 64 bytes."""
    return np.frombuffer(data, np.uint8).reshape(-1, HEX)


def _hashed(rows) -> np.ndarray:
    return matrix("".join(hashlib.sha256(r).hexdigest() for r in rows).encode())


def height(members: int) -> int:
    """Levels above so many nodes until one remains."""
    steps = 0
    while members > 1:
        members, steps = -(-members // FANOUT), steps + 1
    return steps


def levels(nodes: np.ndarray, steps: int) -> list[np.ndarray]:
    """The nodes and the `steps` levels above: full runs as rows of a reshaped matrix, a shorter last run by itself."""
    out = [nodes]
    for _ in range(steps):
        m = np.ascontiguousarray(out[-1])
        full = len(m) // FANOUT
        runs = [*m[: full * FANOUT].reshape(full, FANOUT * HEX)]
        out.append(_hashed(runs + [m[full * FANOUT :].reshape(-1)] if len(m) % FANOUT else runs))
    return out


def _taken(m: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Nodes by index, zero bytes where a short run has none."""
    got = m[np.minimum(index, len(m) - 1)]
    got[index >= len(m)] = 0
    return got


def siblings(m: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The other nodes of each j's run, from left to right; those that a short run lacks are zero bytes."""
    return _taken(m, (j // FANOUT * FANOUT)[:, None] + OTHERS[j % FANOUT])


def _packed(row: np.ndarray) -> bytes:
    return row.tobytes().replace(b"\0", b"")


def folded(tree: list[np.ndarray], leaves: np.ndarray) -> np.ndarray:
    """The block's top as each leaf would have it, its run's other nodes being the tree's."""
    j, own = np.arange(len(leaves)), leaves
    for m in tree[:-1]:
        runs = _taken(m, (j // FANOUT * FANOUT)[:, None] + np.arange(FANOUT))
        runs[np.arange(len(j)), j % FANOUT] = own
        own, j = _hashed(map(_packed, runs)), j // FANOUT
    return own


def paths(tree: list[np.ndarray]) -> list[str]:
    """What stands beside each node of the block on its way up: levels parted by /, what is left and right by a point."""
    out, j = [[] for _ in tree[0]], np.arange(len(tree[0]))
    for m in tree[:-1]:
        for mine, p, near in zip(out, (j % FANOUT).tolist(), siblings(m, j)):
            mine.append(_packed(near[:p]).decode() + "." + _packed(near[p:]).decode())
        j = j // FANOUT
    return ["/".join(p) for p in out]


def _above(path: str, digest: bytes) -> str:
    """The root that a block's top has by the block's path."""
    for level in filter(None, path.split("/")):
        left, right = level.split(".")
        digest = hashlib.sha256(left.encode() + digest + right.encode()).hexdigest().encode()
    return digest.decode()


# ---- passes over all blocks


def _by_block(batches):
    """Rows of one block after the other, whatever the borders of the batches; they come sorted."""
    held = []
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        g, block = batch.column("g"), batch.column("block")
        new = [0, *(np.flatnonzero(pc.or_(pc.not_equal(g.slice(1), g.slice(0, n - 1)), pc.not_equal(block.slice(1), block.slice(0, n - 1))).to_numpy(zero_copy_only=False)) + 1), n]
        if held and (held[0].column("g")[0], held[0].column("block")[0]) != (g[0], block[0]):
            yield pa.Table.from_batches(held)
            held = []
        for low, high in zip(new[:-1], new[1:]):
            if low:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(low, high - low))
    if held:
        yield pa.Table.from_batches(held)


def _steps(members: int, depth: int) -> int:
    return min(depth, height(members))


def _pack(nodes: DataFrame, depth: int, name: str) -> DataFrame:
    """g, place, members, doc_id, digest, altered as blocks, written."""
    size = FANOUT**depth

    def run(batches):
        for t in _by_block(batches):
            digests = "".join(t.column("digest").to_pylist()).encode()
            members = t.column("members")[0].as_py()
            top = levels(matrix(digests), _steps(members, depth))[-1]
            altered = b"".join((a or "").encode().ljust(HEX, b"\0") for a in t.column("altered").to_pylist())
            row = ([t.column("g")[0].as_py()], [t.column("block")[0].as_py()], [members], [t.column("doc_id").to_pylist()], [digests], [altered], [top.tobytes().decode()])
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], names=["g", "block", "members", "ids", "digests", "altered", "top"])

    dealt = nodes.withColumn("block", F.expr(f"place div {size}")).select("g", "block", "place", "members", "doc_id", "digest", "altered")
    return materialize(dealt.repartition("g", "block").sortWithinPartitions("g", "block", "place").mapInArrow(run, BLOCKS), name)[0]


def forest(nodes: DataFrame, depth: int = DEPTH, name: str = "blocks") -> tuple[list[DataFrame], DataFrame]:
    """(blocks of each pass, g and digest of each tree's top) over trees of g, place, members, doc_id, digest, altered."""
    passes, tops, size = [], None, FANOUT**depth
    while True:
        passes.append(_pack(nodes, depth, name))
        above = passes[-1].select("g", F.col("block").alias("place"), F.expr(f"(members + {size - 1}) div {size}").alias("members"), F.lit(None).cast("long").alias("doc_id"), F.col("top").alias("digest"), F.lit(None).cast("string").alias("altered"))
        done = above.where("members = 1").select("g", "digest")
        tops = done if tops is None else tops.unionByName(done)
        nodes = above.where("members > 1")
        if nodes.isEmpty():
            return passes, tops


def _met(blocks: DataFrame, paths_: DataFrame) -> DataFrame:
    few = paths_.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return blocks.join(F.broadcast(paths_) if few else paths_, ["g", "block"])


def _paths_of(passes: list[DataFrame], tops: DataFrame, depth: int, name: str, to_leaves: bool = False) -> DataFrame:
    """g, block, path, subroot for the blocks of the first pass, or for its nodes; tops has g, path, subroot of each tree."""
    size, here = FANOUT**depth, None

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                found = paths(levels(matrix(r["digests"]), _steps(r["members"], depth)))
                found = ["/".join(filter(None, (p, r["path"]))) for p in found]
                at = np.arange(len(found)) + r["block"] * size
                yield pa.RecordBatch.from_arrays([pa.array([r["g"]] * len(found), pa.string()), pa.array(at, pa.int64()), pa.array(found, pa.string()), pa.array([r["subroot"]] * len(found), pa.string())], names=["g", "block", "path", "subroot"])

    for k in range(len(passes) - 1, -1, -1):
        ended = tops.join(passes[k].where(f"members <= {size}").select("g"), "g").select("g", F.lit(0).cast("long").alias("block"), "path", "subroot")
        here = ended if here is None else here.unionByName(ended)
        if k or to_leaves:
            here, _ = materialize(_met(passes[k], here).select("g", "block", "members", "digests", "path", "subroot").mapInArrow(run, "g string, block long, path string, subroot string"), name)
    return here


def field(value) -> F.Column:
    """- for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaves(docs: DataFrame) -> DataFrame:
    """g, doc_id, digest, altered of each row: its leaf, and the one after tampering where there was any."""
    number = F.col("doc_id").cast("long")
    upper = "".join(map(chr, range(65, 91)))
    leaf = lambda text: F.sha2(F.concat(field(number), field(F.col("source")), field(F.col("lang")), field(F.col("n_chars").cast("long")), field(text)), 256)
    touched = F.coalesce(F.crc32(number.cast("string").cast("binary")) % 3 == 0, F.lit(False))
    return docs.select(F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("")).alias("g"), number.alias("doc_id"), leaf(F.col("text")).alias("digest"), F.when(touched, leaf(F.translate(F.col("text").cast("string"), upper, upper.lower()))).alias("altered"))


def manifest(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row.

    A null language is a tree of its own, the first; rows without an id come first in theirs and aren't tampered with;
    rows that share an id stand in the order of their leaves; repeated rows are leaves of their own; an empty table has
    no root and gives none; other columns aren't read, so their names don't matter; texts are hashed whole, once, and
    only digests go on.
    """
    empty = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    spark = docs.sparkSession
    passes, tops = forest(placed(leaves(docs), "g", [F.asc_nulls_first("doc_id"), "digest"], "leaves"), depth)
    named, _ = materialize(tops, "subroots")
    ordered = placed(named.select(F.lit("").alias("all"), F.col("g").alias("name"), "digest"), "all", ["name"], "names")
    upper, root_of = forest(ordered.select(F.col("all").alias("g"), "place", "members", F.lit(None).cast("long").alias("doc_id"), "digest", F.lit(None).cast("string").alias("altered")), depth, "roots")
    top = root_of.first()
    if top is None:
        return spark.createDataFrame([], empty)
    root = top.digest
    start = root_of.select("g", F.lit("").alias("path"), F.lit("").alias("subroot"))
    over = _paths_of(upper, start, depth, "root_paths", to_leaves=True).select(F.col("block").alias("place"), "path")
    each = ordered.select(F.col("name").alias("g"), "place", F.col("digest").alias("subroot")).join(over, "place").select("g", "path", "subroot")
    blocks = _met(passes[0], _paths_of(passes, materialize(each, "tree_paths")[0], depth, "paths"))

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                own, changed = matrix(r["digests"]), matrix(r["altered"])
                tree = levels(own, _steps(r["members"], depth))
                at = np.arange(len(own))
                beside = [siblings(m, at // FANOUT**k) for k, m in enumerate(tree[:-1])]
                rest = r["path"].replace("/", "").replace(".", "").encode()
                near = np.concatenate(beside, axis=1) if beside else np.zeros((len(own), 0), np.uint8)
                proof = [hashlib.sha256(_packed(s) + rest).hexdigest() for s in near]
                tops_ = [t.tobytes() for t in folded(tree, np.where(changed[:, :1] != 0, changed, own))]
                known = {t: _above(r["path"], t) for t in set(tops_)}
                again, n = [known[t] for t in tops_], len(own)
                leaf = [d.tobytes().decode() for d in own]
                columns = (r["ids"], leaf, [r["subroot"]] * n, [root] * n, proof, again, [a == root for a in again])
                kinds = (pa.int64(), *[pa.string()] * 5, pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    return blocks.select("ids", "members", "digests", "altered", "path", "subroot").mapInArrow(run, empty)


def op12_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """Leaves, roots and proofs of all documents; see manifest for awkward rows."""
    return manifest(table(spark, sf_dir, "documents"))


def _oracle(heights: tuple[int, int] = (8, 4)) -> str:
    """Level by level, up and down again: trees of 8 ** 8 documents and 8 ** 4 languages at most."""
    f = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END"
    leaf = lambda text: f"sha256(concat({f('doc_id')}, {f('source')}, {f('lang')}, {f('n_chars')}, {f(text)}))"
    parts = [
        f"""lf AS MATERIALIZED (SELECT coalesce('=' || lang, '') AS g, doc_id, {leaf('text')} AS leaf,
          CASE WHEN {crc32_sql("coalesce(CAST(doc_id AS VARCHAR), '-')")} % 3 = 0 AND doc_id IS NOT NULL THEN {leaf('low')} END AS altered FROM (SELECT *, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents))""",
        "dx AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM lf)",
        "n0 AS (SELECT g, i, leaf AS d FROM dx)",
    ]

    def up(node: str, run: str, k: int) -> None:
        parts.append(f"{run}{k} AS MATERIALIZED (SELECT g, i // 8 AS r, list(d ORDER BY i) AS ds, any_value(m) AS m FROM (SELECT *, count(*) OVER (PARTITION BY g) AS m FROM {node}{k}) GROUP BY g, i // 8)")
        parts.append(f"{node}{k + 1} AS (SELECT g, r AS i, CASE WHEN m = 1 THEN ds[1] ELSE sha256(array_to_string(ds, '')) END AS d FROM {run}{k})")

    for k in range(heights[0]):
        up("n", "r", k)
    parts.append(f"sr AS MATERIALIZED (SELECT g AS name, d, row_number() OVER (ORDER BY g) - 1 AS i FROM n{heights[0]})")
    parts.append("t0 AS (SELECT '' AS g, i, d FROM sr)")
    for k in range(heights[1]):
        up("t", "q", k)

    def down(table: str, run: str, k: int, key: str) -> str:
        left, right = "array_to_string(ds[1:CAST(w.j % 8 AS INT)], '')", "array_to_string(ds[CAST(w.j % 8 AS INT) + 2:], '')"
        return f"""SELECT w.* EXCLUDE (j, own, proof), w.j // 8 AS j, CASE WHEN m = 1 THEN own ELSE sha256({left} || own || {right}) END AS own, CASE WHEN m = 1 THEN proof ELSE proof || {left} || {right} END AS proof
          FROM {table} w JOIN {run}{k} x ON x.g = {key} AND x.r = w.j // 8"""

    parts.append("w0 AS (SELECT g, doc_id, leaf, i AS j, coalesce(altered, leaf) AS own, '' AS proof FROM dx)")
    for k in range(heights[0]):
        parts.append(f"w{k + 1} AS ({down(f'w{k}', 'r', k, 'w.g')})")
    parts.append(f"v0 AS (SELECT w.g, doc_id, leaf, sr.d AS subroot, sr.i AS j, own, proof FROM w{heights[0]} w JOIN sr ON sr.name = w.g)")
    for k in range(heights[1]):
        parts.append(f"v{k + 1} AS ({down(f'v{k}', 'q', k, chr(39) * 2)})")
    return f"""WITH {", ".join(parts)} SELECT doc_id, leaf, subroot, t.d AS root, sha256(proof) AS proof_sha256, own AS folded_root, own = t.d AS verified FROM v{heights[1]}, t{heights[1]} t"""


ORACLE = _oracle()
