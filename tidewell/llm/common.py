"""Shared helpers: table access, scratch tables in the shared folder, connected components."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: list[str] = []
_OWN: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """This application's folder in the one that driver and executors share; it goes when the driver ends.

    Only a local master may do without a shared folder: on several machines each would write to its own disk.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _LOCAL:
            _LOCAL.append(tempfile.mkdtemp(prefix="tidewell-"))
            atexit.register(shutil.rmtree, _LOCAL[0], True)
        root = f"file://{_LOCAL[0]}"
    own = f"{root}/tidewell-{spark.sparkContext.applicationId}"
    if own not in _OWN:
        _OWN.add(own)
        atexit.register(_sweep, spark, own)
    return own


def _sweep(spark: SparkSession, path: str) -> None:
    """What lazily read results still had in the folder, at the end of the driver. A gateway that is gone can't."""
    try:
        discard(spark, path)
    except Exception:
        pass


def materialize(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write a table to the shared folder and read it back: a cut of the lineage that outlives executors."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Remove a scratch table that nothing reads any more."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


def release(spark: SparkSession) -> None:
    """Let the session drop the shuffle files and broadcasts of results that nothing refers to, now that they are written
    out, and the driver give back the memory of their plans."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def salts(spark: SparkSession) -> int:
    """Into how many parts a hot key is dealt: with the partitions, so more machines do shorten it."""
    return max(64, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))


def beside(rows: DataFrame, keys: str | list[str], salt: str, part: Column, whole: Column) -> DataFrame:
    """rows with the aggregates `part` of (keys, salted) and then `whole` of those, over each key.

    The aggregate comes back to its rows through the parts of its key, so neither join deals a key to one task.
    """
    keys = [keys] if isinstance(keys, str) else keys
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(salts(rows.sparkSession))))
    parts = dealt.groupBy(*keys, "_salt").agg(part)
    named = parts.select(*keys, "_salt").join(parts.groupBy(*keys).agg(whole), keys)
    return dealt.join(named, [*keys, "_salt"]).drop("_salt")


def _settled(pairs: DataFrame) -> bool:
    """Whether every u stands in one pair and no v is a u: stars around nodes that hang from none. A row a node and task is
    shuffled, so a hub's pairs don't meet in one."""
    ends = pairs.select("u", F.lit(1).alias("outs"), F.lit(0).alias("ins")).unionByName(pairs.select(F.col("v").alias("u"), F.lit(0).alias("outs"), F.lit(1).alias("ins")))
    nodes = ends.groupBy("u").agg(F.sum("outs").alias("outs"), F.max("ins").alias("ins"))
    return nodes.where("outs > 1 or outs = 1 and ins = 1").isEmpty()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Label the nodes of an undirected graph with the smallest node they can reach.

    edges: two long columns. Returns (node, component) for every node that has an edge to another node.
    Alternates large-star and small-star steps until every node hangs from its component's smallest one,
    as aggregates and joins only: no neighbour list is ever gathered, and a hub's edges are dealt by salt.
    It ends when what is left are stars, which no round would change: one pass tells, where a further round would take two
    written tables. Pairs that are stars from the start need no round.
    """
    spark = edges.sparkSession
    a, b = edges.columns[:2]
    pairs = (
        edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v"))
        .where("u is not null and v is not null and u <> v")
        .distinct()
    )
    current, path = materialize(pairs, "edges")
    release(spark)
    least = F.min("v").alias("m"), F.min("m").alias("m")
    settled = _settled(current)
    for _ in range(max_rounds):
        if settled:
            break
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Written too: plans that read it several times stay small, and so does what the driver keeps of them.
        large, large_path = materialize(beside(both, "u", "v", *least).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct(), "stars")
        release(spark)
        near = beside(large, "u", "v", *least)
        # The smallest neighbour stays with its node; the others go over to it.
        small = near.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()
        following, new_path = materialize(small, "edges")
        discard(spark, path)
        discard(spark, large_path)
        current, path = following, new_path
        settled = _settled(current)
        release(spark)
    if not settled:
        raise RuntimeError("components did not settle")
    nodes = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return nodes.unionByName(roots)
