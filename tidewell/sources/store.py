"""Documents, queue and vectors as stored tables, and the job that merges a load into them.

The documents lie in buckets by a hash of tenant and reference, so a large tenant is spread as well. A load rewrites the
buckets that it changes and no others, by dynamic overwrite: their new files replace the old ones when the job commits.
Steps go in an order in which a job that is tried again after any failure ends with the same tables: first the queue's
rows of the load, which merge with those that an earlier try left, then vectors, and last the documents, whose hashes
tell the next try what is still to do.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.operators import indexing
from tidewell.sources.scratch import Scratch, remove

#: Buckets of a new store; a large one has thousands, some hundred megabytes each. It stays as the tables were written.
BUCKETS = 16
KEYS = ["tenant_id", "external_ref"]
_DOCS = "tenant_id string, external_ref string, title string, content string, attributes string, content_hash string, updated_at timestamp_ntz, deleted_at timestamp_ntz, bucket int"
_QUEUE = "tenant_id string, external_ref string, content_hash string, op string, status string, attempts int, load string"
_POINTS = "tenant_id string, external_ref string, chunk_idx long, vector array<float>, bucket int"


@dataclass
class DocumentStore:
    spark: SparkSession
    path: str
    buckets: int = BUCKETS

    def _bucket(self):
        return F.pmod(F.xxhash64(*KEYS), F.lit(self.buckets)).cast("int")

    def _table(self, name: str, schema: str) -> DataFrame:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if not target.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(target):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def documents(self) -> DataFrame:
        return self._table("documents", _DOCS)

    def queue(self) -> DataFrame:
        return self._table("queue", _QUEUE)

    def points(self) -> DataFrame:
        return self._table("points", _POINTS)

    def _replace(self, rows: DataFrame, name: str, by: str) -> None:
        """Only the partitions that rows has are replaced, when the job commits; rows may be read from them. Rows should lie
        together by partition, else every task writes a file for each."""
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(f"{self.path}/{name}")

    def _buckets(self, table: DataFrame, rows: DataFrame) -> DataFrame:
        """The table's buckets that rows touches; as many numbers at most come to the driver."""
        touched = [r[0] for r in rows.select("bucket").distinct().collect()]
        return table.where(F.col("bucket").isin(touched))

    # ---- merging

    #: The order of a key's rows in a load: the one updated last, of those alike the one with the largest hash. The others
    #: only make the choice the same wherever it is made.
    _ORDER = ("updated_at", "content_hash", "extra", "deleted_at")

    def _load(self, incoming: DataFrame) -> DataFrame:
        """The load's rows with hash and bucket. Rows without a key go."""
        rows = incoming.select(*KEYS, "title", "content", "attributes", "updated_at", "deleted_at").where("tenant_id is not null and external_ref is not null")
        hashed = rows.withColumn("content_hash", indexing.content_hash(F.col("title"), F.col("content"))).withColumn("extra", F.xxhash64("attributes"))
        return hashed.withColumn("bucket", self._bucket())

    def changes(self, incoming: DataFrame) -> DataFrame:
        """A row a key of the load, without its text, with `status`: inserted, updated (also when deleted before), deleted,
        or no_change."""
        w = Window.partitionBy(*KEYS).orderBy(*map(F.desc, self._ORDER))
        rows = self._load(incoming).select(*KEYS, "bucket", *self._ORDER).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
        old = self.documents().select(*KEYS, F.col("content_hash").alias("old_hash"), F.col("deleted_at").alias("old_deleted"), F.lit(True).alias("there"))
        joined = rows.join(old, KEYS, "left")
        gone, was_gone = F.col("deleted_at").isNotNull(), F.col("old_deleted").isNotNull()
        status = (
            F.when(F.col("there").isNull(), F.when(gone, "no_change").otherwise("inserted"))
            .when(gone, F.when(was_gone, "no_change").otherwise("deleted"))
            .when(was_gone | ~F.col("old_hash").eqNullSafe(F.col("content_hash")), "updated").otherwise("no_change")
        )
        return joined.withColumn("status", status).drop("old_hash", "old_deleted", "there")

    def upsert(self, incoming: DataFrame, load: str) -> dict[str, int]:
        """Merge a load: hash, compare, enqueue what changed, prune vectors beyond the new chunks, write. Counts by status.

        Documents that the load doesn't name stay. A load that was merged, or one without a change, writes nothing.
        """
        with Scratch(self.spark) as scratch:
            found = scratch.stored(self.changes(incoming))
            counts = {r.status: r.n for r in found.groupBy("status").agg(F.count("*").alias("n")).collect()}
            changed = found.where("status <> 'no_change'")
            if set(counts) <= {"no_change"}:
                return counts
            self._enqueue(changed, load)
            rows = self._buckets(self._load(incoming), changed)
            self._prune(scratch, changed, rows)
            self._replace(self._merged(changed, rows), "documents", "bucket")
        return counts

    def _merged(self, changed: DataFrame, rows: DataFrame) -> DataFrame:
        """The touched buckets after the load, by bucket. Texts are shuffled once, by the bucket in which they are written:
        there a key's rows meet, first the mark that it changed, then the load's, then the stored one."""
        names = [c.split()[0] for c in _DOCS.split(", ")]
        part = lambda df, role: df.select(*names, "extra", F.lit(role).alias("role"))
        there = {*KEYS, "bucket"}
        marks = changed.select(*[F.col(n) if n in there else F.lit(None).cast(t).alias(n) for n, t in (c.split() for c in _DOCS.split(", "))], F.lit(None).cast("long").alias("extra"))
        old = self._buckets(self.documents(), changed).withColumn("extra", F.lit(None).cast("long"))
        w = Window.partitionBy("bucket", *KEYS).orderBy(F.desc("role"), *map(F.desc, self._ORDER))
        every = part(marks, 2).unionByName(part(rows, 1)).unionByName(part(old, 0)).repartition("bucket")
        placed = every.withColumn("first", F.first("role").over(w)).withColumn("place", F.row_number().over(w))
        return placed.where("if(first = 2, place = 2, role = 0)").select(names)

    def _enqueue(self, changed: DataFrame, load: str) -> None:
        rows = changed.select(*KEYS, "content_hash", F.when(F.col("status") == "deleted", "delete").otherwise("upsert").alias("op"), F.lit("pending").alias("status"), F.lit(0).alias("attempts"), F.lit(load).alias("load"))
        with Scratch(self.spark) as scratch:
            earlier = self.queue().where(F.col("load") == load).select(rows.columns)
            both = scratch.stored(earlier.unionByName(rows).dropDuplicates([*KEYS, "content_hash", "op"]))
            self._replace(both.repartition("load"), "queue", "load")

    def _prune(self, scratch: Scratch, changed: DataFrame, rows: DataFrame) -> None:
        """Vectors of deleted documents and of chunks past the new text's."""
        plan = indexing.chunk_plan(rows.select(F.struct(*KEYS, *self._ORDER).alias("doc_id"), "content", "attributes")).select("doc_id.*", "n_chunks")
        same = lambda c: F.col(f"c.{c}").eqNullSafe(F.col(f"p.{c}")) if c in self._ORDER else F.col(f"c.{c}") == F.col(f"p.{c}")
        chosen = changed.alias("c").join(plan.alias("p"), [same(c) for c in (*KEYS, *self._ORDER)]).select("c.*", "n_chunks").dropDuplicates(KEYS)
        keep = chosen.select(*KEYS, "bucket", F.when(F.col("status") == "deleted", F.lit(0)).otherwise(F.col("n_chunks")).alias("keep"))
        old = self._buckets(self.points(), keep)
        left = old.join(keep.select(*KEYS, "keep"), KEYS, "left")
        over = scratch.stored(left.where("chunk_idx >= keep").select("bucket").distinct())
        # Buckets without a vector to take out stay as they are; one that loses all its vectors keeps none.
        touched = [r[0] for r in over.collect()]
        if touched:
            names = [c.split()[0] for c in _POINTS.split(", ")]
            rest = scratch.stored(left.where(F.col("bucket").isin(touched)).where("keep is null or chunk_idx < keep").select(names))
            empty = set(touched) - {r[0] for r in rest.select("bucket").distinct().collect()}
            self._replace(rest.repartition("bucket"), "points", "bucket")
            for b in empty:
                remove(self.spark, f"{self.path}/points/bucket={b}")

    def write_points(self, points: DataFrame) -> None:
        """Put vectors (tenant_id, external_ref, chunk_idx, vector): the same chunk is replaced."""
        with Scratch(self.spark) as scratch:
            new = scratch.stored(points.select(*KEYS, F.col("chunk_idx").cast("long").alias("chunk_idx"), F.col("vector").cast("array<float>").alias("vector")).dropDuplicates([*KEYS, "chunk_idx"]).withColumn("bucket", self._bucket()))
            old = self._buckets(self.points(), new).join(new.select(*KEYS, "chunk_idx"), [*KEYS, "chunk_idx"], "left_anti")
            names = [c.split()[0] for c in _POINTS.split(", ")]
            self._replace(old.select(names).unionByName(new.select(names)).repartition("bucket"), "points", "bucket")
