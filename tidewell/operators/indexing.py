"""The write path: content-hash upserts, chunk plans, vector upkeep, queue states and their digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions import stats, vectors

CHUNK, OVERLAP, SHORT = 512, 50, 200
MOST_ATTEMPTS, ERROR_LENGTH = 20, 4096
# Fixed value: the name space of URLs for name-based UUIDs.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def content_hash(title: Column, content: Column) -> Column:
    return F.sha2(F.concat_ws("\n", title, content), 256)


def upsert(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """tenant_id, external_ref, content_hash, status of each incoming row: no_change, updated or inserted."""
    old = stored.where("deleted_at is null").select("tenant_id", "external_ref", F.col("content_hash").alias("old_hash"), F.lit(True).alias("there"))
    joined = incoming.join(old, ["tenant_id", "external_ref"], "left")
    status = F.when(F.col("there").isNull(), "inserted").when(F.col("old_hash").eqNullSafe(F.col("content_hash")), "no_change").otherwise("updated")
    return joined.select("tenant_id", "external_ref", "content_hash", status.alias("status"))


def enqueue(upserts: DataFrame, op: str = "upsert") -> DataFrame:
    """A pending queue row for everything that changed."""
    return upserts.where("status <> 'no_change'").select("tenant_id", "external_ref", "content_hash", F.lit(op).alias("op"), F.lit("pending").alias("status"), F.lit(0).alias("attempts"))


def soft_delete(docs: DataFrame, ids: DataFrame, now: str) -> DataFrame:
    """doc_id, outcome and deleted_at of the asked ids: deleted, already_deleted or not_found."""
    joined = ids.select("doc_id").join(docs.select("doc_id", "deleted_at", F.lit(True).alias("there")), "doc_id", "left")
    outcome = F.when(F.col("there").isNull(), "not_found").when(F.col("deleted_at").isNotNull(), "already_deleted").otherwise("deleted")
    return joined.select("doc_id", outcome.alias("outcome"), F.when(F.col("there"), F.coalesce("deleted_at", F.lit(now).cast("timestamp_ntz"))).alias("deleted_at"))


# ---- chunks


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def chunk_plan(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, strategy, n_chunks, weights: windows for long contents, weighted sections or one text else."""
    n = F.size(words(F.col("content")))
    planned = docs.select("doc_id", n.alias("n_tokens"), F.try_variant_get(F.try_parse_json("attributes"), "$.abstract", "string").alias("abstract"))
    weights = F.when(F.col("strategy") == "weighted", F.when(F.col("abstract").isNotNull(), F.array(F.lit(3.0), F.lit(2.0), F.lit(1.0))).otherwise(F.array(F.lit(3.0), F.lit(1.0))))
    strategy = F.when(n_at_least(CHUNK), "multi").when(F.col("abstract").isNotNull() | n_at_least(SHORT), "weighted").otherwise("single")
    return planned.withColumn("strategy", strategy).select(
        "doc_id", "n_tokens", "strategy", F.when(F.col("strategy") == "multi", F.ceil(F.col("n_tokens") / (CHUNK - OVERLAP))).otherwise(1).cast("long").alias("n_chunks"), F.array_join(weights.cast("array<string>"), ",").alias("weights")
    )


def n_at_least(least: int) -> Column:
    return F.col("n_tokens") >= least


def chunk_windows(docs: DataFrame) -> DataFrame:
    """doc_id, chunk_idx, text of every window of the long contents."""
    cut = docs.select("doc_id", words(F.col("content")).alias("w")).where(F.size("w") >= CHUNK)
    at = cut.select("doc_id", "w", F.posexplode(F.sequence(F.lit(0), F.size("w") - 1, F.lit(CHUNK - OVERLAP))).alias("chunk_idx", "start"))
    return at.select("doc_id", "chunk_idx", F.array_join(F.slice("w", F.col("start") + 1, F.lit(CHUNK)), " ").alias("text"))


def point_id(doc: Column, chunk_idx: Column) -> Column:
    """The document's id for its first chunk, else the name-based UUID of "doc:chunk"."""
    h = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.concat_ws(":", doc, chunk_idx).cast("binary")))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1), F.lit(1))
    named = F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))
    return F.when(chunk_idx == 0, doc.cast("string")).otherwise(named)


def section_vectors(points: DataFrame) -> DataFrame:
    """doc_id, vector: sections weighted 3, 2, 1 in their order, scaled to length one."""
    gathered = points.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_idx", "vector"))).alias("s"))  # a document's sections, few
    weight = F.transform("s", lambda x: F.greatest(F.lit(1.0), 3.0 - x["chunk_idx"]))
    return gathered.select("doc_id", vectors.weighted_mean(F.transform("s", lambda x: F.transform(x["vector"], lambda v: v.cast("double"))), weight).alias("vector"))


def latest_points(points: DataFrame, *order: Column) -> DataFrame:
    """Upsert by id: of the rows with one point_id, the last in this order."""
    w = Window.partitionBy("point_id").orderBy(*order)
    return points.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def prune_chunks(points: DataFrame, keep: DataFrame) -> DataFrame:
    """Without the chunks at or past `keep` of their document; documents not named stay whole."""
    return points.join(keep.select("doc_id", "keep"), "doc_id", "left").where("keep is null or chunk_idx < keep").drop("keep")


def cache_misses(wanted: DataFrame, cache: DataFrame, negative: DataFrame, now: str) -> DataFrame:
    """Keys to compute: not held unexpired in the cache, and not held as failures."""
    fresh = lambda t: t.where(F.col("expires_at") > F.lit(now).cast("timestamp_ntz")).select("key")
    return wanted.select("key").distinct().join(fresh(cache), "key", "left_anti").join(fresh(negative), "key", "left_anti")


# ---- queue


def pending(outbox: DataFrame, now: str) -> DataFrame:
    return outbox.where("status in ('pending', 'failed')").where(F.col("next_retry_at") <= F.lit(now).cast("timestamp_ntz"))


def claim(outbox: DataFrame, now: str, batch: int = 500) -> DataFrame:
    """The next batch: due rows by their retry time, moved to in_progress."""
    return pending(outbox, now).orderBy("next_retry_at", "id").limit(batch).withColumn("status", F.lit("in_progress"))


def settle(outbox: DataFrame, ok: Column, error: Column) -> DataFrame:
    """After an attempt: done, or failed with a backoff, or dead once the attempts are used up."""
    attempts = F.when(ok, F.col("attempts")).otherwise(F.col("attempts") + 1)
    return outbox.select(
        "id", F.when(ok, "done").when(attempts >= MOST_ATTEMPTS, "dead").otherwise("failed").alias("status"), attempts.alias("attempts"),
        F.when(~ok, F.substring(error, 1, ERROR_LENGTH)).alias("last_error"), F.when(~ok & (attempts < MOST_ATTEMPTS), stats.backoff(F.col("attempts"))).alias("delay_s"),
    )


def error_type(error: Column) -> Column:
    """For the digest; the first that fits."""
    has = lambda *ws: F.lower(error).rlike("|".join(ws))
    return F.when(has("qdrant", "timeout"), "qdrant_unavailable").when(has("embedding", "model"), "embedding_failed").when(has("payload", "validation"), "payload_invalid").otherwise("other")


def error_class(error: Column) -> Column:
    """For the worker; the first that fits."""
    has = lambda *ws: F.lower(error).rlike("|".join(ws))
    return F.when(has("timeout"), "timeout").when(has("unavailable", "connection", "refused"), "unavailable").when(has("valid", "payload"), "invalid").otherwise("other")


def dead_digest(outbox: DataFrame, samples: int = 10) -> DataFrame:
    """Dead rows by tenant, model and error type, with the latest samples.

    The samples are ranked and cut before they are gathered, so a hot group never comes together whole.
    """
    keys = ["tenant_id", "model_name", "error_type"]
    dead = outbox.where("status = 'dead'").withColumn("error_type", error_type(F.col("last_error")))
    counts = dead.groupBy(*keys).agg(F.count("*").alias("n"), F.min("updated_at").alias("first_seen"), F.max("updated_at").alias("last_seen"))
    w = Window.partitionBy(*keys).orderBy(F.desc("updated_at"), F.desc("id"))
    top = dead.withColumn("r", F.row_number().over(w)).where(F.col("r") <= samples).groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "document_id"))), lambda x: x["document_id"].cast("string")), ",").alias("sample_doc_ids"))
    return counts.join(top, keys)


def merge_digest(before: DataFrame, new: DataFrame, samples: int = 10) -> DataFrame:
    """Counts added, first seen kept, last seen moved on, earlier samples before later ones."""
    keys = ["tenant_id", "model_name", "error_type"]
    old = before.select(*keys, *[F.col(c).alias(f"o_{c}") for c in ("n", "first_seen", "last_seen", "sample_doc_ids")])
    joined = old.join(new, keys, "full")
    ids = F.slice(F.filter(F.split(F.concat_ws(",", "o_sample_doc_ids", "sample_doc_ids"), ","), lambda s: s != ""), 1, samples)
    return joined.select(*keys, (F.coalesce("o_n", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("n"), F.coalesce("o_first_seen", "first_seen").alias("first_seen"), F.coalesce("last_seen", "o_last_seen").alias("last_seen"), F.array_join(ids, ",").alias("sample_doc_ids"))


def outbox_counts(outbox: DataFrame, now: str) -> DataFrame:
    at = F.lit(now).cast("timestamp_ntz")
    open_, due = F.col("status").isin("pending", "failed"), F.col("next_retry_at")
    age = F.timestamp_diff("SECOND", F.min(F.when(open_, F.col("created_at"))), at)
    return outbox.agg(
        F.count_if(open_ & (due <= at)).alias("pending"), F.count_if(F.col("status").isin("pending", "failed", "in_progress") & (due <= at + F.expr("INTERVAL 1 MINUTE"))).alias("near_due"),
        F.count_if(F.col("status") == "dead").alias("dead"), F.coalesce(age, F.lit(0)).cast("long").alias("oldest_s"),
    )


def throttle(n: Column, slow: int = 50_000, stop: int = 100_000) -> Column:
    return F.when(n > stop, "reindex").when(n > slow, "throttled").otherwise("normal")


def latest_status(outbox: DataFrame) -> DataFrame:
    """document_id and the status that a client sees: all that is not done or dead counts as pending."""
    last = outbox.groupBy("document_id").agg(F.max_by("status", F.struct("updated_at", "id")).alias("raw"))
    return last.select("document_id", "raw", F.when(F.col("raw").isin("done", "dead"), F.col("raw")).otherwise("pending").alias("status"))


def doc_counts(docs: DataFrame) -> DataFrame:
    return docs.where("deleted_at is null").groupBy("tenant_id").agg(F.count("*").alias("doc_count"))


def running_average(before: DataFrame, searches: DataFrame) -> DataFrame:
    """tenant_id, avg_query_len, total_searches: the stored mean carried on in closed form."""
    new = searches.groupBy("tenant_id").agg(F.sum(F.length("query_text")).alias("s"), F.count("*").alias("c"))
    total = F.coalesce("total_searches", F.lit(0)) + F.coalesce("c", F.lit(0))
    mean = (F.coalesce("avg_query_len", F.lit(0.0)) * F.coalesce("total_searches", F.lit(0)) + F.coalesce("s", F.lit(0))) / total
    return before.join(new, "tenant_id", "full").select("tenant_id", F.round(mean, 6).alias("avg_query_len"), total.alias("total_searches"))


def get_or_create(stored: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Stored rows and those wanted whose key isn't there yet."""
    return stored.unionByName(wanted.dropDuplicates([key]).join(stored.select(key), key, "left_anti"), allowMissingColumns=True)


def violations(docs: DataFrame, outbox: DataFrame) -> DataFrame:
    """check, n: what the tables' constraints would refuse."""
    duplicate = docs.groupBy("tenant_id", "doc_id").count().where("count > 1").agg(F.count("*").alias("n")).select(F.lit("duplicate_key").alias("check"), "n")
    enum = outbox.where("op not in ('upsert', 'delete') or status not in ('pending', 'in_progress', 'done', 'failed', 'dead')").agg(F.count("*").alias("n")).select(F.lit("bad_enum").alias("check"), "n")
    orphan = outbox.select("document_id").join(docs.select(F.col("doc_id").alias("document_id")), "document_id", "left_anti").agg(F.count("*").alias("n")).select(F.lit("orphan_queue_row").alias("check"), "n")
    return duplicate.unionByName(enum).unionByName(orphan)
