"""What stands around search and indexing: models, embedding through caches, the reconciler, evaluation runs, migrations."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType

from tidewell.functions import text as X
from tidewell.functions import vectors as V
from tidewell.operators import indexing
from tidewell.operators.search import live, small
from tidewell.sources.scratch import stored

#: Seconds that entries live: contents, queries, failures (and how far those are spread).
CONTENT_TTL, QUERY_TTL, NEGATIVE_TTL, JITTER = 30 * 86400, 3600, 60, 10
MOST_LENGTH, DIMENSIONS = 512, 16


# ---- models


def default_model(models: DataFrame) -> DataFrame:
    """The model that new content is embedded with: one row, or none."""
    return models.where("is_default").select("model_name").orderBy("model_name").limit(1)


# ---- keys, vectors as bytes


def normalized_query(query: Column) -> Column:
    return F.lower(X.nfc(query))


def content_key(digest: Column, model: Column) -> Column:
    return F.concat(F.lit("hash:"), digest, F.lit(":"), model)


def query_key(query: Column, model: Column, kind: str = "qemb") -> Column:
    """qemb:model:digest of a normalised query; kind "neg" for those that can't be embedded."""
    return F.concat(F.lit(f"{kind}:"), model, F.lit(":"), F.sha2(query, 256))


def too_long(query: Column, most: int = MOST_LENGTH) -> Column:
    return F.length(query) > 2 * most


@F.pandas_udf(BinaryType())
def to_bytes(vector: pd.Series) -> pd.Series:
    """Little-endian 32-bit floats."""
    import numpy as np

    return vector.map(lambda v: None if v is None else np.asarray(v, dtype="<f4").tobytes())


@F.pandas_udf(ArrayType(FloatType()))
def from_bytes(data: pd.Series) -> pd.Series:
    import numpy as np

    return data.map(lambda b: None if b is None else np.frombuffer(b, dtype="<f4").tolist())


# ---- embedding


def token_embedding(text: Column) -> Column:
    """A plain model in a real one's place: counts of tokens by a digit of their digest, scaled to length one."""
    kinds = F.transform(X.tokens(text), lambda t: F.conv(F.substring(F.md5(t), 1, 1), 16, 10).cast("int"))
    count = lambda ks: lambda i: F.size(F.filter(ks, lambda k: k == i)).cast("double")
    return V.unit(V.let(kinds, lambda ks: F.transform(F.sequence(F.lit(0), F.lit(DIMENSIONS - 1)), count(ks))))


def embed_texts(texts: DataFrame, embed=token_embedding, column: str = "text") -> DataFrame:
    """texts with `vector`. embed(text) gives a column: an expression, or a pandas UDF around a model, which must give a
    vector for each text; a null one fails the query, as fewer vectors than texts would."""
    missing = F.raise_error(F.lit("fewer vectors than texts")).cast("array<double>")
    return texts.withColumn("vector", V.let(embed(F.col(column)), lambda v: F.when(v.isNull() & F.col(column).isNotNull(), missing).otherwise(v)))


def embed_cached(wanted: DataFrame, cache: DataFrame, negative: DataFrame, now: str, embed=token_embedding) -> DataFrame:
    """key, outcome, vector of each distinct key: hit, negative, failed (a vector without length or with components that
    aren't finite) or computed. Only what neither holds is embedded; of texts under one key the smallest counts."""
    at = F.lit(now).cast("timestamp_ntz")
    fresh = lambda t, *c: t.where(F.col("expires_at") > at).select("key", *c)
    keys = wanted.groupBy("key").agg(F.min("text").alias("text"))
    known = keys.join(fresh(cache, F.col("vector").alias("held")), "key", "left").join(fresh(negative, F.lit(True).alias("barred")).distinct(), "key", "left")
    bad = lambda v: ~F.coalesce(V.finite(v), F.lit(False)) | (V.norm(v) == 0)
    result = lambda outcome, vector: F.struct(F.lit(outcome).alias("outcome"), vector.cast("array<double>").alias("vector"))
    none = F.lit(None)
    tried = V.let(embed(F.col("text")), lambda v: F.when(bad(v), result("failed", none)).otherwise(result("computed", v)))
    done = F.when(F.col("held").isNotNull(), result("hit", F.col("held"))).when(F.col("barred"), result("negative", none)).otherwise(tried)
    return known.select("key", done.alias("r")).select("key", "r.outcome", "r.vector")


def cache_rows(embedded: DataFrame, now: str, ttl: int = CONTENT_TTL) -> tuple[DataFrame, DataFrame]:
    """Rows to add to the cache and to the failures, with when they expire; failures are spread by their key.

    What was embedded is written first: a filter on the outcome would reach down and embed each text again."""
    embedded = stored(embedded)
    at = F.lit(now).cast("timestamp_ntz")
    spread = F.conv(F.substring(F.md5("key"), 1, 4), 16, 10).cast("int") % (2 * JITTER + 1) - JITTER
    later = lambda seconds: at + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))
    return (
        embedded.where("outcome = 'computed'").select("key", "vector", later(F.lit(ttl)).alias("expires_at")),
        embedded.where("outcome = 'failed'").select("key", later(spread + NEGATIVE_TTL).alias("expires_at")),
    )


def embed_queries(requests: DataFrame, cache: DataFrame, negative: DataFrame, model: str, now: str, embed=token_embedding, most: int = MOST_LENGTH) -> DataFrame:
    """query_id, outcome, vector: the query normalised, failures first, then the length, then the cache, then the model."""
    text = requests.select("query_id", X.nfc("query").alias("text"))
    keyed = text.withColumn("key", query_key(F.col("text"), F.lit(model)))
    short = keyed.where(~too_long(F.col("text"), most))
    done = embed_cached(short, cache, negative, now, embed)
    return keyed.join(done, "key", "left").select("query_id", F.coalesce("outcome", F.lit("too_long")).alias("outcome"), "vector")


# ---- points and the reconciler


def point_payload(points: DataFrame, docs: DataFrame, dimensions: int = 64) -> DataFrame:
    """What is stored beside each vector. Points of deleted or unknown documents, and vectors of another length or with
    components that aren't finite, are refused."""
    held = live(docs).select("doc_id", "tenant_id", "language", "tags", indexing.content_hash(F.col("title"), F.col("content")).alias("content_hash"))
    ok = (F.size("vector") == dimensions) & V.finite(F.col("vector"))
    return points.where(ok).join(held, "doc_id").select("point_id", "doc_id", "chunk_idx", "model_name", "tenant_id", "language", F.array_join("tags", ",").alias("tags"), "content_hash")


def document_vectors(queue: DataFrame, models: DataFrame, cache: DataFrame) -> DataFrame:
    """id, source of the vector of each queued upsert: none without an active model, else the cache or the model."""
    active = models.where("is_active").select("model_name", F.lit(True).alias("active"))
    held = cache.select(F.col("doc_id").alias("document_id"), F.lit(True).alias("held")).distinct()
    joined = queue.where("op = 'upsert'").join(small(active), "model_name", "left").join(held, "document_id", "left")
    return joined.select("id", F.when(F.col("active").isNull(), "unknown_model").when(F.col("held"), "cache").otherwise("embed").alias("source"))


def reconcile(docs: DataFrame, stored: DataFrame, collections: list[str]) -> DataFrame:
    """doc_id, action, n_chunks, collection: a document whose stored hash is the same is skipped; others are cut into
    chunks, embedded and written to every collection, their later chunks pruned to n_chunks."""
    plan = indexing.chunk_plan(docs).select("doc_id", "n_chunks")
    fresh = docs.select("doc_id", indexing.content_hash(F.col("title"), F.col("content")).alias("content_hash"))
    old = stored.select("doc_id", F.col("content_hash").alias("old_hash"))
    same = F.col("old_hash").eqNullSafe(F.col("content_hash"))
    joined = fresh.join(old, "doc_id", "left").join(plan, "doc_id").withColumn("action", F.when(same, "skip").otherwise("index"))
    targets = F.when(same, F.array(F.lit(None).cast("string"))).otherwise(F.array(*map(F.lit, collections)))
    return joined.select("doc_id", "action", F.when(~same, F.col("n_chunks")).alias("n_chunks"), F.explode(targets).alias("collection"))


def has_rows(asked: DataFrame, rows: DataFrame, *keys: str) -> DataFrame:
    """asked with `found`: whether any row has its keys. Keys are made distinct before they meet."""
    return asked.join(rows.select(*keys).distinct().withColumn("found", F.lit(True)), list(keys), "left").withColumn("found", F.coalesce("found", F.lit(False)))


def merge_doc_counts(before: DataFrame, counted: DataFrame) -> DataFrame:
    """tenant_id, doc_count: what was counted now, and what is stored for tenants that weren't."""
    return before.select("tenant_id", F.col("doc_count").alias("old")).join(counted, "tenant_id", "full").select("tenant_id", F.coalesce("doc_count", "old").alias("doc_count"))


def cardinalities(tables: dict[str, DataFrame], most: int | None = None) -> DataFrame:
    """name, n of several tables in one plan; with `most`, no more rows of a table are read than that."""
    out = None
    for name, rows in tables.items():
        counted = (rows if most is None else rows.limit(most)).agg(F.lit(name).alias("name"), F.count("*").alias("n"))
        out = counted if out is None else out.unionByName(counted)
    return out


# ---- evaluation runs


def register(stored: DataFrame, wanted: DataFrame, key: str = "dataset") -> DataFrame:
    """Datasets by name, those not there yet added."""
    return indexing.get_or_create(stored, wanted, key)


def latest_runs(runs: DataFrame) -> DataFrame:
    """The newest run of each dataset and strategy: the baseline of the next."""
    last = runs.groupBy("dataset", "strategy").agg(F.max_by(F.struct("run_at", "recall", "ndcg"), "run_at").alias("r"))
    return last.select("dataset", "strategy", "r.*")


def newest_runs(runs: DataFrame, most: int = 10) -> DataFrame:
    """The list of the last runs, newest first: the report's feature."""
    return runs.orderBy(F.desc("run_at"), "dataset", "strategy").limit(most)


def seed_corpus(judgments: DataFrame, fillers: int) -> DataFrame:
    """Judged documents, their content the queries that name them, and fillers of which every tenth is of a rare category."""
    spark = judgments.sparkSession
    judged = judgments.select("query", F.explode("relevant_doc_ids").alias("ref")).groupBy("ref").agg(F.array_join(F.array_sort(F.collect_set("query")), "\n").alias("content"))
    judged = judged.select("ref", "content", F.lit("judged").alias("category"), F.lit("normal").alias("priority"))
    i = F.col("id")
    common = F.element_at(F.array(*map(F.lit, ("general", "support", "billing", "internal"))), (i % 4 + 1).cast("int"))
    filler = spark.range(fillers).select(F.concat(F.lit("filler-"), i).alias("ref"), F.concat(F.lit("filler text "), i).alias("content"), F.when(i % 10 == 0, "ML").otherwise(common).alias("category"), F.when(i % 5 == 0, "high").otherwise("normal").alias("priority"))
    return judged.unionByName(filler)


# ---- migrations
UNFINISHED = ("init", "canary_passed", "canary_failed", "backfilled")


def begin(migrations: DataFrame, suffix: str = "_new") -> DataFrame:
    """base, accepted, collection for a new migration of each base: none may be unfinished; the name is the base with
    the suffix, then _v2, _v3 and so on, the first that isn't taken."""
    taken = migrations.groupBy("base").agg(F.max(F.col("status").isin(*UNFINISHED)).alias("running"), F.collect_set("collection").alias("taken"))  # a base's collections, few
    names = F.concat(F.array(F.concat("base", F.lit(suffix))), F.transform(F.sequence(F.lit(2), F.size("taken") + 2), lambda k: F.concat(F.col("base"), F.lit("_v"), k)))
    free = F.element_at(F.filter(names, lambda n: ~F.array_contains("taken", n)), 1)
    return taken.select("base", (~F.col("running")).alias("accepted"), F.when(~F.col("running"), free).alias("collection"))


def latest_promoted(migrations: DataFrame) -> DataFrame:
    """base, collection, promoted_at of the migration that was promoted last."""
    last = migrations.where("promoted_at is not null").groupBy("base").agg(F.max_by(F.struct("collection", "promoted_at", "migration_id"), F.struct("promoted_at", "migration_id")).alias("m"))
    return last.select("base", "m.collection", "m.promoted_at")


def dual_write(migrations: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, collection: each document once for its base and once for the collection promoted last, where there is one."""
    goals = latest_promoted(migrations).select("base", F.explode(F.array("base", "collection")).alias("collection"))
    return docs.join(small(goals), "base").select("doc_id", "collection")


def migration_status(migrations: DataFrame) -> DataFrame:
    share = F.when(F.col("total") > 0, F.round(100 * F.col("backfilled") / F.col("total"), 4)).otherwise(F.lit(0.0))
    return migrations.select("migration_id", "status", share.alias("percent"), F.col("status").isin(*UNFINISHED).alias("running"), F.col("snapshot_key").isNotNull().alias("snapshot"))


def snapshots(migrations: DataFrame, base: str) -> DataFrame:
    """The snapshots of a base, newest first."""
    return migrations.where((F.col("base") == base) & F.col("snapshot_key").isNotNull()).select("snapshot_key", "made_at").withColumn("place", F.row_number().over(Window.partitionBy().orderBy(F.desc("made_at"), "snapshot_key")))


def drift_rows(df: DataFrame, declared: dict[str, str]) -> DataFrame:
    """name, declared, found of the columns whose types differ, are missing or weren't declared."""
    found = dict(df.dtypes)
    rows = [(k, declared.get(k), found.get(k)) for k in sorted(declared.keys() | found.keys()) if declared.get(k) != found.get(k)]
    return df.sparkSession.createDataFrame(rows, "name string, declared string, found string")
