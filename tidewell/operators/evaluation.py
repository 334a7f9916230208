"""Offline relevance, the regression gate, and checks of a model migration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions import vectors

JUDGMENTS = "query_id string, query string, tenant_id string, relevant_doc_ids array<string>, language string"


def load_judgments(spark, path: str) -> DataFrame:
    """Judgments from JSON lines; a bad line fails the read, blank lines don't count."""
    return spark.read.schema(JUDGMENTS).option("mode", "FAILFAST").json(path)


def dataset_errors(judgments: DataFrame) -> DataFrame:
    """query_id and the first thing that is missing, null where nothing is."""
    empty = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    reason = F.when(empty("query_id"), "query_id").when(empty("query"), "query").when(empty("tenant_id"), "tenant_id").when(F.coalesce(F.size("relevant_doc_ids") <= 0, F.lit(True)), "relevant_doc_ids")
    return judgments.select("query_id", reason.alias("missing"))


def dataset_stats(judgments: DataFrame) -> DataFrame:
    """One row over judgments counted by query (query_id, n, language, tenant_id)."""
    return judgments.agg(
        F.count("*").alias("queries"), F.sum("n").alias("relevant"), F.round(F.avg("n"), 6).alias("avg_relevant"),
        F.array_join(F.array_sort(F.collect_set("language")), ",").alias("languages"), F.countDistinct("tenant_id").alias("tenants"),
    )


def relevance(hits: DataFrame, judged: DataFrame, k: int = 10, totals: DataFrame | None = None) -> DataFrame:
    """query_id, recall, ndcg, mrr at k of the queries that have judgments. judged: (query_id, doc_id), all of them, or
    those among the hits together with totals (query_id, total)."""
    total = judged.groupBy("query_id").agg(F.countDistinct("doc_id").alias("total")) if totals is None else totals
    good = hits.where(F.col("rank") <= k).join(judged.select("query_id", "doc_id").distinct(), ["query_id", "doc_id"], "left_semi")
    gained = good.groupBy("query_id").agg(F.count("*").alias("found"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"), F.min("rank").alias("first"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("total", F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    joined = total.join(gained, "query_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return joined.select("query_id", F.round(zero(F.col("found") / F.col("total")), 6).alias("recall"), F.round(zero(F.col("dcg") / ideal), 6).alias("ndcg"), F.round(zero(1 / F.col("first")), 6).alias("mrr"))


def summary(scores: DataFrame, *keys: str) -> DataFrame:
    return scores.groupBy(*keys).agg(*[F.round(F.avg(m), 5).alias(m) for m in ("recall", "ndcg", "mrr")], F.count("*").alias("queries"))


def worst(scores: DataFrame, n: int = 3) -> DataFrame:
    """The n queries of least recall of each strategy: the report's feature."""
    w = Window.partitionBy("strategy").orderBy("recall", "query_id")
    return scores.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def gate(runs: DataFrame, recall_drop: float = 0.02, ndcg_drop: float = 0.01) -> DataFrame:
    """Each run against the one before of its dataset and strategy; a drop beyond the bounds blocks a release."""
    w = Window.partitionBy("dataset", "strategy").orderBy("run_at")
    # Rounded, so that a drop of just the bound isn't one for the last digit's sake.
    lost = lambda m: F.round(F.lag(m).over(w) - F.col(m), 9)
    regressed = F.coalesce((lost("recall") > recall_drop) | (lost("ndcg") > ndcg_drop), F.lit(False))
    return runs.withColumn("regression", regressed).withColumn("release_blocked", regressed)


def sample(docs: DataFrame, share: float, most: int = 5000) -> DataFrame:
    """A repeatable sample by hash, at least one row: n = max(1, share of all), `most` at most."""
    n = max(1, min(most, int(docs.count() * share)))
    return docs.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(n)


def canary(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row: similarity of old and new vectors of the same documents, and whether the new model may go on."""
    both = old.select("doc_id", F.col("vector").alias("a")).join(new.select("doc_id", F.col("vector").alias("b")), "doc_id")
    found = both.select(vectors.cosine(F.col("a"), F.col("b")).alias("c")).agg(F.round(F.avg("c"), 6).alias("avg_similarity"), F.round(F.min("c"), 6).alias("min_similarity"), F.round(F.max("c"), 6).alias("max_similarity"), F.count("*").alias("n"))
    return found.withColumn("passed", (F.col("min_similarity") >= 0.6) & (F.col("avg_similarity") <= 0.95))


def backfill(docs: DataFrame, batch: int = 1000) -> DataFrame:
    """batch, n, first_id, last_id of a backfill in order of the id.

    Batches are numbered within ranges of ids and the ranges' counts are summed, so no task sees all rows.
    """
    spans = docs.select("doc_id", F.floor(F.col("doc_id") / (16 * batch)).alias("span"))
    counts = spans.groupBy("span").agg(F.count("*").alias("n"))
    ahead = counts.select("span", F.coalesce(F.sum("n").over(Window.orderBy("span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    numbered = spans.join(ahead, "span").withColumn("r", F.row_number().over(Window.partitionBy("span").orderBy("doc_id")) + F.col("ahead"))
    return numbered.groupBy(F.floor((F.col("r") - 1) / batch).alias("batch")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))


def progress(log: DataFrame) -> DataFrame:
    """Speed between two reports, in documents an hour."""
    w = Window.partitionBy("migration_id").orderBy("at")
    seconds = F.timestamp_diff("SECOND", F.lag("at").over(w), F.col("at"))
    return log.select("migration_id", "processed", F.when(seconds > 0, F.round((F.col("processed") - F.lag("processed").over(w)) / seconds * 3600, 4)).alias("docs_per_hour"))


#: From which states a step of a migration may start, and where it leads.
STEPS = {"canary": (("init", "canary_failed"), "canary_passed"), "snapshot": (("canary_passed",), "canary_passed"), "backfill": (("canary_passed",), "backfilled"), "promote": (("backfilled",), "promoted"), "rollback": (("promoted",), "rolled_back"), "cleanup": (("promoted",), "cleaned")}


def advance(migrations: DataFrame, step: Column) -> DataFrame:
    """migration_id, status, accepted: the state after a step, unchanged where the step isn't allowed."""
    target, allowed = F.lit(None).cast("string"), F.lit(False)
    for name, (starts, goal) in STEPS.items():
        target = F.when(step == name, F.lit(goal)).otherwise(target)
        allowed = F.when(step == name, F.col("status").isin(*starts)).otherwise(allowed)
    guard = F.when(step == "promote", F.col("snapshot_key").isNotNull() & (F.col("backfilled") >= F.col("total"))).otherwise(F.lit(True))
    ok = allowed & guard
    return migrations.select("migration_id", F.when(ok, target).otherwise(F.col("status")).alias("status"), ok.alias("accepted"))


def cleanup_allowed(migrations: DataFrame, now: str, force: bool = False) -> DataFrame:
    late = F.col("promoted_at") + F.expr("INTERVAL 7 DAYS") <= F.lit(now).cast("timestamp_ntz")
    return migrations.select("migration_id", ((F.col("status") == "promoted") & (F.lit(force) | F.coalesce(late, F.lit(False)))).alias("allowed"))


def write_targets(docs: DataFrame, collections: list[str]) -> DataFrame:
    """Each document once for every collection that is written."""
    return docs.select("doc_id", F.explode(F.array(*map(F.lit, collections))).alias("collection"))


def drift(declared: dict, found: dict) -> list[str]:
    """Names of the settings that differ, are missing or were not declared."""
    return sorted(k for k in declared.keys() | found.keys() if declared.get(k) != found.get(k))
