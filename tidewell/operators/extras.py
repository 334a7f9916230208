"""Ranking and tenancy features that stand beside the core path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.operators.search import MOST_K, ranked


def history_boost(hits: DataFrame, docs: DataFrame, clicks: DataFrame, requests: DataFrame, weight: float = 0.1) -> DataFrame:
    """Scores raised by weight * the share of the user's clicks in the document's category."""
    category = F.try_variant_get(F.try_parse_json("attributes"), "$.category", "string")
    named = docs.select("doc_id", category.alias("category"))
    per = clicks.select("user_id", F.col("clicked_doc_id").alias("doc_id")).join(named, "doc_id").groupBy("user_id", "category").agg(F.count("*").alias("c"))
    total = per.groupBy("user_id").agg(F.sum("c").alias("all"))
    shares = per.join(total, "user_id").select("user_id", "category", (F.col("c") / F.col("all")).alias("share"))
    joined = hits.select("query_id", "doc_id", "score").join(requests.select("query_id", "user_id"), "query_id").join(named, "doc_id").join(shares, ["user_id", "category"], "left")
    return ranked(joined.select("query_id", "doc_id", F.round(F.col("score") * (1 + weight * F.coalesce("share", F.lit(0.0))), 9).alias("score")), MOST_K, F.desc("score"), F.col("doc_id"))


def rank_features(lexical: DataFrame, vector: DataFrame, docs: DataFrame) -> DataFrame:
    """A row a candidate with what a learned ranker would be fed."""
    lex = lexical.select("query_id", "doc_id", F.col("score").alias("lexical_score"), F.col("rank").alias("lexical_rank"))
    vec = vector.select("query_id", "doc_id", F.col("score").alias("vector_score"), F.col("rank").alias("vector_rank"))
    return lex.join(vec, ["query_id", "doc_id"], "full").join(docs.select("doc_id", F.length("content").alias("length"), F.size("tags").alias("n_tags")), "doc_id").fillna(0.0, ["lexical_score", "vector_score"]).fillna(0, ["lexical_rank", "vector_rank"])


def tier(doc_count: Column, searches: Column) -> Column:
    return F.when((doc_count > 1_000_000) | (searches > 100_000), "A").when((doc_count > 10_000) | (searches > 1_000), "B").otherwise("C")


def user_stats(events: DataFrame, cutoff: str) -> DataFrame:
    """What stays of a user's events older than the cutoff."""
    old = events.where(F.col("created_at") < F.lit(cutoff).cast("timestamp_ntz")).where("kind is not null")
    return old.groupBy("user_id").agg(F.count_if(F.col("kind") == "search").alias("searches"), F.count_if(F.col("kind") == "click").alias("clicks"), F.max("created_at").alias("last_seen"))


def hit_rate(lookups: DataFrame, *keys: str) -> DataFrame:
    return lookups.groupBy(*keys).agg(F.count("*").alias("lookups"), F.round(F.avg(F.col("hit").cast("double")), 6).alias("hit_rate"))


def health(n: Column, ok: int = 1000, degraded: int = 10_000) -> Column:
    return F.when(n < ok, "ok").when(n < degraded, "degraded").otherwise("fail")


def overall(states: DataFrame) -> DataFrame:
    """One row: the worst state, and how many aren't ok."""
    order = F.when(F.col("state") == "ok", 0).when(F.col("state") == "degraded", 1).otherwise(2)
    return states.agg(F.element_at(F.array(F.lit("ok"), F.lit("degraded"), F.lit("fail")), F.max(order) + 1).alias("overall"), F.count_if(F.col("state") != "ok").alias("not_ok"))


def export(profiles: DataFrame, path: str) -> DataFrame:
    """Profiles as JSON lines, one a user, and read back."""
    profiles.write.mode("errorifexists").json(path)
    return profiles.sparkSession.read.schema(profiles.schema).json(path)
