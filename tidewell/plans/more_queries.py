"""Files, tenancy, profiles' upkeep and ranking features as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.operators import evaluation, extras, indexing, profiles
from tidewell.operators import events as E
from tidewell.operators import search as S
from tidewell.sources import files
from tidewell.sources import tables as T
from tidewell.sources.scratch import folder
from tidewell.sources.tables import DOCS, EVENTS

from .event_queries import _EV, _STARTS, experiments, log
from .registry import query
from .search_queries import _EVERY, channels, every_vectors


@query("SELECT event_id, strftime(ts, '%Y-%m-%d') AS event_date FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-08'")
def archive_read(spark, sf):
    """The log written by day, three days read back."""
    path = f"{folder(spark)}/log"
    files.write_daily(T.events(spark, sf), path)
    return files.read_days(spark, path, "2024-01-05", "2024-01-07").select("event_id", "event_date")


@query("SELECT event_type, count(*) AS n, 'search-events/20240110.parquet' AS archive_key FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-11' GROUP BY event_type")
def event_archive(spark, sf):
    """The log appended by day, and one day of it read alone under its key."""
    path = folder(spark, "archive")
    E.archive(T.events(spark, sf), path)
    day = spark.read.parquet(path).where(F.col("event_date") == F.lit("2024-01-10").cast("date"))
    return day.groupBy("event_type").agg(F.count("*").alias("n")).withColumn("archive_key", F.lit("search-events/20240110.parquet"))


@query("SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS day FROM events WHERE ts >= TIMESTAMP '2024-01-15'")
def archive_retention(spark, sf):
    """Days before the 15th dropped from a written log; what is left."""
    path = f"{folder(spark)}/log"
    files.write_daily(T.events(spark, sf), path)
    files.drop_before(spark, path, "2024-01-15")
    return files.partitions(spark, path)


@query(f"WITH {DOCS} SELECT CAST(doc_id AS VARCHAR) AS query_id, CASE WHEN trim(title) = '' THEN 'query' END AS missing FROM docs")
def judgment_files(spark, sf):
    """Judgments written as JSON lines, read back under a schema that fails on bad lines, and validated."""
    path = f"{folder(spark)}/judgments"
    rows = T.documents(spark, sf).select(F.col("doc_id").cast("string").alias("query_id"), F.col("title").alias("query"), "tenant_id", F.array(F.col("doc_id").cast("string")).alias("relevant_doc_ids"), "language")
    files.write_judgments(rows, path)
    return evaluation.dataset_errors(evaluation.load_judgments(spark, path))


@query("SELECT vec_id AS point_id, label FROM embeddings")
def snapshot_restore(spark, sf):
    return spark.read.parquet(files.snapshot(T.points(spark, sf), folder(spark), "v1")).select("point_id", "label")


@query(f"""WITH {DOCS}, {EVENTS}, d AS (SELECT tenant_id, count(*) AS n FROM docs GROUP BY tenant_id), s AS (SELECT 'src' || (user_id % 20) AS tenant_id, count(*) AS c FROM ev WHERE kind = 'search' GROUP BY 1)
SELECT tenant_id, n AS doc_count, coalesce(c, 0) AS searches, CASE WHEN n > 1000000 OR c > 100000 THEN 'A' WHEN n > 10000 OR c > 1000 THEN 'B' ELSE 'C' END AS tier FROM d LEFT JOIN s USING (tenant_id)""")
def tenant_tiers(spark, sf):
    docs = T.documents(spark, sf).groupBy("tenant_id").agg(F.count("*").alias("doc_count"))
    searches = T.events(spark, sf).where("kind = 'search'").groupBy(F.concat(F.lit("src"), F.col("user_id") % 20).alias("tenant_id")).agg(F.count("*").alias("searches"))
    return docs.join(searches, "tenant_id", "left").fillna(0).withColumn("tier", extras.tier(F.col("doc_count"), F.col("searches")))


@query(f"WITH {EVENTS} SELECT user_id, count(*) FILTER (WHERE kind = 'search') AS searches, count(*) FILTER (WHERE kind = 'click') AS clicks, max(created_at) AS last_seen FROM ev WHERE created_at < TIMESTAMP '2024-01-15' AND kind IS NOT NULL GROUP BY user_id")
def user_stats(spark, sf):
    return extras.user_stats(T.events(spark, sf), "2024-01-15 00:00:00")


_BOOST = """cl AS (SELECT user_id, category, count(*) AS c FROM ev JOIN docs ON docs.doc_id = clicked_doc_id WHERE kind = 'click' GROUP BY ALL), sh AS (SELECT user_id, category, c / sum(c) OVER (PARTITION BY user_id) AS share FROM cl),
hb AS (SELECT query_id, rrf.doc_id, round(rrf.score * (1 + 0.1 * coalesce(share, 0)), 9) AS score FROM rrf JOIN docs USING (doc_id) LEFT JOIN sh ON sh.user_id = query_id % 150 AND sh.category = docs.category)"""


@query(f"WITH {_EVERY}, {EVENTS}, {_BOOST} SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM hb")
def history_boost(spark, sf):
    docs, requests, lex, vec = channels(spark, sf, every_vectors)
    clicks = T.events(spark, sf).where("kind = 'click'")
    return extras.history_boost(S.rrf(lex, vec), docs, clicks, requests.withColumn("user_id", F.col("query_id") % 150))


@query(f"""WITH {_EVERY} SELECT query_id, doc_id, coalesce(l.score, 0) AS lexical_score, coalesce(l.rank, 0) AS lexical_rank, coalesce(v.score, 0) AS vector_score, coalesce(v.rank, 0) AS vector_rank, len(content) AS length, len(tags) AS n_tags
FROM lex l FULL JOIN vec v USING (query_id, doc_id) JOIN docs USING (doc_id)""")
def rank_features(spark, sf):
    docs, _, lex, vec = channels(spark, sf, every_vectors)
    return extras.rank_features(lex, vec, docs)


@query(f"WITH {EVENTS} SELECT tenant_id, count(*) AS lookups, round(avg(CASE WHEN k % 3 > 0 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate FROM ev GROUP BY tenant_id")
def cache_hit_rate(spark, sf):
    return extras.hit_rate(T.events(spark, sf).withColumn("hit", F.col("k") % 3 > 0), "tenant_id")


@query(f"WITH {EVENTS}, p AS (SELECT tenant_id, count(*) AS n FROM ev GROUP BY tenant_id) SELECT tenant_id, n, CASE WHEN n < 1000 THEN 'ok' WHEN n < 10000 THEN 'degraded' ELSE 'fail' END AS state FROM p")
def health_states(spark, sf):
    counted = T.events(spark, sf).groupBy("tenant_id").agg(F.count("*").alias("n"))
    return counted.withColumn("state", extras.health(F.col("n")))


def _profiles(spark, sf):
    return T.events(spark, sf).groupBy("user_id").agg(F.count_if(F.col("kind") == "click").alias("click_count")).select("user_id", F.array(F.lit(1.0)).alias("vector"), "click_count", F.col("click_count").alias("profile_version"))


@query(f"WITH {EVENTS}, p AS (SELECT user_id, count(*) FILTER (WHERE kind = 'click') AS n FROM ev GROUP BY user_id) SELECT user_id, CASE WHEN user_id % 2 = 0 THEN 0 ELSE n END AS click_count, user_id % 2 = 0 AS empty FROM p")
def gdpr_forget(spark, sf):
    stored = _profiles(spark, sf)
    reset, _ = profiles.forget(stored, stored.withColumn("context_key", F.lit("device:web")), stored.where("user_id % 2 = 0"))
    return reset.select("user_id", "click_count", F.col("vector").isNull().alias("empty"))


@query(f"WITH {EVENTS}, p AS (SELECT user_id, max(created_at) AS seen FROM ev GROUP BY user_id) SELECT user_id FROM p WHERE user_id % 3 = 0 AND seen < TIMESTAMP '2024-01-29 12:00:00'")
def expired_sessions(spark, sf):
    contexts = T.events(spark, sf).groupBy("user_id").agg(F.max("created_at").alias("updated_at")).withColumn("context_key", F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("session:"), "user_id")).otherwise("device:web"))
    return profiles.expired_sessions(contexts, "2024-01-29 12:00:00").select("user_id")


@query(f"WITH {EVENTS}, p AS (SELECT user_id, count(*) FILTER (WHERE kind = 'click') AS n FROM ev GROUP BY user_id) SELECT user_id AS query_id, n = 0 AS cold FROM p")
def profile_read(spark, sf):
    stored = _profiles(spark, sf)
    context = stored.where("user_id % 4 = 0").withColumn("context_key", F.lit("device:web"))
    asked = stored.select(F.col("user_id").alias("query_id"), "user_id", F.lit("device:web").alias("context_key"))
    return profiles.with_profile(asked, context, stored).select("query_id", F.col("profile_vector").isNull().alias("cold"))


@query(f"WITH {EVENTS} SELECT DISTINCT user_id, CASE WHEN user_id % 2 = 0 THEN 1 END AS click_count FROM ev")
def get_or_create(spark, sf):
    wanted = T.events(spark, sf).select("user_id")
    stored = wanted.where("user_id % 2 = 0").distinct().withColumn("click_count", F.lit(1))
    return indexing.get_or_create(stored, wanted, "user_id")


_ENDS = "even AND significant AND winner IN ('control', 'a')"


@query(f"""WITH {_EV}, {_STARTS}, c AS (SELECT tenant_id, variant, count(*) FILTER (WHERE kind = 'click') AS n FROM evv GROUP BY ALL), w AS (SELECT tenant_id AS experiment_id, arg_max(variant, (n, variant)) AS winner FROM c GROUP BY 1),
g AS (SELECT tenant_id AS experiment_id, count(*) % 3 <> 0 AS significant FROM ev GROUP BY 1)
SELECT experiment_id, CASE WHEN even AND NOT ({_ENDS}) THEN 'active' ELSE 'stopped' END AS status, CASE WHEN {_ENDS} THEN winner WHEN NOT even THEN 'b' END AS winning_variant FROM x JOIN w USING (experiment_id) JOIN g USING (experiment_id)""")
def experiment_stop(spark, sf):
    """Half of the experiments run; the variant with most clicks wins, which may be one that isn't declared."""
    status = F.when(F.col("even"), "active").otherwise("stopped")
    rows = experiments(spark, sf).select("experiment_id", status.alias("status"), F.array(F.lit("control"), F.lit("a")).alias("variants"), F.lit(None).cast("date").alias("end_date"), F.when(~F.col("even"), "b").alias("winning_variant"))
    named = log(spark, sf).withColumn("experiment_id", F.col("tenant_id"))
    clicks = named.groupBy("experiment_id", "variant").agg(F.count_if(F.col("kind") == "click").alias("n"))
    best = clicks.groupBy("experiment_id").agg(F.max_by("variant", F.struct("n", "variant")).alias("winner"))
    winners = best.join(named.groupBy("experiment_id").agg((F.count("*") % 3 != 0).alias("significant")), "experiment_id")
    return E.stop(rows, winners, "2024-02-01").select("experiment_id", "status", "winning_variant")


@query(f"WITH {EVENTS}, e AS (SELECT user_id, created_at AS t, lag(created_at) OVER w AS p, row_number() OVER w AS n FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY created_at, event_id)) SELECT user_id AS migration_id, n AS processed, CASE WHEN date_sub('second', p, t) > 0 THEN round(1 / date_sub('second', p, t) * 3600, 4) END AS docs_per_hour FROM e")
def backfill_speed(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("created_at", "event_id")
    log = T.events(spark, sf).select(F.col("user_id").alias("migration_id"), F.col("created_at").alias("at"), F.row_number().over(w).alias("processed"))
    return evaluation.progress(log)
