"""Event analytics as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.operators import events as E
from tidewell.sources import tables as T
from tidewell.sources.tables import EVENTS, EXPERIMENT, REQUESTS, VARIANTS, variant_sql

from .registry import query

NAMES = [v for v, _ in VARIANTS]
_BUCKET, _VARIANT = variant_sql()
_EV = f"{EVENTS}, us AS (SELECT user_id, {_BUCKET} AS bucket, {_VARIANT} AS variant FROM (SELECT DISTINCT user_id FROM events)), evv AS (SELECT * FROM ev JOIN us USING (user_id))"
_METRICS = """count(*) FILTER (WHERE kind = 'search') AS searches, count(*) FILTER (WHERE kind = 'click') AS clicks, round(avg(1.0 / position) FILTER (WHERE kind = 'click' AND position > 0), 6) AS mrr,
  round(quantile_cont(latency_ms, 0.95) FILTER (WHERE kind = 'search'), 4) AS p95_latency_ms,
  round(CASE WHEN count(*) FILTER (WHERE kind = 'search') > 0 THEN count(*) FILTER (WHERE kind = 'click') / count(*) FILTER (WHERE kind = 'search') ELSE 0 END, 6) AS ctr,
  round(1 - CASE WHEN count(*) FILTER (WHERE kind = 'search') > 0 THEN count(*) FILTER (WHERE kind = 'click') / count(*) FILTER (WHERE kind = 'search') ELSE 0 END, 6) AS no_click_rate"""


def log(spark, sf):
    return E.with_variant(T.events(spark, sf), EXPERIMENT, VARIANTS)


@query(f"WITH {_EV} SELECT user_id, CAST(bucket AS BIGINT) AS bucket FROM us")
def sticky_bucket(spark, sf):
    return log(spark, sf).select("user_id", "bucket").distinct()


@query(f"WITH {_EV} SELECT user_id, variant FROM us")
def assign_variant(spark, sf):
    return log(spark, sf).select("user_id", "variant").distinct()


@query(f"WITH {_EV} SELECT variant, strftime(created_at, '%Y-%m-%d') AS day, {_METRICS} FROM evv WHERE kind IS NOT NULL GROUP BY ALL")
def daily_metrics(spark, sf):
    return E.metrics(log(spark, sf).withColumn("day", E.day()), "variant", "day")


@query(f"WITH {_EV} SELECT variant, {_METRICS} FROM evv WHERE kind IS NOT NULL GROUP BY variant")
def variant_metrics(spark, sf):
    return E.metrics(log(spark, sf), "variant")


@query(f"WITH {_EV}, n AS (SELECT unnest(['control', 'a', 'b', 'unseen']) AS variant), s AS (SELECT variant, count(*) FILTER (WHERE kind = 'search') AS searches, count(*) FILTER (WHERE kind = 'click') AS clicks FROM evv GROUP BY variant) SELECT variant, coalesce(searches, 0) AS searches, coalesce(clicks, 0) AS clicks FROM n LEFT JOIN s USING (variant)")
def variant_samples(spark, sf):
    return E.declared(E.metrics(log(spark, sf), "variant").select("variant", "searches", "clicks"), [*NAMES, "unseen"])


def _p(i: int) -> str:
    """Two-sided p of the pooled test; 1 where a side has no searches or the pooled rate is 0 or 1."""
    pooled = f"((c0 + c{i}) / (n0 + n{i}))"
    z = f"abs(c0 / n0 - c{i} / n{i}) / sqrt({pooled} * (1 - {pooled}) * (1.0::DOUBLE / n0 + 1.0::DOUBLE / n{i})) / sqrt(2.0)"
    t = f"(1 / (1 + 0.3275911::DOUBLE * ({z})))"
    p = f"{t} * (0.254829592::DOUBLE + {t} * (-0.284496736::DOUBLE + {t} * (1.421413741::DOUBLE + {t} * (-1.453152027::DOUBLE + {t} * 1.061405429::DOUBLE)))) * exp(-({z}) * ({z}))"
    return f"CASE WHEN n0 > 0 AND n{i} > 0 AND {pooled} > 0 AND {pooled} < 1 THEN {p} ELSE 1.0::DOUBLE END"


def _rate(i: int) -> str:
    return f"CASE WHEN n{i} > 0 THEN c{i} / n{i} ELSE 0.0::DOUBLE END"


_SAMPLES = f"""s AS (SELECT CAST(count(*) FILTER (WHERE kind = 'search' AND variant = 'control') AS DOUBLE) AS n0, CAST(count(*) FILTER (WHERE kind = 'click' AND variant = 'control') AS DOUBLE) AS c0,
  CAST(count(*) FILTER (WHERE kind = 'search' AND variant = 'a') AS DOUBLE) AS n1, CAST(count(*) FILTER (WHERE kind = 'click' AND variant = 'a') AS DOUBLE) AS c1,
  CAST(count(*) FILTER (WHERE kind = 'search' AND variant = 'b') AS DOUBLE) AS n2, CAST(count(*) FILTER (WHERE kind = 'click' AND variant = 'b') AS DOUBLE) AS c2 FROM evv),
r AS (SELECT *, {_rate(0)} AS r0, {_rate(1)} AS r1, {_rate(2)} AS r2 FROM s),
p AS (SELECT *, {_p(1)} AS p1, {_p(2)} AS p2, CASE WHEN r0 >= r1 AND r0 >= r2 THEN 0 WHEN r1 >= r2 THEN 1 ELSE 2 END AS w FROM r)"""


def _verdict(limit: str) -> str:
    return f"""SELECT ['control', 'a', 'b'][w + 1] AS winner, round(least(p1, p2), 6) AS p_value, least(n0, n1, n2) >= 100 AS enough_samples,
  least(n0, n1, n2) >= 100 AND CASE w WHEN 0 THEN p1 < {limit} AND p2 < {limit} WHEN 1 THEN p1 < {limit} ELSE p2 < {limit} END AS significant FROM p"""


@query(f"WITH {_EV}, {_SAMPLES} {_verdict('0.05')}")
def significance(spark, sf):
    return E.significance(E.metrics(log(spark, sf), "variant").select("variant", "searches", "clicks"), NAMES)


@query(f"""WITH {_EV}, {_SAMPLES}, d AS (SELECT 0.05::DOUBLE / (date_diff('day', min(CAST(created_at AS DATE)), max(CAST(created_at AS DATE))) + 1) / 2 AS level FROM evv),
v AS ({_verdict("(SELECT level FROM d)")}) SELECT *, round((SELECT level FROM d), 9) AS level FROM v""")
def significance_spending(spark, sf):
    """The same with a level that is spent over the days that the experiment has run, and over its comparisons."""
    events = log(spark, sf)
    return E.significance_spending(E.metrics(events, "variant").select("variant", "searches", "clicks"), NAMES, events)


@query(f"WITH {_EV} SELECT event_id, user_id, tenant_id, CAST(NULL AS VARCHAR) AS query_text, variant, clicked_doc_id, position FROM evv WHERE kind = 'click'")
def click_rows(spark, sf):
    return E.click_rows(log(spark, sf)).drop("created_at")


_STARTS = "x AS (SELECT tenant_id AS experiment_id, min(created_at) + INTERVAL 5 DAY AS start_date, max(created_at) AS newest, CAST(substr(tenant_id, 2) AS INT) % 2 = 0 AS even FROM ev GROUP BY tenant_id)"


def experiments(spark, sf):
    """An experiment for each tenant, begun five days after its first event."""
    return T.events(spark, sf).groupBy(F.col("tenant_id").alias("experiment_id")).agg((F.min("created_at") + F.expr("INTERVAL 5 DAYS")).alias("start_date"), F.max("created_at").alias("newest")).withColumn("even", F.substring("experiment_id", 2, 9).cast("int") % 2 == 0)


@query(f"WITH {_EV}, {_STARTS}, j AS (SELECT evv.*, experiment_id FROM evv JOIN x ON experiment_id = evv.tenant_id AND created_at >= start_date) SELECT experiment_id, variant, {_METRICS} FROM j WHERE kind IS NOT NULL GROUP BY ALL")
def experiment_events(spark, sf):
    return E.metrics(E.since_start(log(spark, sf).withColumn("experiment_id", F.col("tenant_id")), experiments(spark, sf)), "experiment_id", "variant")


@query(f"WITH {EVENTS}, {_STARTS} SELECT experiment_id, row_number() OVER (ORDER BY start_date DESC, experiment_id) AS place, count(*) OVER () AS running FROM x WHERE even")
def active_experiments(spark, sf):
    return E.active_list(experiments(spark, sf).withColumn("status", F.when(F.col("even"), "active").otherwise("stopped"))).select("experiment_id", "place", "running")


@query(f"WITH {_EV} SELECT DISTINCT user_id, sha256(CAST(user_id AS VARCHAR)) AS hashed FROM ev")
def user_hash(spark, sf):
    return T.events(spark, sf).select("user_id").distinct().select("user_id", E.hashed_user(F.col("user_id")).alias("hashed"))


_WORDS = "CASE query_id // 100 % 4 WHEN 0 THEN 'weighted+rerank+alpha:0.3' WHEN 1 THEN 'rrf' WHEN 2 THEN 'personalize+diversify' ELSE 'weighted+alpha:0.75' END"


@query(f"""WITH {REQUESTS}, w AS (SELECT query_id, query_id % 3 > 0 AS named, {_WORDS} AS s FROM rq) SELECT query_id, CASE WHEN named AND s LIKE '%weighted%' THEN 'weighted' ELSE 'rrf' END AS fusion,
  CASE WHEN named AND contains(s, 'alpha:') THEN CAST(regexp_extract(s, 'alpha:([0-9.]+)', 1) AS DOUBLE) ELSE 0.5::DOUBLE END AS fusion_alpha, named AND contains(s, 'rerank') AS rerank, named AND contains(s, 'personalize') AS personalize, named AND contains(s, 'diversify') AS diversify FROM w""")
def strategy_overlay(spark, sf):
    """The settings that an experiment's strategy lays over requests that have a user."""
    every = F.lit(1)
    strategy = F.element_at(F.array(*map(F.lit, ("weighted+rerank+alpha:0.3", "rrf", "personalize+diversify", "weighted+alpha:0.75"))), (F.floor(F.col("query_id") / 100) % 4 + every).cast("int"))
    asked = T.requests(spark, sf).select("query_id", F.when(F.col("query_id") % 3 > 0, F.col("query_id")).alias("user_id"), F.lit("rrf").alias("fusion"), F.lit(0.5).alias("fusion_alpha"), *[F.lit(False).alias(c) for c in ("rerank", "personalize", "diversify")], strategy.alias("strategy"))
    return E.overlaid(asked).select("query_id", *E.OVERLAY)


@query(f"""WITH {_EV}, d AS (SELECT variant, strftime(created_at, '%Y-%m-%d') AS day, {_METRICS} FROM evv WHERE kind IS NOT NULL GROUP BY ALL)
SELECT variant, CAST(sum(searches) AS BIGINT) AS searches, CAST(sum(clicks) AS BIGINT) AS clicks, round(avg(ctr), 5) AS ctr, round(avg(mrr), 5) AS mrr, round(avg(p95_latency_ms), 3) AS p95_latency_ms, count(*) AS days FROM d GROUP BY variant""")
def shadow_comparison(spark, sf):
    return E.shadow_comparison(log(spark, sf))


@query(f"WITH {EVENTS} SELECT event_id, query_text, unnest(['control', 'weighted', 'rrf+rerank']) AS variant FROM ev WHERE kind = 'search' AND CAST('0x' || substr(md5(CAST(event_id AS VARCHAR)), 1, 4) AS INT) < 16384")
def shadow_log(spark, sf):
    return E.shadow_rows(T.events(spark, sf), ["weighted", "rrf+rerank"], 0.25)


@query("""WITH d AS (SELECT CAST(ts AS DATE) AS d, count(*) AS n FROM events GROUP BY 1) SELECT strftime(d, '%Y-%m-%d') AS day, n, d + 1 < DATE '2024-04-15' - 90 AS expired, 'search-events/' || strftime(d, '%Y%m%d') || '.parquet' AS archive_key FROM d""")
def event_retention(spark, sf):
    return E.retention(T.events(spark, sf), "2024-04-15")


@query(f"WITH {_EV} SELECT event_id, user_id, tenant_id, 'sha256:' || sha256(query_text) AS query_text, variant, latency_ms FROM evv WHERE kind = 'search'")
def event_pii_hash(spark, sf):
    return E.search_rows(log(spark, sf)).drop("created_at")


@query(f"""WITH {EVENTS} SELECT count(*) FILTER (WHERE latency_ms <= 5) AS le_5, count(*) FILTER (WHERE latency_ms <= 25) AS le_25, count(*) FILTER (WHERE latency_ms <= 100) AS le_100, count(*) FILTER (WHERE latency_ms <= 250) AS le_250, count(*) AS le_inf, CAST(sum(latency_ms) AS DOUBLE) AS total FROM ev WHERE latency_ms IS NOT NULL""")
def latency_histogram(spark, sf):
    return E.histogram(T.events(spark, sf), "latency_ms", [5, 25, 100, 250])


@query(f"""WITH {EVENTS}, w AS (SELECT date_trunc('day', created_at) AS s, count(*) AS n, round(quantile_cont(latency_ms, 0.5), 4) AS p50, round(quantile_cont(latency_ms, 0.95), 4) AS p95, round(quantile_cont(latency_ms, 0.99), 4) AS p99 FROM ev WHERE kind = 'search' GROUP BY 1)
SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start, n, p50, p95, p99, n - lag(n) OVER (ORDER BY s) AS change FROM w""")
def latency_dashboard(spark, sf):
    return E.latency_windows(T.events(spark, sf))


@query("SELECT * FROM (VALUES ('exp1', 'duplicate id'), ('exp2', NULL), ('exp3', 'too few variants'), ('exp4', 'duplicate variants'), ('exp5', 'weights don''t match'), ('exp6', 'weights sum to zero')) t(experiment_id, reason)")
def experiment_validation(spark, sf):
    rows = spark.sql("""SELECT * FROM VALUES ('exp1', array('control', 'a'), cast(null AS array<double>)), ('exp2', array('control', 'a'), array(0.5D, 0.5D)), ('exp3', array('control'), null),
      ('exp4', array('x', 'x'), null), ('exp5', array('x', 'y'), array(1D)), ('exp6', array('x', 'y'), array(0D, 0D)) AS t(experiment_id, variants, weights)""")
    return E.experiment_errors(rows, spark.sql("SELECT 'exp1' AS experiment_id, 'active' AS status"))
