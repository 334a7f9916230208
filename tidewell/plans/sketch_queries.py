"""Stored summaries as queries: written by day, merged on read."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewell.operators import sketches as K
from tidewell.sources import tables as T
from tidewell.sources.scratch import stored
from tidewell.sources.tables import EVENTS

from .registry import query

SHARES = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
_G = (1 + K.ALPHA) / (1 - K.ALPHA)


def _daily(spark, sf):
    """Latencies of searches by tenant and day, as they would be stored once a day."""
    searches = T.events(spark, sf).where("kind = 'search'").withColumn("day", F.to_date("created_at"))
    return stored(K.sketch(searches, ["tenant_id", "day"], F.col("latency_ms")))


_DAILY = f"""dl AS (SELECT tenant_id, CAST(created_at AS DATE) AS day, CAST(CASE WHEN latency_ms > 0 THEN ceil(ln(CAST(latency_ms AS DOUBLE)) / {math.log(_G)!r}) ELSE {K.ZERO} END AS BIGINT) AS bucket, count(*) AS n FROM ev WHERE kind = 'search' GROUP BY 1, 2, 3)"""


def _quantiles(source: str, keys: str) -> str:
    first = lambda share: f"round(CASE WHEN min(bucket) FILTER (WHERE upto > {share} * (everything - 1)) > {K.ZERO} THEN 2 * pow({_G!r}, CAST(min(bucket) FILTER (WHERE upto > {share} * (everything - 1)) AS DOUBLE)) / {_G + 1!r} ELSE 0.0 END, 6)"
    columns = ", ".join(f"CAST({first(s)} AS DOUBLE) AS {name}" for name, s in SHARES.items())
    return f"SELECT {keys}, CAST(max(everything) AS BIGINT) AS total, {columns} FROM (SELECT *, sum(n) OVER (PARTITION BY {keys} ORDER BY bucket ROWS UNBOUNDED PRECEDING) AS upto, sum(n) OVER (PARTITION BY {keys}) AS everything FROM {source}) GROUP BY {keys}"


@query(f"WITH {EVENTS}, {_DAILY}, mg AS (SELECT tenant_id, bucket, sum(n) AS n FROM dl GROUP BY tenant_id, bucket) {_quantiles('mg', 'tenant_id')}")
def latency_sketch(spark, sf):
    """Quantiles of each tenant's latencies over all days, from the daily sketches."""
    return K.quantiles(K.merged(_daily(spark, sf), ["tenant_id"]), ["tenant_id"], SHARES)


@query(f"""WITH {EVENTS}, {_DAILY}, mv AS (SELECT tenant_id, day, bucket, sum(n) AS n FROM (SELECT tenant_id, CAST(day + to_days(k) AS DATE) AS day, bucket, n FROM dl, (SELECT unnest(range(7)) AS k)) SEMI JOIN (SELECT DISTINCT tenant_id, day FROM dl) USING (tenant_id, day) GROUP BY ALL)
SELECT tenant_id, strftime(day, '%Y-%m-%d') AS day, total, p50, p95, p99 FROM ({_quantiles('mv', 'tenant_id, day')})""")
def latency_moving(spark, sf):
    """Quantiles of the last seven days, for every tenant and day."""
    week = K.moving(_daily(spark, sf), ["tenant_id"], "day", 7)
    return K.quantiles(week, ["tenant_id", "day"], SHARES).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query(f"WITH {EVENTS} SELECT tenant_id, count(*) AS n, true AS close FROM ev WHERE kind = 'search' GROUP BY tenant_id")
def latency_sketch_error(spark, sf):
    """Whether the sketch's 95th percentile is within its bound of the value at that rank."""
    searches = T.events(spark, sf).where("kind = 'search'")
    by = Window.partitionBy("tenant_id")
    counts = searches.where("latency_ms is not null").groupBy("tenant_id", "latency_ms").agg(F.count("*").alias("c"))
    upto = counts.select("*", F.sum("c").over(by.orderBy("latency_ms")).alias("upto"), F.sum("c").over(by).alias("n"))
    exact = upto.where("upto > 0.95D * (n - 1)").groupBy("tenant_id").agg(F.max("n").alias("n"), F.min("latency_ms").cast("double").alias("at"))
    met = exact.join(latency_sketch(spark, sf).select("tenant_id", "p95"), "tenant_id")
    return met.select("tenant_id", "n", (F.abs(F.col("p95") - F.col("at")) <= (K.ALPHA + 1e-6) * F.col("at") + 1e-6).alias("close"))


@query(f"WITH {EVENTS} SELECT tenant_id, count(DISTINCT user_id) AS users, true AS close FROM ev WHERE created_at >= TIMESTAMP '2024-01-08' AND created_at < TIMESTAMP '2024-01-22' GROUP BY tenant_id")
def distinct_users(spark, sf):
    """Users of two weeks by tenant, and whether the merged daily sketches come within a twentieth of it."""
    events = T.events(spark, sf).withColumn("day", F.to_date("created_at"))
    daily = stored(K.distinct_sketch(events, ["tenant_id", "day"], "user_id"))
    span = F.col("day").between(F.lit("2024-01-08").cast("date"), F.lit("2024-01-21").cast("date"))
    exact = events.where(span).groupBy("tenant_id").agg(F.countDistinct("user_id").alias("users"))
    return exact.join(K.distinct_count(daily.where(span), ["tenant_id"]), "tenant_id").select("tenant_id", "users", (F.abs(F.col("estimate") - F.col("users")) <= 0.05 * F.col("users")).alias("close"))
