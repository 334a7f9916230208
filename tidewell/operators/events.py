"""Search and click log: inserts, experiment metrics, significance, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions import stats
from tidewell.operators.search import small


def hashed_query(query: Column, enabled: bool = True) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(query, 256)) if enabled else query


def search_rows(events: DataFrame, pii: bool = True) -> DataFrame:
    """Rows of the log for searches: a hashed query, the control variant where none is set."""
    return events.where("kind = 'search'").select("event_id", "user_id", "tenant_id", hashed_query(F.col("query_text"), pii).alias("query_text"), F.coalesce("variant", F.lit("control")).alias("variant"), "latency_ms", "created_at")


def click_rows(events: DataFrame, pii: bool = True) -> DataFrame:
    """Rows of the log for clicks: the query, where it is known, hashed as in the search's row."""
    return events.where("kind = 'click'").select("event_id", "user_id", "tenant_id", hashed_query(F.col("query_text"), pii).alias("query_text"), F.coalesce("variant", F.lit("control")).alias("variant"), "clicked_doc_id", "position", "created_at")


def hashed_user(user: Column) -> Column:
    return F.sha2(user.cast("string"), 256)


def since_start(events: DataFrame, experiments: DataFrame) -> DataFrame:
    """The events of each experiment from its start on. Experiments are few; their side travels where a count allows."""
    return events.join(small(experiments.select("experiment_id", "start_date")), "experiment_id").where(F.col("created_at") >= F.col("start_date")).drop("start_date")


def active_list(experiments: DataFrame) -> DataFrame:
    """Active experiments with their place, newest first, and how many there are. One row an experiment, so few."""
    active = experiments.where("status = 'active'")
    return active.withColumn("place", F.row_number().over(Window.orderBy(F.desc("start_date"), "experiment_id"))).withColumn("running", F.count("*").over(Window.partitionBy()))


def with_variant(events: DataFrame, experiment: str, variants) -> DataFrame:
    """events with bucket and variant; a user always gets the same one. Computed per user, not per event."""
    users = events.select("user_id").distinct()
    bucket = stats.sticky_bucket(F.col("user_id").cast("string"), F.lit(experiment))
    assigned = users.withColumn("bucket", bucket).withColumn("variant", stats.choose_variant(F.col("bucket"), list(variants)))
    return events.join(assigned, "user_id")


def metrics(events: DataFrame, *keys: str, approximate: bool = False) -> DataFrame:
    """searches, clicks, ctr (not clamped), no-click rate, mean reciprocal position, 95th percentile of latency.

    The exact percentile keeps the distinct latencies of a group; `approximate` takes a sketch of fixed size instead.
    """
    p95 = F.approx_percentile if approximate else F.percentile
    search, click = F.col("kind") == "search", F.col("kind") == "click"
    counted = events.where("kind is not null").groupBy(*keys).agg(
        F.count_if(search).alias("searches"), F.count_if(click).alias("clicks"),
        F.round(F.avg(F.when(click & (F.col("position") > 0), F.lit(1.0) / F.col("position"))), 6).alias("mrr"),
        F.round(p95(F.when(search, F.col("latency_ms")), 0.95), 4).alias("p95_latency_ms"),
    )
    ctr = F.when(F.col("searches") > 0, F.col("clicks") / F.col("searches")).otherwise(F.lit(0.0))
    return counted.withColumn("ctr", F.round(ctr, 6)).withColumn("no_click_rate", F.round(1 - ctr, 6))


def day() -> Column:
    return F.date_format("created_at", "yyyy-MM-dd").alias("day")


def declared(found: DataFrame, names: list[str]) -> DataFrame:
    """Declared variants with what was observed, zeros where nothing was."""
    listed = found.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, names))).alias("variant"))
    return listed.join(found, "variant", "left").fillna(0, [c for c, t in found.dtypes if t in ("bigint", "int", "double")])


def alpha(days: Column, comparisons: int, level: float = 0.05) -> Column:
    """Level left for one comparison after `days` days."""
    return F.lit(level) / (days + 1) / comparisons


def significance(samples: DataFrame, names: list[str], threshold: Column | float = 0.05, least: int = 100) -> DataFrame:
    """One row: winner by click-through, smallest p, whether it is significant. One row a variant comes in.

    Under `least` searches in any variant nothing is decided. A winning control must beat all, another its control only.
    """
    all_ = declared(samples, names)
    row = all_.agg(*[F.max(F.when(F.col("variant") == v, F.col(c))).alias(f"{c}_{i}") for i, v in enumerate(names) for c in ("searches", "clicks")])
    ctr = [F.when(F.col(f"searches_{i}") > 0, F.col(f"clicks_{i}") / F.col(f"searches_{i}")).otherwise(F.lit(0.0)) for i in range(len(names))]
    p = [stats.two_proportion_p(F.col("clicks_0"), F.col("searches_0"), F.col(f"clicks_{i}"), F.col(f"searches_{i}")) for i in range(1, len(names))]
    best = F.array_max(F.array(*[F.struct(c.alias("ctr"), F.lit(-i).alias("order")) for i, c in enumerate(ctr)]))
    winner = -best["order"]
    enough = F.least(*[F.col(f"searches_{i}") for i in range(len(names))]) >= least if len(names) > 1 else F.col("searches_0") >= least
    limit = threshold if isinstance(threshold, Column) else F.lit(threshold)
    passed = F.when(winner == 0, F.forall(F.array(*p), lambda v: v < limit)).otherwise(F.element_at(F.array(*p), F.greatest(winner, F.lit(1))) < limit)
    return row.select(
        F.element_at(F.array(*map(F.lit, names)), winner + 1).alias("winner"), F.round(F.array_min(F.array(*p)), 6).alias("p_value"), enough.alias("enough_samples"), (enough & passed).alias("significant")
    )


def significance_spending(samples: DataFrame, names: list[str], events: DataFrame, level: float = 0.05) -> DataFrame:
    """significance() at the level that is left after the days that the events span, and that level."""
    days = events.agg(F.date_diff(F.max("created_at"), F.min("created_at"))).first()[0] or 0
    left = alpha(F.lit(days), max(1, len(names) - 1), level)
    return significance(samples, names, left).withColumn("level", F.round(left, 9))


def shadow_comparison(events: DataFrame) -> DataFrame:
    """Per variant: counts summed, daily metrics averaged over the days with data."""
    daily = metrics(events.withColumn("day", day()), "variant", "day")
    return daily.groupBy("variant").agg(F.sum("searches").alias("searches"), F.sum("clicks").alias("clicks"), F.round(F.avg("ctr"), 5).alias("ctr"), F.round(F.avg("mrr"), 5).alias("mrr"), F.round(F.avg("p95_latency_ms"), 3).alias("p95_latency_ms"), F.count("*").alias("days"))


def shadow_rows(events: DataFrame, strategies: list[str], share: float) -> DataFrame:
    """A row for the control and each strategy of the searches that a hash samples; the request's own fusion stays."""
    sampled = events.where("kind = 'search'").where(F.conv(F.substring(F.md5(F.col("event_id").cast("string")), 1, 4), 16, 10).cast("long") < int(65536 * share))
    return sampled.select("event_id", "query_text", F.explode(F.array(F.lit("control"), *map(F.lit, strategies))).alias("variant"))


def parse_strategy(strategy: str) -> dict:
    """"weighted+rerank+alpha:0.3" as the settings that it overlays; an unknown word is an error."""
    out: dict = {}
    for word in filter(None, strategy.split("+")):
        name, _, value = word.partition(":")
        if name in ("rrf", "weighted") and not value:
            out["fusion"] = name
        elif name in ("rerank", "personalize", "diversify") and not value:
            out[name] = True
        elif name == "alpha" and value:
            out["fusion_alpha"] = float(value)
        else:
            raise ValueError(f"unknown strategy word: {word}")
    return out


OVERLAY = ("fusion", "fusion_alpha", "rerank", "personalize", "diversify")


def overlay(request: dict, settings: dict, active: bool = True) -> dict:
    """The request with those settings that an experiment may change, where it has a user and the experiment runs."""
    return request | {k: v for k, v in settings.items() if k in OVERLAY} if active and request.get("user_id") else dict(request)


def strategy_settings(strategy: Column) -> dict[str, Column]:
    """parse_strategy() for a column: null where the strategy doesn't say; an unknown word fails the query."""
    words = F.filter(F.split(strategy, r"\+"), lambda w: w != "")
    known = F.forall(words, lambda w: w.isin("rrf", "weighted", "rerank", "personalize", "diversify") | w.rlike(r"^alpha:[0-9.]+$"))
    checked = F.when(known, words).otherwise(F.raise_error(F.concat(F.lit("unknown strategy word in "), strategy)).cast("array<string>"))
    said = lambda name: F.when(F.array_contains(checked, name), F.lit(True))
    value = F.try_element_at(F.filter(checked, lambda w: w.startswith("alpha:")), F.lit(-1))
    fusion = F.try_element_at(F.filter(checked, lambda w: w.isin("rrf", "weighted")), F.lit(-1))
    return {"fusion": fusion, "fusion_alpha": F.substring(value, 7, 20).cast("double"), "rerank": said("rerank"), "personalize": said("personalize"), "diversify": said("diversify")}


def overlaid(requests: DataFrame, active: Column | None = None) -> DataFrame:
    """overlay() for a table: settings of `strategy` where the request has a user and the experiment runs."""
    applies = F.col("user_id").isNotNull() & (F.lit(True) if active is None else active)
    return requests.withColumns({k: F.when(applies & c.isNotNull(), c).otherwise(F.col(k)) for k, c in strategy_settings(F.col("strategy")).items()})


def experiment_errors(experiments: DataFrame, active: DataFrame, most_active: int = 3) -> DataFrame:
    """experiment_id and the first reason to reject it, null where it is fine."""
    names, weights = F.col("variants"), F.col("weights")
    running = active.where("status = 'active'").agg(F.count("*").alias("running"))
    known = active.select("experiment_id", F.lit(True).alias("known"))
    checked = experiments.join(known, "experiment_id", "left").join(F.broadcast(running))  # one row
    reason = (
        F.when(F.size(names) < 2, "too few variants").when(F.size(F.array_distinct(names)) < F.size(names), "duplicate variants")
        .when(weights.isNotNull() & (F.size(weights) != F.size(names)), "weights don't match").when(weights.isNotNull() & (F.aggregate(weights, F.lit(0.0), lambda a, w: a + w) <= 0), "weights sum to zero")
        .when(F.col("known"), "duplicate id").when(F.col("running") >= most_active, "too many active")
    )
    return checked.select("experiment_id", reason.alias("reason"))


def stop(experiments: DataFrame, winners: DataFrame, today) -> DataFrame:
    """Active experiments with a significant winner among their variants are stopped; others stay as they are."""
    joined = experiments.join(winners.select("experiment_id", "winner", "significant"), "experiment_id", "left")
    ends = (F.col("status") == "active") & F.coalesce("significant", F.lit(False)) & F.array_contains("variants", F.col("winner"))
    return joined.select("experiment_id", F.when(ends, "stopped").otherwise(F.col("status")).alias("status"), F.when(ends, F.lit(today)).otherwise(F.col("end_date")).alias("end_date"), F.when(ends, F.col("winner")).otherwise(F.col("winning_variant")).alias("winning_variant"))


def retention(events: DataFrame, now: str, days: int = 90) -> DataFrame:
    """Daily partitions with their row count and whether they are past keeping."""
    cutoff = F.date_sub(F.lit(now).cast("date"), days)
    daily = events.groupBy(F.col("created_at").cast("date").alias("d")).agg(F.count("*").alias("n"))
    return daily.select(F.date_format("d", "yyyy-MM-dd").alias("day"), "n", (F.date_add("d", 1) < cutoff).alias("expired"), F.concat(F.lit("search-events/"), F.date_format("d", "yyyyMMdd"), F.lit(".parquet")).alias("archive_key"))


def archive(events: DataFrame, path: str) -> None:
    """Write the log by day, so that a day is read, archived or dropped alone."""
    events.withColumn("event_date", F.col("created_at").cast("date")).repartition("event_date").write.mode("append").partitionBy("event_date").parquet(path)


def histogram(values: DataFrame, column: str, edges: list[float]) -> DataFrame:
    """Cumulative counts at or under each edge and over all."""
    counts = [F.count_if(F.col(column) <= e).alias(f"le_{e:g}") for e in edges]
    return values.where(F.col(column).isNotNull()).agg(*counts, F.count("*").alias("le_inf"), F.sum(F.col(column).cast("double")).alias("total"))


def latency_windows(events: DataFrame, width: str = "1 day") -> DataFrame:
    """Rate and percentiles of search latency per window, with the change against the window before."""
    w = F.window("created_at", width)
    agg = events.where("kind = 'search'").groupBy(w.alias("w")).agg(F.count("*").alias("n"), *[F.round(F.percentile("latency_ms", q), 4).alias(f"p{int(q * 100)}") for q in (0.5, 0.95, 0.99)])
    order = Window.orderBy("start")  # a row a window: as many as days or hours, never as rows
    return agg.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n", "p50", "p95", "p99").withColumn("change", F.col("n") - F.lag("n").over(order))
