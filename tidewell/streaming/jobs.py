"""Structured Streaming counterparts of the event-driven parts; each runs to the end of what is there and returns it."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewell.operators.profiles import moved
from tidewell.sources.scratch import folder


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    # As a pattern the path may be a file or a folder of files.
    return spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).parquet(f"{sf_dir}/event[s].parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run until the source is used up; the sink's rows. Complete and update results are kept by batch, last one wins."""
    spark, at = stream.sparkSession, folder(stream.sparkSession, "streams")
    schema = stream.schema
    if mode == "append":
        writer = stream.writeStream.format("parquet").option("path", f"{at}/out").outputMode("append")
    else:
        writer = stream.writeStream.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{at}/out")).outputMode(mode)
    writer.option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(f"{at}/out")


def tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events and their value per day and type."""
    grouped = event_stream(spark, sf_dir).withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return drain(grouped.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total"), "complete")


def sliding_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors in windows of two hours, one an hour."""
    errors = event_stream(spark, sf_dir).where("event_type = 'error'").withWatermark("ts", "2 hours")
    grouped = errors.groupBy(F.window("ts", "2 hours", "1 hour").alias("w")).agg(F.count("*").alias("n"))
    return drain(grouped.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n"), "complete")


def sessions(spark: SparkSession, sf_dir: str, gap: str = "24 hours") -> DataFrame:
    grouped = event_stream(spark, sf_dir).withWatermark("ts", "1 hour").groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return drain(grouped.select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n"), "complete")


def deduplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event once, however often it is delivered: here every one twice."""
    events = event_stream(spark, sf_dir).select("event_id", "ts", "user_id")
    twice = events.withColumn("delivery", F.explode(F.array(F.lit(1), F.lit(2))))
    return drain(twice.withWatermark("ts", "1 day").dropDuplicatesWithinWatermark(["event_id"]).select("event_id", "user_id"))


def running_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = event_stream(spark, sf_dir).where("event_type = 'view'").groupBy((F.col("user_id") % 5).alias("tenant")).agg(F.count("*").alias("searches"), F.round(F.avg("value"), 4).alias("avg_value"))
    return drain(grouped, "complete")


def _queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queue's rows as they are written; the same rule as the table's adapter."""
    status = F.element_at(F.array(*map(F.lit, ("pending", "in_progress", "done", "failed", "dead"))), (F.col("event_id") % 5 + 1).cast("int"))
    rows = event_stream(spark, sf_dir).where("event_type not in ('view', 'click')")
    return rows.select(F.col("event_id").alias("id"), (F.col("event_id") % 1000).alias("document_id"), F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("op"), status.alias("status"), F.concat(F.lit("t"), F.col("user_id") % 5).alias("tenant_id"), "ts")


def publish(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pending rows handed on at least once: a batch that is tried again overwrites its own folder."""
    at = folder(spark, "streams")
    pending = _queue(spark, sf_dir).where("status = 'pending'").select("id", "document_id", "op")
    hand_on = lambda df, n: df.write.mode("overwrite").parquet(f"{at}/out/batch={n}")
    pending.writeStream.foreachBatch(hand_on).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{at}/out").select("id", "document_id", "op")


def lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open rows of each tenant and the time of the oldest."""
    grouped = _queue(spark, sf_dir).where("status in ('pending', 'failed')").groupBy("tenant_id").agg(F.count("*").alias("n"), F.min("ts").alias("oldest"))
    return drain(grouped.select("tenant_id", "n", F.date_format("oldest", "yyyy-MM-dd HH:mm:ss").alias("oldest")), "complete")


class Breaker:
    """A breaker over a request log in order of time: closed, open, half_open.

    Opens when, in the window, errors reach their share or the 95th percentile of successes passes slow_ms; after a
    window's length the next request probes. `seen` has the requests of the window: (at, ok, latency).
    """

    def __init__(self, window_ms: int = 60_000, least: int = 5, error_share: float = 0.05, slow_ms: float = 500.0, state: str = "closed", opened: int = 0, seen=()):
        self.window_ms, self.least, self.error_share, self.slow_ms = window_ms, least, error_share, slow_ms
        self.state, self.opened, self.seen = state, opened, deque(seen)
        self.good, self.errors = sorted(x[2] for x in self.seen if x[1]), sum(not x[1] for x in self.seen)

    def step(self, at: int, ok: bool, latency: float) -> str:
        """The state after a request."""
        if self.state == "open" and at - self.opened >= self.window_ms:
            self.state = "half_open"
        seen, good = self.seen, self.good
        while seen and seen[0][0] <= at - self.window_ms:
            _, was_ok, was = seen.popleft()
            if was_ok:
                del good[bisect_left(good, was)]
            else:
                self.errors -= 1
        seen.append((at, ok, latency))
        if ok:
            insort(good, latency)
        else:
            self.errors += 1
        if self.state == "half_open":
            self.state, self.opened = ("closed", self.opened) if ok else ("open", at)
        elif self.state == "closed" and len(seen) >= self.least:
            place = 0.95 * (len(good) - 1)
            low = int(place)
            p95 = good[low] + (place - low) * (good[min(low + 1, len(good) - 1)] - good[low]) if good else 0.0
            if self.errors / len(seen) >= self.error_share or p95 > self.slow_ms:
                self.state, self.opened = "open", at
        return self.state


def breaker_steps(rows, **settings):
    """Request log in order of time to (at, state) after each."""
    breaker = Breaker(**settings)
    for at, ok, latency in rows:
        yield at, breaker.step(at, ok, latency)


def breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, changes, state: a breaker for each user's requests, kept as state between batches."""

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        changes, last = state.get if state.exists else (0, "closed")
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        for _, now in breaker_steps(zip(rows["ts"].astype("int64") // 10**6, rows["event_type"] != "error", rows["value"]), window_ms=24 * 3600 * 1000):
            changes, last = changes + (now != last), now
        state.update((changes, last))
        yield pd.DataFrame({"user_id": [key[0]], "changes": [changes], "state": [last]})

    stream = event_stream(spark, sf_dir).select("event_id", "ts", "user_id", "event_type", "value")
    return drain(stream.groupBy("user_id").applyInPandasWithState(step, "user_id long, changes int, state string", "changes int, state string", "append", GroupStateTimeout.NoTimeout))


def retries(spark: SparkSession, sf_dir: str, most: int = 20, late: str = "1 minute") -> DataFrame:
    """user_id, attempts, due (microseconds): retries that fall due by the end of what is there.

    An error is a failed attempt and sets a timer for when its backoff is over, `most` of them in a row make the row
    dead; a purchase settles it. A timer that runs out, by the stream's own time, hands the row out for its next attempt.
    """

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        attempts, status, due = state.get if state.exists else (0, "pending", 0)
        if state.hasTimedOut:
            state.update((attempts, "due", due))
            yield pd.DataFrame({"user_id": [key[0]], "attempts": [attempts], "due": [due]})
            return
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        for kind, at in zip(rows["event_type"], rows["micros"]):
            if status == "dead":
                break
            if kind == "error":
                attempts, status, due = attempts + 1, "dead" if attempts + 1 >= most else "failed", int(at) + 1_000_000 * min(10 * 2**attempts, 3600)
            else:
                attempts, status, due = 0, "done", 0
        state.update((attempts, status, due))
        if status == "failed":
            state.setTimeoutTimestamp(max(-(-due // 1000), state.getCurrentWatermarkMs() + 1))

    stream = event_stream(spark, sf_dir).where("event_type in ('error', 'purchase')").select("event_id", "ts", F.unix_micros("ts").alias("micros"), "user_id", "event_type").withWatermark("ts", late)
    return drain(stream.groupBy("user_id").applyInPandasWithState(step, "user_id long, attempts int, due long", "attempts int, status string, due long", "append", GroupStateTimeout.EventTimeTimeout))


def profiles(spark: SparkSession, sf_dir: str, doc_vectors: DataFrame, fast: float = 0.5, slow: float = 0.05, warm: int = 10) -> DataFrame:
    """user_id, vector, click_count, profile_version: the moving average as state, a row for each batch that moved it;
    the last version counts."""

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        vector, n = state.get if state.exists else (None, 0)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        vector = None if vector is None else np.asarray(vector)
        for v in rows["vector"]:
            vector, n = moved(vector, n, v, fast, slow, warm), n + 1
        state.update(([float(x) for x in vector], n))
        yield pd.DataFrame({"user_id": [key[0]], "vector": [[float(x) for x in vector]], "click_count": [n]})

    doc = F.get_json_object("props", "$.k").cast("long")
    clicks = event_stream(spark, sf_dir).where("event_type = 'click'").select("event_id", "ts", "user_id", doc.alias("doc_id")).join(doc_vectors.select("doc_id", F.col("vector").cast("array<double>").alias("vector")), "doc_id")
    versions = drain(clicks.groupBy("user_id").applyInPandasWithState(step, "user_id long, vector array<double>, click_count long", "vector array<double>, n long", "append", GroupStateTimeout.NoTimeout))
    last = versions.groupBy("user_id").agg(F.max_by("vector", "click_count").alias("vector"), F.max("click_count").alias("click_count"))
    return last.withColumn("profile_version", F.col("click_count"))
