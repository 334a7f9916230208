"""Keyed state with timers: retries, sessions and breakers that don't depend on how the stream is cut into batches.

State lives in the state store: single values, and a list for a breaker's window. What is due by the stream's own time
is handed out by timers, or by the next event of the key where that comes first; so many small batches, with restarts in
between, give what one batch gives. Events of a key must come in the order of time, within the watermark's delay.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewell.sources.scratch import folder
from tidewell.streaming.jobs import Breaker

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def keyed_state(spark: SparkSession):
    """The state store that timers and lists need, for streams started within."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


def _in_order(rows: Iterator[Row], *columns: str):
    """The rows in the order of time, as tuples."""
    return [tuple(r[c] for c in columns) for r in sorted(rows, key=lambda r: (r["micros"], r["event_id"]))]


def _timer(handle: StatefulProcessorHandle, before: int | None, micros: int | None) -> None:
    """A key has one timer at most: this one, rounded up to a millisecond, in place of the one before."""
    old, new = (None if t is None else -(-t // 1000) for t in (before, micros))
    if old != new:
        if old is not None:
            handle.deleteTimer(old)
        if new is not None:
            handle.registerTimer(new)


class Retries(StatefulProcessor):
    """attempts, status, due of a row in the queue. An error is a failed attempt and is due again after its backoff, `most`
    in a row make it dead, a purchase settles it. A row for each time an attempt fell due."""

    schema, state_schema = "user_id long, attempts int, due long", "attempts int, status string, due long"

    def __init__(self, most: int = 20, base: int = 10, longest: int = 3600):
        self.most, self.base, self.longest = most, base, longest

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("retry", self.state_schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        attempts, status, due = self.state.get() or (0, "pending", 0)
        out, before = [], due if status == "failed" else None
        for kind, at in _in_order(rows, "event_type", "micros"):
            if status == "dead":
                break
            if status == "failed" and due <= at:
                out.append(Row(user_id=key[0], attempts=attempts, due=due))
            if kind == "error":
                attempts, due = attempts + 1, at + 1_000_000 * min(self.base * 2**attempts, self.longest)
                status = "dead" if attempts >= self.most else "failed"
            else:
                attempts, status, due = 0, "done", 0
        self.state.update((attempts, status, due))
        _timer(self.handle, before, due if status == "failed" else None)
        return iter(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        attempts, status, due = self.state.get() or (0, "done", 0)
        if status == "failed" and -(-due // 1000) <= expiredTimerInfo.getExpiryTimeInMs():
            self.state.update((attempts, "due", due))
            return iter([Row(user_id=key[0], attempts=attempts, due=due)])
        return iter(())

    def close(self) -> None:
        pass


class Sessions(StatefulProcessor):
    """first, last, n of a user's open session. A row for each session that ended: by a gap, or by a timer after it, which
    also takes the state away."""

    schema, state_schema = "user_id long, first long, last long, n long", "first long, last long, n long"

    def __init__(self, gap_micros: int):
        self.gap = gap_micros

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("session", self.state_schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        first, last, n = self.state.get() or (None, None, 0)
        out, before = [], last + self.gap if n else None
        for (at,) in _in_order(rows, "micros"):
            if n and at - last >= self.gap:
                out.append(Row(user_id=key[0], first=first, last=last, n=n))
                n = 0
            first, last, n = (at if not n else first), at, n + 1
        if n:
            self.state.update((first, last, n))
            _timer(self.handle, before, last + self.gap)
        return iter(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        first, last, n = self.state.get() or (None, None, 0)
        if n and -(-(last + self.gap) // 1000) <= expiredTimerInfo.getExpiryTimeInMs():
            self.state.clear()
            return iter([Row(user_id=key[0], first=first, last=last, n=n)])
        return iter(())

    def close(self) -> None:
        pass


class Breakers(StatefulProcessor):
    """A breaker a user: its window as a list, its state and when it opened as a value. A row for each change."""

    schema, state_schema, list_schema = "user_id long, at long, state string", "state string, opened long", "at long, ok boolean, latency double"

    def __init__(self, window_ms: int):
        self.window_ms = window_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state, self.window = handle.getValueState("breaker", self.state_schema), handle.getListState("window", self.list_schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        state, opened = self.state.get() or ("closed", 0)
        breaker = Breaker(self.window_ms, state=state, opened=opened, seen=list(self.window.get()))
        out = []
        for at, kind, value in _in_order(rows, "micros", "event_type", "value"):
            before = breaker.state
            if breaker.step(at // 1000, kind != "error", value) != before:
                out.append(Row(user_id=key[0], at=at // 1000, state=breaker.state))
        self.state.update((breaker.state, int(breaker.opened)))
        self.window.put([(int(a), bool(o), float(v)) for a, o, v in breaker.seen])
        return iter(out)

    def close(self) -> None:
        pass


def keyed(stream: DataFrame, key: str, processor: StatefulProcessor, mode: str = "EventTime") -> DataFrame:
    return stream.groupBy(key).transformWithState(statefulProcessor=processor, outputStructType=processor.schema, outputMode="Append", timeMode=mode)


def in_slices(events: DataFrame, flow, slices: int = 3, order: str = "ts") -> DataFrame:
    """flow(stream) over events that arrive slice by slice in their order, stopped after each and started again from its
    checkpoint. The sink's rows; the sink takes each row once."""
    spark, at = events.sparkSession, folder(events.sparkSession, "streams")
    bounds = events.agg(F.percentile_approx(order, [k / slices for k in range(1, slices)])).first()[0] or []
    place = F.lit(0)
    for b in bounds:
        place = place + F.when(F.col(order) > F.lit(b), 1).otherwise(0)
    out = None
    with keyed_state(spark):
        for k in range(slices):
            events.where(place == k).write.mode("append").parquet(f"{at}/in")
            out = flow(spark.readStream.schema(events.schema).parquet(f"{at}/in"))
            out.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{at}/out")


def _timed(stream: DataFrame, late: str) -> DataFrame:
    return stream.withColumn("micros", F.unix_micros("ts")).withWatermark("ts", late)


def retries(events: DataFrame, slices: int = 3, late: str = "1 minute", most: int = 20) -> DataFrame:
    """user_id, attempts, due (microseconds) of every retry that fell due. events: event_id, ts, user_id, event_type."""
    rows = events.where("event_type in ('error', 'purchase')").select("event_id", "ts", "user_id", "event_type")
    return in_slices(rows, lambda s: keyed(_timed(s, late), "user_id", Retries(most)), slices)


def sessions(events: DataFrame, slices: int = 3, hours: int = 24, late: str = "1 hour") -> DataFrame:
    """user_id, first, last, n of every session that ended by the stream's own time."""
    rows = events.select("event_id", "ts", "user_id")
    return in_slices(rows, lambda s: keyed(_timed(s, late), "user_id", Sessions(hours * 3_600_000_000)), slices)


def breakers(events: DataFrame, slices: int = 3, window_ms: int = 24 * 3_600_000) -> DataFrame:
    """user_id, at (milliseconds), state of every change of a user's breaker."""
    rows = events.select("event_id", "ts", "user_id", "event_type", "value")
    return in_slices(rows, lambda s: keyed(s.withColumn("micros", F.unix_micros("ts")), "user_id", Breakers(window_ms), "None"), slices)


def search_to_click(events: DataFrame, slices: int = 3, hours: int = 6, late: str = "2 hours") -> DataFrame:
    """search_id, click_id, user_id: a user's clicks within some hours of a search, joined as both arrive.

    Each side keeps a row until the other's watermark has passed the time in which a partner may come.
    """
    rows = events.where("event_type in ('view', 'click')").select("event_id", "ts", "user_id", "event_type")

    def flow(stream: DataFrame) -> DataFrame:
        side = lambda kind, name: stream.where(F.col("event_type") == kind).select(F.col("event_id").alias(f"{name}_id"), F.col("ts").alias(f"{name}_at"), F.col("user_id").alias(f"{name}_user")).withWatermark(f"{name}_at", late)
        near = F.expr(f"search_user = click_user and click_at >= search_at and click_at <= search_at + interval {hours} hours")
        return side("view", "search").join(side("click", "click"), near).select("search_id", "click_id", F.col("click_user").alias("user_id"))

    return in_slices(rows, flow, slices)


# ---- the queue


def publish(rows: DataFrame, path: str, most: int = 500) -> None:
    """Append rows to a queue: files of at most `most` rows, each a batch for the consumer."""
    rows.write.mode("append").option("maxRecordsPerFile", most).parquet(path)


def consume(spark: SparkSession, schema: str, path: str, handle, checkpoint: str, seconds: float | None = None, files: int = 1, name: str | None = None):
    """A running query that hands each batch of the queue to handle(rows, number).

    A batch counts as done when handle returns; one that fails is handed out again with the same rows and number, and
    nothing after it is. With `files` it takes as many of the queue's batches at once, as a trigger costs the same for one
    as for many; a column `name` then tells them apart. With `seconds` it looks for new files that often and goes on
    until stopped; else it ends when the queue is used up.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
    if name:
        stream = stream.withColumn(name, F.col("_metadata.file_name"))
    trigger = {"processingTime": f"{seconds} seconds"} if seconds else {"availableNow": True}
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def by_batch(path: str):
    """A handler that writes each batch under its number, so one that is handed out again replaces itself."""
    return lambda rows, number: rows.write.mode("overwrite").parquet(f"{path}/batch={number}")
