"""Streams with timers over slices and restarts against plain replays, and the queue with a consumer that fails."""

import datetime
import random

import pytest

from tidewell.streaming import jobs, stateful

START = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)


@pytest.fixture(scope="module")
def log(spark):
    rng = random.Random(4)
    rows = [(i, START + datetime.timedelta(seconds=rng.randint(0, 200_000), microseconds=rng.randint(0, 999_999)), rng.randint(1, 5), rng.choice(["error", "error", "error", "purchase", "view", "click"]), float(rng.randint(1, 900))) for i in range(500)]
    rows += [(1000 + i, START + datetime.timedelta(seconds=100_000 + i), 9, "error", 1.0) for i in range(25)]  # dies
    return spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").repartition(4), rows


def micros(t):
    return round((t - datetime.datetime(1970, 1, 1, tzinfo=datetime.timezone.utc)).total_seconds() * 1_000_000)


def by_user(rows):
    users = {}
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        users.setdefault(r[2], []).append(r)
    return users


def test_retries_by_slices_and_at_once(spark, log):
    df, rows = log
    rows = [r for r in rows if r[3] in ("error", "purchase")]
    end, want = max(micros(r[1]) for r in rows) - 60_000_000, []
    for user, mine in by_user(rows).items():
        attempts = 0
        for r, later in zip(mine, [*mine[1:], None]):
            attempts = attempts + 1 if r[3] == "error" else 0
            if attempts >= 20:
                break
            due = micros(r[1]) + 1_000_000 * min(10 * 2 ** (attempts - 1), 3600) if attempts else None
            if due and due <= (micros(later[1]) if later else end):
                want.append((user, attempts, due))
    assert any(a > 5 for _, a, _ in want)
    for slices in (1, 4):
        assert sorted(map(tuple, stateful.retries(df, slices).collect())) == sorted(want)


def test_sessions_by_slices_and_at_once(spark, log):
    df, rows = log
    gap, end, want = 3_600_000_000, max(micros(r[1]) for r in rows) - 3_600_000_000, []
    for user, mine in by_user(rows).items():
        times = [micros(r[1]) for r in mine]
        cuts = [0, *(i for i in range(1, len(times)) if times[i] - times[i - 1] >= gap), len(times)]
        for low, high in zip(cuts, cuts[1:]):
            if high < len(times) or times[-1] + gap <= end:
                want.append((user, times[low], times[high - 1], high - low))
    for slices in (1, 4):
        assert sorted(map(tuple, stateful.sessions(df, slices, hours=1).collect())) == sorted(want)


def test_breakers_carry_their_window(spark, log):
    df, rows = log
    want = []
    for user, mine in by_user(rows).items():
        before = "closed"
        for at, state in jobs.breaker_steps(((micros(r[1]) // 1000, r[3] != "error", r[4]) for r in mine), window_ms=7_200_000):
            if state != before:
                want.append((user, at, state))
            before = state
    assert len(want) > 20 and sorted(map(tuple, stateful.breakers(df, 4, 7_200_000).collect())) == sorted(want)


def test_searches_and_clicks(spark, log):
    df, rows = log
    near = lambda s, c: s[3] == "view" and c[3] == "click" and s[2] == c[2] and datetime.timedelta(0) <= c[1] - s[1] <= datetime.timedelta(hours=2)
    want = sorted((s[0], c[0], s[2]) for s in rows for c in rows if near(s, c))
    assert want and sorted(map(tuple, stateful.search_to_click(df, 4, 2).collect())) == want


def test_a_consumer_that_fails_repeats_only_its_batch(spark, tmp_path):
    at, schema = f"file://{tmp_path}", "id long"
    stateful.publish(spark.range(0, 1200).coalesce(1), f"{at}/in", 500)
    seen, put = [], stateful.by_batch(f"{at}/out")

    def handle(rows, number):
        ids = sorted(r.id for r in rows.collect())
        seen.append((number, len(ids)))
        put(rows, number)
        if len(seen) == 2:
            raise RuntimeError("lost after the write, before it counts")

    with pytest.raises(Exception, match="lost after the write"):
        stateful.consume(spark, schema, f"{at}/in", handle, f"{at}/state").awaitTermination()
    stateful.publish(spark.range(1200, 1300).coalesce(1), f"{at}/in", 500)
    stateful.consume(spark, schema, f"{at}/in", handle, f"{at}/state").awaitTermination()
    assert [n for n, _ in seen] == [0, 1, 1, 2, 3] and seen[1] == seen[2] and max(k for _, k in seen) <= 500
    assert sorted(r.id for r in spark.read.parquet(f"{at}/out").collect()) == list(range(1300))


def test_a_consumer_that_goes_on(spark, tmp_path):
    import time

    at = f"file://{tmp_path}"
    stateful.publish(spark.range(0, 10), f"{at}/in")
    running = stateful.consume(spark, "id long", f"{at}/in", stateful.by_batch(f"{at}/out"), f"{at}/state", seconds=0.2, files=100)
    try:
        running.processAllAvailable()
        stateful.publish(spark.range(10, 30), f"{at}/in")
        time.sleep(0.3)
        running.processAllAvailable()
    finally:
        running.stop()
    assert sorted(r.id for r in spark.read.parquet(f"{at}/out").collect()) == list(range(30))
