"""Quantile sketches against sorted values, merged and taken apart; distinct counts; empty and odd values."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.operators import sketches as K

SHARES = {"low": 0.0, "mid": 0.5, "high": 0.95, "top": 1.0}


@pytest.fixture(scope="module")
def log(spark):
    rng = np.random.default_rng(2)
    day = datetime.date(2024, 1, 1)
    rows = [(f"t{i % 3}", day + datetime.timedelta(days=int(rng.integers(0, 12))), float(x), int(rng.integers(0, 3000))) for i, x in enumerate(np.exp(rng.normal(3, 2, 6000)))]
    rows += [("t0", day, 0.0, 1), ("t0", day, -3.0, 1), ("t1", day, None, None), ("t1", day, float("nan"), 1), ("t2", day, 1e-9, 1), ("t2", day, 1e12, 1)]
    return spark.createDataFrame(rows, "tenant string, day date, value double, user long").repartition(4), rows


def plain(values, share):
    v = sorted(max(x, 0.0) for x in values if x is not None and x == x)
    return v[int(np.floor(share * (len(v) - 1) + 1e-9))]


def close(got, want, alpha=K.ALPHA):
    return abs(got - want) <= alpha * want + 2e-6


def test_quantiles_are_within_the_bound(spark, log):
    df, rows = log
    daily = K.sketch(df, ["tenant", "day"], F.col("value"))
    got = K.quantiles(K.merged(daily, ["tenant"]), ["tenant"], SHARES).collect()
    assert len(got) == 3
    for r in got:
        values = [x[2] for x in rows if x[0] == r.tenant]
        assert r.total == sum(x is not None and x == x for x in values)
        assert all(close(r[name], plain(values, share)) for name, share in SHARES.items())
    one = K.quantiles(K.merged(daily, []), [], SHARES).first()
    assert all(close(one[name], plain([x[2] for x in rows], share)) for name, share in SHARES.items())
    # Merging sketches is the sketch of all, and taking a day off is the sketch of the others.
    key = lambda d: sorted(map(tuple, d.select("tenant", "bucket", "n").collect()))
    assert key(K.merged(daily, ["tenant"])) == key(K.sketch(df, ["tenant"], F.col("value")))
    first = F.col("day") == F.lit("2024-01-01").cast("date")
    assert key(K.without(K.merged(daily, ["tenant"]), K.merged(daily.where(first), ["tenant"]), ["tenant"])) == key(K.sketch(df.where(~first), ["tenant"], F.col("value")))


def test_moving_windows_look_at_no_row_again(spark, log):
    df, rows = log
    got = K.quantiles(K.moving(K.sketch(df, ["tenant", "day"], F.col("value")), ["tenant"], "day", 4), ["tenant", "day"], SHARES).collect()
    assert len(got) == len({x[:2] for x in rows})
    for r in got:
        values = [x[2] for x in rows if x[0] == r.tenant and 0 <= (r.day - x[1]).days < 4]
        assert r.total == sum(x is not None and x == x for x in values) and close(r.high, plain(values, 0.95)) and close(r.mid, plain(values, 0.5))


def test_size_does_not_follow_the_rows(spark):
    many = spark.range(200_000).select(F.lit("a").alias("k"), (F.col("id") % 5000 + 1).alias("v"))
    assert K.sketch(many, ["k"], F.col("v")).count() < 500


def test_distinct_counts_merge(spark, log):
    df, rows = log
    daily = K.distinct_sketch(df, ["tenant", "day"], "user")
    for r in K.distinct_count(daily, ["tenant"]).collect():
        want = len({x[3] for x in rows if x[0] == r.tenant and x[3] is not None})
        assert abs(r.estimate - want) <= 0.06 * want
    assert K.distinct_count(daily.limit(0), ["tenant"]).collect() == [] and K.quantiles(K.sketch(df.limit(0), ["tenant"], F.col("value")), ["tenant"], SHARES).collect() == []
