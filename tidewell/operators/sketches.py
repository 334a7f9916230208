"""Summaries that are stored by day and merged on read: quantiles with a bound on the relative error, distinct counts.

A quantile sketch is a table: a row a key and bucket, with a count. Bucket i holds values in (g ** (i - 1), g ** i] for
g = (1 + a) / (1 - a), and stands for 2 g ** i / (g + 1), which is off by a share of `a` at most. Counts add up, so days,
hours and tenants merge by a sum, and what leaves a window is taken off again.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Largest relative error of a quantile.
ALPHA = 0.01
#: Bucket of values that aren't positive; they stand for 0.
ZERO = -(2**31)


def _base(alpha: float) -> float:
    return (1 + alpha) / (1 - alpha)


def bucket(value: Column, alpha: float = ALPHA) -> Column:
    return F.when(value > 0, F.ceil(F.log(value.cast("double")) / F.lit(math.log(_base(alpha))))).otherwise(F.lit(ZERO)).cast("int")


def value_of(bucket_: Column, alpha: float = ALPHA) -> Column:
    g = _base(alpha)
    return F.when(bucket_ > ZERO, 2 * F.pow(F.lit(g), bucket_.cast("double")) / F.lit(g + 1)).otherwise(F.lit(0.0))


def sketch(rows: DataFrame, keys: list[str], value: Column, alpha: float = ALPHA) -> DataFrame:
    """keys, bucket, n; null and not-a-number values don't count. A key has some hundred buckets, however many rows."""
    kept = rows.where(value.isNotNull() & ~F.isnan(value.cast("double")))
    return kept.groupBy(*keys, bucket(value, alpha).alias("bucket")).agg(F.count("*").alias("n"))


def merged(sketches: DataFrame, keys: list[str]) -> DataFrame:
    return sketches.groupBy(*keys, "bucket").agg(F.sum("n").alias("n"))


def without(whole: DataFrame, part: DataFrame, keys: list[str]) -> DataFrame:
    """A sketch less one that was merged into it."""
    both = whole.unionByName(part.withColumn("n", -F.col("n")))
    return merged(both, keys).where("n > 0")


def moving(daily: DataFrame, keys: list[str], day: str, days: int) -> DataFrame:
    """keys, day, bucket, n: for each day that has rows, the sketch of it and of the days before, `days` together.

    Each bucket of a day is handed to the days whose window has it; no row is looked at again."""
    there = daily.select(*keys, day).distinct()
    spread = daily.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(days - 1))).alias("_ahead"), F.col(day).alias("_from"), "bucket", "n")
    spread = spread.withColumn(day, F.date_add("_from", F.col("_ahead"))).drop("_ahead", "_from")
    return merged(spread.join(there, [*keys, day], "left_semi"), [*keys, day])


def quantiles(sketch_: DataFrame, keys: list[str], shares: dict[str, float], alpha: float = ALPHA) -> DataFrame:
    """keys, total, and a column a share: the value of the bucket that holds rank share * (n - 1)."""
    by = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    upto = F.sum("n").over(by.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    placed = sketch_.withColumn("_upto", upto).withColumn("_all", F.sum("n").over(by))
    first = lambda share: F.round(value_of(F.min(F.when(F.col("_upto") > F.lit(float(share)) * (F.col("_all") - 1), F.col("bucket"))), alpha), 6)
    return placed.groupBy(*keys).agg(F.max("_all").alias("total"), *[first(s).alias(name) for name, s in shares.items()])


# ---- distinct counts


def distinct_sketch(rows: DataFrame, keys: list[str], value: str, digits: int = 12) -> DataFrame:
    """keys, sketch: of each group's distinct values, some kilobytes however many they are; off by some 2 % at 12 digits."""
    return rows.groupBy(*keys).agg(F.hll_sketch_agg(F.col(value), digits).alias("sketch"))


def distinct_count(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """keys, estimate over merged sketches."""
    return sketches.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"))
