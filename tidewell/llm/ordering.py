"""Places of rows in sorted groups of any size: one range sort, and a row of each group in each stretch of the order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Rows up to which the starts of stretches are sent to every task; beyond it they join by shuffle.
BROADCAST_ROWS = 20_000


def placed(rows: DataFrame, group: str, order: list, name: str) -> DataFrame:
    """rows with `place`, from 0 in their group by this order, and `members`, the rows of the group.

    The group must not be null. Rows are written as they come and again in order, so they should be narrow; equal rows
    get places in the order in which they were written, and are dealt to as many tasks as others.
    """
    if "_row" not in rows.columns:
        rows, _ = materialize(rows.withColumn("_row", F.monotonically_increasing_id()), name)
    numbered = rows.orderBy(group, *order, "_row").withColumn("_id", F.monotonically_increasing_id())
    ordered, _ = materialize(numbered.withColumn("_part", F.shiftright("_id", 33)).withColumn("_at", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_id"), name)
    mine = Window.partitionBy(group)
    parts = ordered.groupBy(group, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    ahead = F.coalesce(F.sum("_n").over(mine.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts, _ = materialize(parts.select(group, "_part", (ahead - F.col("_first")).alias("_shift"), F.sum("_n").over(mine).alias("members")), "starts")
    starts = F.broadcast(starts) if starts.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else starts
    return ordered.join(starts, [group, "_part"]).withColumn("place", F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift")
