"""Sinks and sources on the shared file system: the daily log archive, judgment files, snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_daily(events: DataFrame, path: str) -> None:
    """The log by day; rows of a day lie together, so pruning reads only asked days."""
    events.withColumn("event_date", F.date_format("created_at", "yyyy-MM-dd")).repartition("event_date").write.mode("overwrite").partitionBy("event_date").parquet(path)


def read_days(spark: SparkSession, path: str, first: str, last: str) -> DataFrame:
    """Days first to last, both included; other folders aren't opened."""
    return spark.read.parquet(path).withColumn("event_date", F.col("event_date").cast("string")).where(F.col("event_date").between(first, last))


def partitions(spark: SparkSession, path: str) -> DataFrame:
    """The days there are, from folder names alone."""
    return spark.read.parquet(path).select(F.col("event_date").cast("string").alias("day")).distinct().orderBy("day")


def drop_before(spark: SparkSession, path: str, day: str) -> list[str]:
    """Remove the folders of earlier days; names of those removed. A day is one folder, so this reads no rows."""
    gone = [r.day for r in partitions(spark, path).where(F.col("day") < day).collect()]  # a row a day
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for d in gone:
        target = jvm.org.apache.hadoop.fs.Path(f"{path}/event_date={d}")
        target.getFileSystem(conf).delete(target, True)
    return gone


def write_judgments(judgments: DataFrame, path: str) -> None:
    judgments.write.mode("overwrite").json(path)


def snapshot(points: DataFrame, root: str, version: str) -> str:
    """A versioned copy of the vectors; a version is never written twice."""
    points.write.mode("errorifexists").parquet(f"{root}/{version}")
    return f"{root}/{version}"
