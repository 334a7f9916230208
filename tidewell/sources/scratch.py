"""Folders and tables on the file system that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []
_OWN: set[str] = set()


def folder(spark: SparkSession, kind: str = "scratch") -> str:
    """A new folder under the session's shared one; the application's folder goes when the driver ends.

    Only a local master may do without a shared folder: on several machines each would write to its own disk.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _LOCAL:
            _LOCAL.append(tempfile.mkdtemp(prefix="tidewell-"))
            atexit.register(shutil.rmtree, _LOCAL[0], True)
        root = f"file://{_LOCAL[0]}"
    own = f"{root}/tidewell-{spark.sparkContext.applicationId}"
    if own not in _OWN:
        _OWN.add(own)
        atexit.register(_sweep, spark, own)
    return f"{own}/{kind}/{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


def _sweep(spark: SparkSession, path: str) -> None:
    """At the end of the driver; a gateway that is gone by then can't."""
    try:
        remove(spark, path)
    except Exception:
        pass


def stored(df: DataFrame) -> DataFrame:
    """df written once and read back, for results that several later steps read."""
    return _written(df, folder(df.sparkSession, "tables"))


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables that nothing reads after the block: an iteration's intermediate results."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        return self

    def stored(self, df: DataFrame) -> DataFrame:
        self.paths.append(folder(self.spark, "steps"))
        return _written(df, self.paths[-1])

    def __exit__(self, *_) -> None:
        for path in self.paths:
            remove(self.spark, path)
