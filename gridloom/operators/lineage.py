"""Cutting the lineage of iterative work by tables in the folder that all machines share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where none is, a local master gets one of its own and any other an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.conf.set("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="rounds-"))
    return spark.conf.get("spark.checkpoint.dir")


def place(spark: SparkSession) -> str:
    """A new path in the shared folder, deleted when the driver ends."""
    path = f"{shared_folder(spark)}/rounds/{uuid.uuid4().hex}"
    if not _WRITTEN:
        atexit.register(_delete)
    _WRITTEN[path] = spark
    return path


def cut(df: DataFrame) -> DataFrame:
    """df as a Parquet table. Unlike a checkpoint it carries no predicates of the plans before, which multiply from round to round; it goes when the driver ends."""
    path = place(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete() -> None:
    for path, spark in _WRITTEN.items():
        if spark.sparkContext._jsc is not None:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _WRITTEN.clear()
