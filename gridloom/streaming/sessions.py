"""Rows of words that arrive over time, and incremental, restartable output."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

GAP = "6 hours"
REPLIES = "key string, reply string, known boolean"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a driver that runs the tasks itself may have one of its own where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="gridloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def by_gap(words: DataFrame, gap: str = GAP, late: str | None = None) -> DataFrame:
    """(table_id, first, last, n): runs of words no further apart than gap, the same for a table and for a stream.

    A stream needs `late`, the lateness to wait for; a run is given out when the watermark has passed its end.
    """
    at = words.withColumn("at", F.timestamp_micros("y"))
    at = at if late is None else at.withWatermark("at", late)
    found = at.groupBy("table_id", F.session_window("at", gap)).agg(F.min("y").alias("first"), F.max("y").alias("last"), F.count(F.lit(1)).alias("n"))
    return found.select("table_id", "first", "last", "n")


def recognise_new(requests: DataFrame, cache_path: str, recognise: Callable[[DataFrame], DataFrame], checkpoint: str, key: str = "key") -> StreamingQuery:
    """Recognises each request's content once: hits of the cache table are skipped, results are appended as one file a batch.

    A batch that is run again after a failure overwrites its own folder, so results are there once.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates([key])
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(cache_path)
        if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
            known = spark.read.option("basePath", cache_path).parquet(cache_path).where(F.col("batch") != number)
            fresh = fresh.join(known.select(key), key, "left_anti")
        recognise(fresh).write.mode("overwrite").parquet(f"{cache_path}/batch={number}")

    return requests.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def appended(stream: DataFrame) -> DataFrame:
    """Runs a stream over all that is there, in append mode, and reads what it has given out."""
    spark = stream.sparkSession
    at = f"{shared_dir(spark)}/gridloom/{uuid.uuid4().hex}"
    writer = stream.writeStream.outputMode("append").format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state")
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


class Replies(StatefulProcessor):
    """Keeps the reply of each key; a key without one is asked for, once for all rows of a batch, and a failure is not kept."""

    def __init__(self, ask: Callable[[bytes], str | None]):
        self.ask = ask

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.reply = handle.getValueState("reply", "reply string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.reply.exists()
        reply = self.reply.get()[0] if known else None
        n = 0
        for pdf in rows:
            if not known and not n and len(pdf):
                reply = self.ask(bytes(pdf["image"].iloc[0]))
            n += len(pdf)
        if reply is not None and not known:
            self.reply.update((reply,))
        yield pd.DataFrame({"key": [key[0]] * n, "reply": pd.Series([reply] * n, dtype=object), "known": [known] * n})

    def close(self) -> None:
        return


def recognised(requests: DataFrame, ask: Callable[[bytes], str | None]) -> DataFrame:
    """(key, reply, known) of each row of a stream (key, image): what was recognised in an earlier batch is taken from keyed state.

    A batch reads the state of its own keys alone, so its cost doesn't grow with what is known. A failure gives a null reply and is asked for again when the key comes again.
    """
    requests.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return requests.select("key", "image").groupBy("key").transformWithStateInPandas(Replies(ask), REPLIES, "Append", "None")
