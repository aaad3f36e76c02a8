"""Shared folder, keys and connected components for the operators of this package."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from weakref import WeakKeyDictionary

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_STASHED: dict[str, SparkSession] = {}
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where unset, as in tests, one of our own.

    Only a driver that runs the tasks itself may have one of its own: other machines don't see it.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="gridloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Sends 1,000 rows at once to Python where the session has Spark's own number: with long texts, ten times as many fill a worker's memory."""
    if spark.conf.get(BATCH) == "10000":
        spark.conf.set(BATCH, "1000")


A_FILE = 100_000


def files(spark: SparkSession, n: int) -> int:
    """How many files to write n rows or array elements to, of a hundred bytes or so each: as many as they fill, and one for each core at least.

    Hadoop's local file system starts a chmod for each file, checksum and folder of a task. Until such a child runs its own program, it shows the memory of the
    executor's JVM once more, and what adds up an executor's processes counts it twice; so there is no file for each shuffle partition.
    """
    return max(spark.sparkContext.defaultParallelism, n // A_FILE)


def stash(df: DataFrame, instead_of: Iterable[DataFrame] = (), by: str | None = None) -> DataFrame:
    """Cuts the lineage of df by a Parquet table in the shared folder, which outlives lost executors.

    The stashed tables in `instead_of`, which df alone still needed, are deleted once it is written;
    the others when the driver ends, or with `release`. The column `by` parts the table into folders, so that a filter on it reads its own alone.
    """
    spark = df.sparkSession
    bound_batches(spark)
    path = f"{shared_dir(spark)}/gridloom/{uuid.uuid4().hex}"
    df.write.parquet(path, partitionBy=by)
    if not _STASHED:
        atexit.register(release)
    _STASHED[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    for old in instead_of:
        drop(old)
    return out


def drop(stashed: DataFrame) -> None:
    """Deletes a stashed table; frames that read it must not be used any more."""
    path = _PATHS.pop(stashed, None)
    if path:
        _delete(path)


def _delete(path: str) -> None:
    spark = _STASHED.pop(path, None)
    if spark is None:
        return
    try:
        hadoop = spark._jvm.org.apache.hadoop.fs
        at = hadoop.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session has gone, and with it the way to the folder
        return


def release() -> None:
    """Deletes all stashed tables; frames that read them must not be used any more."""
    for path in list(_STASHED):
        _delete(path)


def free(taken: Iterable[str], *names: str) -> list[str]:
    """Each name, with as many underscores as keep it apart from the columns `taken`."""
    have, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out


def named(columns: Iterable[str]) -> list[Column]:
    """The columns of these names, whatever signs stand in them."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


def groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The rows of each key in turn, from batches sorted by `keys`; a group may stand in several batches."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        new = np.ones(len(pdf), dtype=bool)
        new[1:] = False
        for k in keys:
            c = pdf[k].to_numpy()
            new[1:] |= c[1:] != c[:-1]
        first = np.flatnonzero(new)
        if held and any(held[-1][k].iloc[-1] != pdf[k].iloc[0] for k in keys):
            yield pd.concat(held) if len(held) > 1 else held[0]
            held = []
        for a, b in zip(first, first[1:]):
            part = pdf.iloc[a:b]
            yield pd.concat([*held, part]) if held else part
            held = []
        held.append(pdf.iloc[first[-1] :])
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def key_of(doc_id: Column, text: Column) -> list[Column]:
    """A document's key in joins: its id (null: a negative number made from its text) and a hash of its text.

    Rows that repeat both are one document to every operator and get the same result.
    """
    th = F.xxhash64(F.coalesce(text, F.lit("")))
    return [F.coalesce(doc_id.cast("long"), -F.pmod(th, F.lit(2**62)) - 1).alias("d"), th.alias("th")]


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for each id on an edge (u, v), component being the least id that can be reached.

    Alternating large-star and small-star steps (Kiveris et al., Connected Components in MapReduce and
    Beyond, 2014): every step keeps at most as many edges as before, no step gathers a component
    in one place, and stars, which is what the callers emit, settle at once.
    """

    def spread(e: DataFrame) -> DataFrame:
        return e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))

    def large(e: DataFrame) -> DataFrame:
        both = spread(e)
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).hint("rebalance")  # dealt anew, so that the join can split a hot label
        return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()

    def small(e: DataFrame) -> DataFrame:
        down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m")).hint("rebalance")
        own = least.select("u", F.col("m").alias("v"))
        rest = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return own.unionByName(rest).distinct()

    def sign(e: DataFrame):
        return e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    at = stash(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = sign(at)
    while before[0]:
        at = stash(small(large(at)), instead_of=[at])
        now = sign(at)
        if now == before:
            break
        before = now
    pairs = at.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return pairs.unionByName(at.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
