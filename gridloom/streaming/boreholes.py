"""Boreholes as they arrive: results are appended for each batch of spreads, and a stopped run goes on where it was.

A batch writes the parts of its own spreads into a folder of its number in every part, then its spreads into the log, which makes them count. A batch that
was stopped has no log; it is run again with the same number and overwrites what it had written. Nothing that is there already is
written or read again, so a file of n boreholes costs n appends, not n rewrites. Spreads that arrive again are known by keyed state.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from gridloom.plans import boreholes

PARTS = tuple(p for p in boreholes.PARTS if p != "documents")
KEYS = ["doc_id", "spread"]
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass
class Figures:
    """How far a run is: spreads done and in all, and the counts of the last batch."""

    done: int
    total: int
    batch: int
    counts: dict[str, int] = field(default_factory=dict)


class Progress(StreamingQueryListener):
    """Adds up what queries that observe `arrived` report while they run; rows and spreads by query name."""

    def __init__(self) -> None:
        self.spreads: dict[str, int] = {}
        self.ended: set[str] = set()

    def onQueryStarted(self, event) -> None:
        self.spreads.setdefault(event.name, 0)

    def onQueryProgress(self, event) -> None:
        seen = event.progress.observedMetrics.get("arrived")
        if seen is not None:
            self.spreads[event.progress.name] = self.spreads.get(event.progress.name, 0) + (seen["spreads"] or 0)

    def onQueryIdle(self, event) -> None:
        return

    def onQueryTerminated(self, event) -> None:
        self.ended.add(str(event.id))


def there(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def log(spark: SparkSession, out: str) -> DataFrame:
    """(doc_id, spread, batch) of the spreads that are done."""
    return spark.read.parquet(f"{out}/log") if there(spark, f"{out}/log") else spark.createDataFrame([], "doc_id string, spread long, batch int")


def follow(
    spreads: DataFrame, pages: DataFrame, objects: DataFrame, plan: Callable[[DataFrame, DataFrame], boreholes.Result], out: str, checkpoint: str,
    told: Callable[[Figures], None] | None = None, name: str | None = None,
) -> StreamingQuery:
    """Starts a query over the stream `spreads` (doc_id, spread) of spreads whose images and words are there.

    pages (doc_id, page) lists every page of the files, so that a borehole's number doesn't depend on what has arrived; plan makes a result of all
    pages and a batch's objects, as `boreholes.run` does. `told` gets the figures after every batch, before the next one begins.
    """
    spark = pages.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    total = pages.select("doc_id", F.floor(F.col("page") / 2)).distinct().count()
    done = log(spark, out).count()

    def each(batch: DataFrame, number: int) -> None:
        nonlocal done
        new, kept = batch.select(*KEYS).persist(), []
        try:
            page = F.floor(F.col("page") / 2).cast("long").alias("spread")
            own = objects.join(new, (objects["doc_id"] == new["doc_id"]) & (F.floor(objects["page"] / 2) == new["spread"]), "left_semi")
            of = pages.join(new.select("doc_id").distinct(), "doc_id", "left_semi")
            result = plan(of, own)
            kept = [result.cells.persist(), result.fields.persist()]  # the other parts come from them
            counts: dict[str, int] = {}
            for part in PARTS:
                seen = Observation()
                found = getattr(result, part)
                review = F.count_if("needs_review") if "needs_review" in found.columns else F.count_if(F.lit(False))
                rows = found.join(new, KEYS, "left_semi").observe(seen, F.count(F.lit(1)).alias("rows"), review.alias("review"))
                rows.write.mode("overwrite").parquet(f"{out}/{part}/batch={number}")
                counts |= {part: seen.get["rows"]} | ({"review": seen.get["review"]} if part == "meta" else {})
            there_ = of.select("doc_id", page).distinct().join(new, KEYS, "left_semi")
            arrived = Observation()
            there_.observe(arrived, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{out}/log/batch={number}")
            done += arrived.get["n"]
        finally:
            for df in (new, *kept):
                df.unpersist()
        if told:
            told(Figures(done, total, number, counts))

    once = spreads.select(*KEYS).dropDuplicates(KEYS).observe("arrived", F.count(F.lit(1)).alias("spreads"))
    writer = once.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return (writer.queryName(name) if name else writer).start()


def finished(spark: SparkSession, out: str) -> boreholes.Result:
    """What the batches in the log have written; files' figures are summed from it."""
    counted = F.broadcast(log(spark, out).select("batch").distinct())  # one row for each batch of a run
    parts = {p: spark.read.option("basePath", f"{out}/{p}").parquet(f"{out}/{p}").join(counted, "batch", "left_semi").drop("batch") for p in PARTS}
    return boreholes.Result(documents=boreholes.document_figures(parts["boreholes"], parts["meta"]), **parts)
