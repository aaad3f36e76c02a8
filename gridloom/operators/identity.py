"""Which hole a page belongs to, and what its sheets are called."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.functions import text as X
from gridloom.plans import specs


def spreads(pages: DataFrame, keys: list[str], page: str, canonical: list[int] | DataFrame | None = None, subset: bool = False) -> DataFrame:
    """Adds spread (two pages each), position (from 1 in its document) and hole: the canonical list's number, else the position.

    canonical: one list for all documents, or (keys, numbers array<long>) of those that have one. A list of another
    length than a document's spreads raises an error. With `subset`, pages are some of a document's: then
    numbers go by the spread itself, and by its place where the list is too short.
    """
    at = pages.withColumn("spread", F.floor(F.col(page) / 2).cast("long"))
    at = at.withColumn("position", F.dense_rank().over(Window.partitionBy(*keys).orderBy("spread")))
    if canonical is None:
        return at.withColumn("hole", F.col("position").cast("long"))
    if isinstance(canonical, DataFrame):
        at = at.join(canonical.select(*keys, F.col("numbers").cast("array<long>").alias("_numbers")), keys, "left")
    else:
        at = at.withColumn("_numbers", F.array(*[F.lit(x).cast("long") for x in canonical]))
    if subset:
        number = F.coalesce(F.get("_numbers", F.col("spread").cast("int")), F.when(F.col("_numbers").isNotNull(), F.col("spread") + 1), F.col("position").cast("long"))
        return at.withColumn("hole", number).drop("_numbers")
    most, n = F.max("position").over(Window.partitionBy(*keys)), F.size("_numbers")
    wrong = F.raise_error(F.format_string("%d spreads but %d numbers", most, n))
    number = F.when(F.col("_numbers").isNull(), F.col("position").cast("long")).when(most != n, wrong).otherwise(F.get("_numbers", F.col("position") - 1))
    return at.withColumn("hole", number).drop("_numbers")


def hole_hint(fields: DataFrame, keys: list[str], order: str = "ord") -> DataFrame:
    """(keys, hint): the first whole number in a field named for the hole; '1' where there is none."""
    number = F.regexp_extract(F.coalesce("value", F.lit("")), r"\p{Nd}+", 0)
    named = F.contains(F.lower("key"), F.lit("скважина"))
    return fields.groupBy(*keys).agg(F.coalesce(F.min_by(F.when(named & (number != ""), number), F.when(named & (number != ""), F.col(order))), F.lit("1")).alias("hint"))


def sheet_name(kind: F.Column, hole: F.Column) -> F.Column:
    return F.concat(F.lit("скв"), hole.cast("string"), F.lit("_"), F.coalesce(F.try_element_at(X.literal_map(specs.SHEET_NAMES), kind), kind))


def safe_name(name: F.Column) -> F.Column:
    """Cut to 31 characters, with those that a workbook forbids as underscores."""
    return F.substring(F.regexp_replace(name, r"[\[\]:*?/\\]", "_"), 1, 31)


def clashes(names: DataFrame, name: str) -> DataFrame:
    """(name, n) of names used more than once: writers refuse these."""
    return names.groupBy(name).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
