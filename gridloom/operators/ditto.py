"""Repeat marks: expansion down a column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.functions import text as X


def expand(cells: DataFrame, keys: list[str], order: list[str], text: str = "text", when: F.Column | None = None) -> DataFrame:
    """Adds value and expanded: a repeat mark takes the last value above it.

    A blank neither takes a value nor ends one; a mark with nothing above it stays as it is, not expanded.
    `when` limits expansion to some rows (labelled tables leave out column 0).
    """
    above = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    mark = X.is_ditto(F.col(text))
    filled = ~mark & (X.strict(F.col(text)) != "")
    last = F.last(F.when(filled, F.col(text)), ignorenulls=True).over(above)
    hit = mark & last.isNotNull() & (F.lit(True) if when is None else when)
    return cells.withColumns({"_hit": hit, "_last": last}).withColumns({"value": F.when(F.col("_hit"), F.col("_last")).otherwise(F.col(text)), "expanded": F.col("_hit")}).drop("_hit", "_last")
