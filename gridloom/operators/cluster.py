"""Rows from positions: gap clustering, nearest centres, pitch.

All work is per table: one exchange on the table's key serves the windows that follow each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def gap_groups(df: DataFrame, keys: list[str], y: str, tol: Column | float, order: list[str], into: str = "grp") -> DataFrame:
    """Numbers runs of y, per key, from 0; a gap greater than tol begins a new one, one equal to it doesn't."""
    w = Window.partitionBy(*keys).orderBy(y, *order)
    tol = tol if isinstance(tol, Column) else F.lit(tol)
    new = F.coalesce((F.col(y) - F.lag(y).over(w) > tol).cast("int"), F.lit(0))
    return df.withColumn("_new", new).withColumn(into, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_new")


def centres(grouped: DataFrame, keys: list[str], y: str, group: str = "grp") -> DataFrame:
    """(keys, ri, cy, n): the mean of each group, summed exactly before it is divided."""
    return grouped.groupBy(*keys, F.col(group).alias("ri")).agg((F.sum(y).cast("double") / F.count(F.lit(1))).alias("cy"), F.count(F.lit(1)).alias("n"))


def nearest(df: DataFrame, centre: DataFrame, keys: list[str], y: str) -> DataFrame:
    """Adds ri and dist of the nearest centre of the same key; the lower index wins a tie.

    Centres rise with their index, so the nearest is the last at or below y or the first above
    it: two windows over the union of both, where a join would pair every word with every centre.
    """
    points = df.withColumns({"_at": F.col(y).cast("double"), "_c": F.lit(None).cast("struct<ri:int,cy:double>"), "_kind": F.lit(1)})
    marks = centre.select(*keys, F.col("cy").alias("_at"), F.struct(F.col("ri").cast("int").alias("ri"), F.col("cy").cast("double").alias("cy")).alias("_c"), F.lit(0).alias("_kind"))
    both = points.unionByName(marks, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("_at", "_kind")
    below = F.last("_c", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    above = F.first("_c", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    found = both.withColumns({"_b": below, "_a": above}).where("_kind = 1")
    to_b, to_a = F.abs(F.col("_at") - F.col("_b.cy")), F.abs(F.col("_a.cy") - F.col("_at"))
    first = to_a.isNull() | (to_b <= to_a)
    return found.withColumns({"ri": F.when(first, F.col("_b.ri")).otherwise(F.col("_a.ri")), "dist": F.when(first, to_b).otherwise(to_a)}).drop("_at", "_c", "_kind", "_a", "_b")


def clustered(words: DataFrame, tol: Column | float) -> DataFrame:
    """Adds grp, cy (its centre) and ri, the nearest centre, to words (table_id, word_id, y): the own group's or a neighbouring one's, the lower of equals.

    All windows are over the table, so one exchange serves them.
    """
    at = gap_groups(words, ["table_id"], "y", tol, ["word_id"])
    group = Window.partitionBy("table_id", "grp")
    at = at.withColumn("cy", F.sum("y").over(group).cast("double") / F.count(F.lit(1)).over(group))
    ordered = Window.partitionBy("table_id").orderBy("grp")
    sides = [(-1, F.max("cy").over(ordered.rangeBetween(-1, -1))), (0, F.col("cy")), (1, F.max("cy").over(ordered.rangeBetween(1, 1)))]
    at = at.withColumn("_near", F.array(*[F.struct(F.coalesce(F.abs(F.col("y") - c), F.lit(float("inf"))).alias("dist"), (F.col("grp") + i).alias("ri")) for i, c in sides]))
    return at.withColumn("ri", F.array_min("_near")["ri"].cast("int")).drop("_near")


def pitch(centre: DataFrame, keys: list[str], alone: Column | float) -> DataFrame:
    """(keys, pitch): the median distance of neighbouring centres; `alone` for a table of one row."""
    w = Window.partitionBy(*keys).orderBy("ri")
    gaps = centre.withColumn("gap", F.lead("cy").over(w) - F.col("cy"))
    alone = alone if isinstance(alone, Column) else F.lit(alone)
    return gaps.groupBy(*keys).agg(F.median("gap").alias("m")).select(*keys, F.coalesce("m", alone).alias("pitch"))


def lines_by_first(df: DataFrame, keys: list[str], tol: float) -> DataFrame:
    """Reading order of lines in bands anchored at their first y: adds band and place, from 0.

    The anchor depends on all earlier lines, which no window frame can say: a page's lines, some hundreds, are folded in order, carrying the anchor.
    """
    order = F.struct(F.col("y0").isNull().alias("n0"), F.col("y0").cast("double").alias("y"), F.col("x0").isNull().alias("n1"), "x0", F.col("line_id").alias("id"), F.struct(*df.columns).alias("row"))
    page = df.groupBy(*[F.col(k).alias(f"_{i}") for i, k in enumerate(keys)]).agg(F.array_sort(F.collect_list(order)).alias("lines"))
    start = F.struct(F.lit(None).cast("double").alias("anchor"), F.lit(-1).alias("n"), F.array().cast("array<int>").alias("bands"))

    def step(acc: Column, line: Column) -> Column:
        new = (acc["n"] < 0) | F.coalesce(F.abs(line["y"] - acc["anchor"]) > tol, F.lit(False))
        n = F.when(new, acc["n"] + 1).otherwise(acc["n"])
        return F.struct(F.when(new, line["y"]).otherwise(acc["anchor"]).alias("anchor"), n.alias("n"), F.concat(acc["bands"], F.array(n)).alias("bands"))

    bands = F.aggregate("lines", start, step, lambda acc: acc["bands"])
    placed = F.zip_with("lines", bands, lambda line, band: F.struct(band.alias("band"), line["n1"].alias("n1"), line["x0"].alias("x0"), line["id"].alias("id"), line["row"].alias("row")))
    return page.select(F.posexplode(F.array_sort(placed)).alias("place", "line")).select("line.row.*", "line.band", "place")


def uniform_bands(centre: DataFrame, keys: list[str], low: float = 0.55, high: float = 1.7) -> DataFrame:
    """(keys, ri, top, bottom): neighbouring centres whose distance is within these shares of the median distance, both ends included."""
    w = Window.partitionBy(*keys).orderBy("ri")
    gaps = centre.withColumns({"bottom": F.lead("cy").over(w), "gap": F.lead("cy").over(w) - F.col("cy")}).where("gap is not null")
    middle = gaps.groupBy(*keys).agg(F.median("gap").alias("m"))
    return gaps.join(middle, keys).where((F.col("gap") >= low * F.col("m")) & (F.col("gap") <= high * F.col("m"))).select(*keys, "ri", F.col("cy").alias("top"), "bottom")
