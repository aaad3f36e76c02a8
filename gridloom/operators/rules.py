"""Ruled lines and regions of images as relations: dark pixels are runs (keys, line, start, end), end excluded.

Lines are rows of pixels, or columns of a turned image. keys name an image and aren't null; runs of a line neither meet nor overlap.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.operators.cluster import gap_groups
from gridloom.operators.lineage import cut

BLOCK = 64


def turned(pixels: Column, height: Column | int, width: Column | int) -> Column:
    """The pixels of an image kept row by row, column by column."""
    height, width = (x if isinstance(x, Column) else F.lit(x) for x in (height, width))
    each = F.transform(F.sequence(F.lit(0), width - 1), lambda x: F.transform(F.sequence(F.lit(0), height - 1), lambda y: F.get(pixels, (y * width + x).cast("int"))))
    return F.when((height > 0) & (width > 0), F.flatten(each)).otherwise(F.slice(pixels, 1, 0))


def runs(images: DataFrame, keys: list[str], pixels: Column, length: Column | int, dark: Callable[[Column], Column]) -> DataFrame:
    """(keys, line, start, end) of the longest runs of dark pixels in each line of `length` pixels; a pixel that is null isn't dark."""
    length = length if isinstance(length, Column) else F.lit(length)
    n = F.floor(F.size(pixels) / length).cast("int")
    lines = F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)), lambda i: F.slice(pixels, i * length + 1, length))
    each = images.select(*keys, F.posexplode(lines).alias("line", "_line"))
    at = each.select(*keys, "line", F.transform("_line", lambda v: F.coalesce(dark(v), F.lit(False))).alias("_dark"))
    on = lambda i: F.coalesce(F.get("_dark", i), F.lit(False))
    at = at.select(*keys, "line", F.filter(F.sequence(F.lit(0), F.size("_dark")), lambda i: on(i) != on(i - 1)).alias("_edge")).where(F.size("_edge") > 0)
    edge = lambda i: F.get("_edge", i)
    pairs = F.transform(F.sequence(F.lit(0), (F.size("_edge") / 2).cast("int") - 1), lambda i: F.struct(edge(2 * i).alias("start"), edge(2 * i + 1).alias("end")))
    return at.select(*keys, "line", F.explode(pairs).alias("_run")).select(*keys, "line", "_run.start", "_run.end")


def opened(found: DataFrame, n: int, length: Column | int) -> DataFrame:
    """Runs of n pixels (an odd number) or more; what goes on beyond the edge counts, so there half of them are enough."""
    length = length if isinstance(length, Column) else F.lit(length)
    size, first, last = F.col("end") - F.col("start"), F.col("start") == 0, F.col("end") == length
    return found.where((size >= n) | ((first | last) & (size > n // 2)) | (first & last))


def closed(found: DataFrame, keys: list[str], n: int, length: Column | int) -> DataFrame:
    """Runs less than n pixels (an odd number) apart become one; one within n // 2 of the edge reaches it."""
    length = length if isinstance(length, Column) else F.lit(length)
    w = Window.partitionBy(*keys, "line").orderBy("start")
    new = F.coalesce((F.col("start") - F.lag("end").over(w) >= n).cast("int"), F.lit(0))
    at = found.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    whole = at.groupBy(*keys, "line", "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    start, end = F.col("start"), F.col("end")
    return whole.select(*keys, "line", F.when(start <= n // 2, 0).otherwise(start).alias("start"), F.when(length - end <= n // 2, length).otherwise(end).alias("end"))


def grown(found: DataFrame, keys: list[str], n: int, length: Column | int) -> DataFrame:
    """Runs n // 2 pixels longer at both ends, within the line; those that meet become one."""
    length = length if isinstance(length, Column) else F.lit(length)
    wide = found.withColumns({"start": F.greatest(F.col("start") - n // 2, F.lit(0)), "end": F.least(F.col("end") + n // 2, length)})
    return closed(wide, keys, 1, length)


def across(found: DataFrame, keys: list[str]) -> DataFrame:
    """The same pixels as runs along the other direction; the work grows with the pixels, so turn what is left after opening."""
    pixel = found.select(*keys, F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("_at"), F.col("line").alias("_y"))
    w = Window.partitionBy(*keys, "_at").orderBy("_y")
    marked = pixel.withColumn("_run", F.col("_y") - F.row_number().over(w))  # the same within a run
    return marked.groupBy(*keys, F.col("_at").alias("line"), "_run").agg(F.min("_y").alias("start"), (F.max("_y") + 1).alias("end")).drop("_run")


def lines(found: DataFrame, keys: list[str], least: Column | float, gap: int) -> DataFrame:
    """(keys, i, first, last, middle, thickness) of ruled lines: lines with at least `least` dark pixels, those at most `gap` apart are one."""
    least = least if isinstance(least, Column) else F.lit(least)
    full = found.groupBy(*keys, "line").agg(F.sum(F.col("end") - F.col("start")).alias("_n")).where(F.col("_n") >= least)
    at = gap_groups(full, keys, "line", gap, [], "i")
    return at.groupBy(*keys, "i").agg(F.min("line").alias("first"), F.max("line").alias("last"), F.floor(F.sum("line") / F.count(F.lit(1))).cast("int").alias("middle"), F.count(F.lit(1)).alias("thickness"))


def touching(found: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, a, b) of runs of neighbouring lines that touch, corners included; a run's number is line * 2^32 + start.

    Runs meet by equality on the line and on blocks of `BLOCK` pixels, a pair only in the block where the later of both begins.
    """
    number = F.shiftleft(F.col("line").cast("long"), 32) + F.col("start")
    at = found.select(*keys, "line", "start", "end", number.alias("_id"), F.explode(F.sequence((F.col("start") / BLOCK).cast("int"), (F.col("end") / BLOCK).cast("int"))).alias("_block"))
    up = at.select(*keys, (F.col("line") + 1).alias("line"), "_block", F.col("_id").alias("a"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    both = up.join(at, [*keys, "line", "_block"]).where("_s <= end and start <= _e")
    return both.where((F.greatest("_s", "start") / BLOCK).cast("int") == F.col("_block")).select(*keys, "a", F.col("_id").alias("b"))


def labelled(found: DataFrame, keys: list[str]) -> DataFrame:
    """Adds region, the least number of the runs that hang together, to runs.

    Each round hooks every number to its least neighbour and that one's, and draws the links together; rounds grow
    with the logarithm of the longest chain of runs. Every round is a written table, so no lineage grows.
    """
    number = F.shiftleft(F.col("line").cast("long"), 32) + F.col("start")
    at = cut(found.select(*keys, "line", "start", "end", number.alias("region")))
    links = cut(touching(at.drop("region"), keys))
    while not links.isEmpty():
        either = links.unionByName(links.select(*keys, F.col("b").alias("a"), F.col("a").alias("b")))
        least = either.groupBy(*keys, "a").agg(F.min("b").alias("_to")).where("_to < a")
        on = lambda name, df: [F.col(f"_k{i}") == df[k] for i, k in enumerate(keys)] + [F.col("_a") == df[name]]
        as_ = lambda df, to: df.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("a").alias("_a"), F.col(to).alias("_next"))
        hooks = cut(least.join(as_(least, "_to"), on("_to", least), "left").select(*keys, "a", F.coalesce("_next", "_to").alias("_far")))
        follow = lambda df, name: df.join(as_(hooks, "_far"), on(name, df), "left").select(*[c for c in df.columns if c != name], F.coalesce("_next", name).alias(name))  # noqa: B023, E731
        at = cut(follow(at, "region"))
        links = cut(follow(follow(links, "a"), "b").where("a <> b").distinct())
    return at


def regions(found: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, i, x, y, w, h, pixels) of what hangs together, corners included, numbered from the top and then from the left; of equals the one with the first pixel leads."""
    box = labelled(found, keys).groupBy(*keys, "region").agg(
        F.min("start").alias("x"), F.min("line").alias("y"), F.max("end").alias("_x1"), (F.max("line") + 1).alias("_y1"), F.sum(F.col("end") - F.col("start")).alias("pixels")
    )
    i = (F.row_number().over(Window.partitionBy(*keys).orderBy("y", "x", "region")) - 1).cast("int")
    return box.select(*keys, i.alias("i"), "x", "y", (F.col("_x1") - F.col("x")).alias("w"), (F.col("_y1") - F.col("y")).alias("h"), "pixels")
