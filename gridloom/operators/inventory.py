"""Objects on a half page: regions, the main table, and the table of places."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Fixed values: (kind, x0, y0, x1, y1, confidence) by case, in shares of width and height.
RIGHT_OF_MAIN = (("pokazateli", 0.49, 0.19, 0.75, 0.31, 0.6), ("kontrol", 0.49, 0.42, 0.75, 0.57, 0.6))
SAMPLING_X = (0.058, 0.492)
LEFT_NONE = (("samorodki", 0.04, 0.10, 0.99, 0.30, 0.4), ("form_act", 0.0, 0.32, 1.0, 0.95, 0.4))
RIGHT_NONE = (("form_journal", 0.0, 0.0, 1.0, 0.56, 0.55), ("podschet", 0.02, 0.57, 0.99, 0.95, 0.6))
BOX = "struct<x0:int,y0:int,x1:int,y1:int>"
OBJECT = f"struct<kind:string,box:{BOX},conf:double>"


def regions(boxes: DataFrame, min_area: float = 0.015) -> DataFrame:
    """Boxes (x, y, w, h on a page of width, height) large enough to be an object. Shares are decimals here: in doubles 0.55 of 1,400 is more than 770."""
    large = F.col("w") * F.col("h") >= F.lit(Decimal(str(min_area))) * F.col("height") * F.col("width")
    return boxes.where(large & F.expr("w >= 0.12 * width and h >= 0.03 * height"))


def main_table(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, main): the largest region that is tall and wide enough and has at least four vertical rules."""
    fit = boxes.where("h >= 0.55 * height and w >= 0.40 * width and v_rules >= 4")
    box = F.struct(F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + F.col("w")).alias("x1"), (F.col("y") + F.col("h")).alias("y1")).cast(BOX)
    return fit.groupBy(*keys).agg(F.max_by(box, F.struct((F.col("w") * F.col("h")).alias("a"), -F.col("y"), -F.col("x"))).alias("main"))


def _part(row: tuple, width: F.Column, height: F.Column) -> F.Column:
    kind, x0, y0, x1, y1, conf = row
    at = [(width * x0), (height * y0), (width * x1), (height * y1)]  # shares truncate
    box = F.struct(*[c.cast("int").alias(n) for c, n in zip(at, ("x0", "y0", "x1", "y1"))])
    return F.struct(F.lit(kind).alias("kind"), box.alias("box"), F.lit(conf).alias("conf")).cast(OBJECT)


def locate(halves: DataFrame) -> DataFrame:
    """Adds kind, x0, y0, x1, y1, conf, one row for each object, to halves (side, width, height, main, top).

    main: the main table's box or null; top: the topmost small region or null.
    """
    w, h, main, top = F.col("width"), F.col("height"), F.col("main"), F.col("top")

    def made(kind, x0, y0, x1, y1, conf):
        box = F.struct(x0.cast("int").alias("x0"), y0.cast("int").alias("y0"), x1.cast("int").alias("x1"), y1.cast("int").alias("y1"))
        return F.struct(F.lit(kind).alias("kind"), box.alias("box"), F.lit(conf).alias("conf")).cast(OBJECT)

    left_main = F.array(made("journal_left", main["x0"], main["y0"], main["x1"], main["y1"], 0.9))
    right_main = F.array(made("sampling_right", w * SAMPLING_X[0], main["y0"], w * SAMPLING_X[1], main["y1"], 0.85), *[_part(r, w, h) for r in RIGHT_OF_MAIN])
    left_top = F.array(made("samorodki", top["x0"], top["y0"], top["x1"], top["y1"], 0.75), made("form_act", F.lit(0), top["y1"], w, h, 0.55))
    found = (
        F.when(main.isNotNull() & (F.col("side") == "L"), left_main)
        .when(main.isNotNull() & (F.col("side") == "R"), right_main)
        .when((F.col("side") == "L") & top.isNotNull(), left_top)
        .when(F.col("side") == "L", F.array(*[_part(r, w, h) for r in LEFT_NONE]))
        .when(F.col("side") == "R", F.array(*[_part(r, w, h) for r in RIGHT_NONE]))
        .otherwise(F.array(made("unknown", F.lit(0), F.lit(0), w, h, 0.1)))
    )
    return halves.withColumn("_o", F.explode(found)).select("*", "_o.kind", "_o.box.*", "_o.conf").drop("_o", "main", "top")


def counts(objects: DataFrame) -> DataFrame:
    return objects.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def of_halves(halves: DataFrame, min_area: float = 0.015) -> DataFrame:
    """(path, page, side, kind, x0, y0, x1, y1, conf, ruled_rows) of every object on half pages, as `images.halves` gives them."""
    keys = ["path", "page", "side"]
    boxes = regions(halves.select(*keys, "width", "height", F.inline("boxes")), min_area)
    main = main_table(boxes, keys)
    small = boxes.where("y < 0.35 * height and h < 0.45 * height")
    box = F.struct(F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + F.col("w")).alias("x1"), (F.col("y") + F.col("h")).alias("y1")).cast(BOX)
    top = small.groupBy(*keys).agg(F.min_by(box, F.struct("y", "x")).alias("top"))
    at = halves.select(*keys, "width", "height", F.col("h_lines").alias("ruled_rows")).join(main, keys, "left").join(top, keys, "left")
    return locate(at).drop("width", "height")


def report(objects: DataFrame) -> DataFrame:
    """(path, n, line) of each document's summary as lines of text: its objects, then each kind's, in order."""
    by = objects.groupBy("path", "kind").agg(F.count(F.lit(1)).alias("n"))
    total = objects.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("page").alias("pages"))
    head = total.select("path", F.posexplode(F.array(F.concat(F.lit("file: "), "path"), F.format_string("pages: %d", "pages"), F.format_string("objects: %d", "n"), F.lit(""), F.lit("by kind:"))).alias("n", "line"))
    rest = by.select("path", (F.row_number().over(Window.partitionBy("path").orderBy("kind")) + 4).alias("at"), F.format_string("  %-16s %d", "kind", "n").alias("line")).withColumnRenamed("at", "n")
    return head.unionByName(rest)


def manifest(halves: DataFrame) -> DataFrame:
    """(path, page, side, deskew_deg, h_lines, v_lines, w, h, enhanced) of half pages; pages from 1."""
    name = F.format_string("p%02d_%s_enhanced.png", F.col("page") + 1, F.col("side"))
    return halves.select("path", (F.col("page") + 1).alias("page"), "side", F.bround("deskew", 2).alias("deskew_deg"), "h_lines", "v_lines", F.col("width").alias("w"), F.col("height").alias("h"), name.alias("enhanced"))
