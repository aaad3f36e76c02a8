"""A recogniser's nested annotation as flat relations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions import text as X

WORD = "struct<text:string,confidence:string,conf:string,score:string,boundingBox:struct<vertices:array<struct<x:string,y:string>>>>"
LINE = WORD[:-1] + f",words:array<{WORD}>>"
CELL = "struct<rowIndex:int,columnIndex:int,rowSpan:int,columnSpan:int,text:string,boundingBox:struct<vertices:array<struct<x:string,y:string>>>>"
SCHEMA = f"struct<width:double,height:double,fullText:string,blocks:array<struct<lines:array<{LINE}>>>,tables:array<struct<rowCount:int,columnCount:int,boundingBox:struct<vertices:array<struct<x:string,y:string>>>,cells:array<{CELL}>>>>"


def box(node: F.Column) -> F.Column:
    """The least box round a node's vertices; a missing coordinate is 0, no vertices are no box."""
    v = node["boundingBox"]["vertices"]
    at = lambda n: F.transform(v, lambda p: F.coalesce(p[n].try_cast("double"), F.lit(0.0)).cast("int"))
    made = F.struct(F.array_min(at("x")).alias("x0"), F.array_min(at("y")).alias("y0"), F.array_max(at("x")).alias("x1"), F.array_max(at("y")).alias("y1"))
    return F.when(F.size(v) > 0, made)


def measures(box: F.Column) -> F.Column:
    """A box's w, h and area, which is 0 where an edge is before its opposite."""
    w, h = box["x1"] - box["x0"], box["y1"] - box["y0"]
    return F.struct(w.alias("w"), h.alias("h"), (F.greatest(F.lit(0), w) * F.greatest(F.lit(0), h)).alias("area"))


def confidence(node: F.Column) -> F.Column:
    """Of the first name that is present; one that is no number is null, and no later name is tried."""
    return F.when(node["confidence"].isNotNull(), node["confidence"].try_cast("double")).when(node["conf"].isNotNull(), node["conf"].try_cast("double")).otherwise(node["score"].try_cast("double"))


def lines(df: DataFrame, annotation: str) -> DataFrame:
    """One row for each line with text, or with words that have some; its box may be null."""
    at = df.select("*", F.posexplode_outer(f"{annotation}.blocks").alias("block", "_b")).select("*", F.posexplode_outer("_b.lines").alias("line", "_l")).where("_l is not null")
    words = F.array_join(F.transform(F.col("_l.words"), lambda w: w["text"]), " ")
    text = F.when(F.coalesce(F.col("_l.text"), F.lit("")) != "", F.col("_l.text")).otherwise(F.coalesce(words, F.lit("")))
    return at.withColumns({"text": text, "box": box(F.col("_l")), "conf": confidence(F.col("_l"))}).where("text <> ''")


def words(df: DataFrame, annotation: str) -> DataFrame:
    """One row for each word with a text and a box."""
    at = df.select("*", F.posexplode_outer(f"{annotation}.blocks").alias("block", "_b")).select("*", F.posexplode_outer("_b.lines").alias("line", "_l"))
    at = at.select("*", F.posexplode("_l.words").alias("word", "_w"))
    return at.withColumns({"text": F.col("_w.text"), "box": box(F.col("_w")), "conf": confidence(F.col("_w"))}).where("coalesce(text, '') <> '' and box is not null").drop("_b", "_l", "_w")


def tables(df: DataFrame, annotation: str) -> DataFrame:
    """One row for each cell of an annotation's tables: table (its number), rows, cols, table_box, r, c, rs, cs, text and box; a table without cells has one row of nulls."""
    at = df.select("*", F.posexplode(f"{annotation}.tables").alias("table", "_t")).select("*", F.explode_outer("_t.cells").alias("_c"))
    counted = {"rows": F.coalesce("_t.rowCount", F.lit(0)), "cols": F.coalesce("_t.columnCount", F.lit(0)), "table_box": box(F.col("_t")), "r": F.coalesce("_c.rowIndex", F.when(F.col("_c").isNotNull(), 0)), "c": F.coalesce("_c.columnIndex", F.when(F.col("_c").isNotNull(), 0))}
    spans = {"rs": F.coalesce("_c.rowSpan", F.when(F.col("_c").isNotNull(), 1)), "cs": F.coalesce("_c.columnSpan", F.when(F.col("_c").isNotNull(), 1)), "text": F.coalesce("_c.text", F.when(F.col("_c").isNotNull(), "")), "box": box(F.col("_c"))}
    return at.withColumns(counted | spans).drop("_t", "_c")


NAMES = {  # of each figure of a table or cell, the names that replies have given it; the first that holds a whole number counts
    "rows": ("rowCount", "rows", "row_count"), "cols": ("columnCount", "cols", "column_count"), "r": ("rowIndex", "row", "r"), "c": ("columnIndex", "col", "column", "c"),
    "rs": ("rowSpan", "rs"), "cs": ("columnSpan", "cs"),
}


def number(node: F.Column, figure: str, otherwise: int) -> F.Column:
    """A whole number of a variant by any of its names, as a number or as text."""
    at = lambda n: F.coalesce(F.try_variant_get(node, f"$.{n}", "int"), F.try_variant_get(node, f"$.{n}", "string").try_cast("int"))
    return F.coalesce(*map(at, NAMES[figure]), F.lit(otherwise))


def variant_box(node: F.Column) -> F.Column:
    """As `box`, of a variant whose box has vertices with numbers or texts."""
    v = F.try_variant_get(node, "$.boundingBox.vertices", "array<struct<x:string,y:string>>")
    at = lambda n: F.transform(v, lambda p: F.coalesce(p[n].try_cast("double"), F.lit(0.0)).cast("int"))
    made = F.struct(F.array_min(at("x")).alias("x0"), F.array_min(at("y")).alias("y0"), F.array_max(at("x")).alias("x1"), F.array_max(at("y")).alias("y1"))
    return F.when(F.size(v) > 0, made)


def reply_tables(df: DataFrame, reply: str) -> DataFrame:
    """One row for each cell of the tables in a reply of any shape: table (its number), rows, cols, table_box, r, c, rs, cs, text and box.

    reply is text with a JSON object in it, fenced or not, whose tables stand at its top or in `result.textAnnotation`. What isn't there, has another name than
    `NAMES` knows or another type counts as its default; a table without cells has one row of nulls; no object, no rows.
    """
    top = df.withColumn("_v", F.try_parse_json(X.reply_json(F.col(reply))))
    listed = lambda path: F.try_variant_get("_v", path, "array<variant>")
    each = top.select(*df.columns, F.posexplode(F.coalesce(listed("$.tables"), listed("$.result.textAnnotation.tables"))).alias("table", "_t"))
    cells = F.try_variant_get("_t", "$.cells", "array<variant>")
    at = each.select("*", F.explode_outer(cells).alias("_c"))
    t, c = F.col("_t"), F.col("_c")
    there = lambda x: F.when(c.isNotNull(), x)
    text = there(F.coalesce(F.try_variant_get(c, "$.text", "string"), F.lit("")))
    figures = {"rows": number(t, "rows", 0), "cols": number(t, "cols", 0), "table_box": variant_box(t), "r": there(number(c, "r", 0)), "c": there(number(c, "c", 0)), "rs": there(number(c, "rs", 1)), "cs": there(number(c, "cs", 1)), "text": text, "box": variant_box(c)}
    return at.withColumns(figures).drop("_t", "_c")
