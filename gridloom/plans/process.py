"""Whole tables and documents: from words and two engines' texts to cells, sheets and meta rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import text as X
from gridloom.operators import forms, reconcile, tables
from gridloom.plans import specs

def recognise(words: DataFrame, grid: DataFrame, kind: str, width: float, height: float, engine: str = "hybrid", ink: DataFrame | None = None, tol: float = tables.TOLERANCE) -> DataFrame:
    """`tables.recognise` for words (table_id, word_id, cx, y, text, conf) and a layout grid (table_id, r, c, q) of tables of one kind and size."""
    sized = {"kind": F.lit(kind), "width": F.lit(float(width)), "height": F.lit(float(height))}
    x0 = F.col("x0") if "x0" in words.columns else F.col("cx")
    known = words.select("table_id").unionByName(grid.select("table_id")).distinct().withColumns(sized | {"x0": F.lit(0), "y0": F.lit(0)})
    return tables.recognise(words.withColumns(sized | {"x0": x0}), known, grid, engine, ink, tol=tol)


def summary(cells: DataFrame, grid: DataFrame) -> DataFrame:
    """(table_id, n_cells, n_rows, n_review, n_expanded, layout_rows, n_both, n_disagree, rate) of each table."""
    own = cells.groupBy("table_id").agg(
        F.count(F.lit(1)).alias("n_cells"), F.countDistinct("r").alias("n_rows"), F.count_if("needs_review").alias("n_review"), F.count_if("expanded").alias("n_expanded")
    )
    lines = grid.groupBy("table_id").agg(F.countDistinct("r").alias("layout_rows"))
    return own.join(lines, "table_id", "left").join(reconcile.divergence(cells, ["table_id"], "q", "reader_text"), "table_id")


def reply_cells(replies: DataFrame, kind: str | None = None) -> DataFrame:
    """(table_id, r, c, q, low) of a layout engine's replies (table_id, reply, kind unless it is one for all): JSON {rows, low_conf}, fenced or not.

    Rows are cut and padded to the table's columns; a row that is no list is one text.
    """
    n = F.lit(len(specs.leaves(kind))) if kind else tables.by_kind(F.col("kind"), {k: len(specs.leaves(k)) for k in specs.KINDS})
    at = replies.withColumns({"n": n, "j": F.from_json(X.reply_json(F.col("reply")), "rows array<string>, low_conf array<array<int>>")})
    rows = at.select("table_id", "n", "j.low_conf", F.posexplode("j.rows").alias("r", "raw"))
    row = F.coalesce(F.from_json("raw", "array<string>"), F.array("raw"))
    row = F.when(F.col("raw").startswith("["), row).otherwise(F.array("raw"))
    cells = rows.select("table_id", "r", "low_conf", F.posexplode(forms.pad_row(row, F.col("n"))).alias("c", "q"))
    low = F.coalesce(F.array_contains("low_conf", F.array("r", "c")), F.lit(False))
    return cells.select("table_id", "r", "c", "q", low.alias("low"))


def reply_fields(replies: DataFrame) -> DataFrame:
    """(table_id, form, values map, low_conf array) of a layout engine's replies (table_id, form, reply) for forms: JSON {fields, low_conf}, either of which may be absent."""
    at = replies.withColumn("j", F.from_json(X.reply_json(F.col("reply")), "fields map<string,string>, low_conf array<string>"))
    return at.select("table_id", "form", F.coalesce("j.fields", F.create_map().cast("map<string,string>")).alias("values"), F.coalesce("j.low_conf", F.array().cast("array<string>")).alias("low_conf"))


def prompt(kind: str) -> str:
    """What a layout engine is asked for a table of this kind: its columns in order, and the reply's form."""
    labels = "; ".join(f"{group} — {label}" if group else label for label, group, _ in specs.leaves(kind))
    return f'Columns, in order: {labels}. Reply with JSON {{"rows": [[...]], "low_conf": [[row, column], ...]}} and {len(specs.leaves(kind))} texts in each row.'


def form_prompt(form: str) -> str:
    """What a layout engine is asked for a form: its title and fields, and the reply's form."""
    keys = "; ".join(specs.FORM_FIELDS[form])
    return f'Form: {specs.FORM_TITLES[form]}. Fields: {keys}. Reply with JSON {{"fields": {{name: text}}, "low_conf": [name, ...]}}, an empty text for an empty field.'


def run(spark: SparkSession, words: str, grid: str, out: str, kind: str, width: float, height: float, engine: str = "hybrid") -> DataFrame:
    """Reads words and the layout grid as Parquet, writes cells and their summary, and returns the summary."""
    w, g = spark.read.parquet(words), spark.read.parquet(grid)
    recognise(w, g, kind, width, height, engine).write.mode("overwrite").parquet(f"{out}/cells")
    cells = spark.read.parquet(f"{out}/cells")
    summary(cells, g).write.mode("overwrite").parquet(f"{out}/summary")
    return spark.read.parquet(f"{out}/summary")
