"""Whole files in one plan: from located objects, words and replies to cells, forms, sheets, meta rows and reports.

Every borehole is a spread of two pages. Tables of all kinds go through one plan, forms through another;
what belongs to a borehole is joined by document and spread, so files of any number are one job.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.operators import forms, identity, tables
from gridloom.plans import process, specs

META = "sheet string, obj_type string, r int, c int, rs int, cs int, bbox string, text_source string, grid_text string, reader_text string, conf double, needs_review boolean, text string"


def routed(objects: DataFrame) -> DataFrame:
    """Adds table_id and route, `table` or `form`, to objects (doc_id, page, side, kind); those of other kinds go."""
    route = F.when(F.col("kind").isin(*specs.KINDS), F.lit("table")).when(F.col("kind").isin(*specs.FORMS), F.lit("form"))
    return objects.withColumn("route", route).where("route is not null").withColumn("table_id", F.concat_ws("/", F.col("doc_id").cast("string"), F.col("page").cast("string"), "side", "kind"))


@dataclass
class Result:
    """What a run gives: relations by doc_id, spread and sheet."""

    tables: DataFrame  # doc_id, spread, hole, sheet, kind and the figures of `tables.summary`
    cells: DataFrame  # doc_id, spread, sheet and the columns of `tables.recognise`
    fields: DataFrame  # doc_id, spread, sheet, kind, ord, key, value, source, needs_review
    meta: DataFrame  # doc_id, spread and the columns of `META`
    boreholes: DataFrame  # doc_id, spread, position, hole, hint, mismatch, first_page, last_page, n_objects, n_sheets
    documents: DataFrame  # doc_id, n_boreholes, n_sheets, n_cells, n_review, n_mismatch

    def stored(self, path: str, parts: tuple[str, ...] | None = None) -> Result:
        """The same, with these parts (all) written to a folder as Parquet and read again, so that what follows doesn't compute them anew; cells first, from which others come."""
        spark = self.cells.sparkSession
        parts = PARTS if parts is None else parts
        for name in parts:
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")
        return Result(**{name: spark.read.parquet(f"{path}/{name}") if name in parts else getattr(self, name) for name in PARTS})


PARTS = ("cells", "tables", "fields", "meta", "boreholes", "documents")


def run(
    pages: DataFrame, objects: DataFrame, words: DataFrame, grid: DataFrame, replies: DataFrame, engine: str = "hybrid", raw: DataFrame | None = None, ink: DataFrame | None = None,
    canonical: list[int] | DataFrame | None = None, extract_forms: bool = True, subset: bool = False, **more,
) -> Result:
    """pages (doc_id, page from 0), objects (doc_id, page, side, kind, x0, y0, x1, y1).

    words (table_id, word_id, x0, y0, x1, y1, text, conf) stand on their object; grid (table_id, r, c, q) and replies
    (table_id, values, low_conf) are the layout engine's; raw (table_id, text) is the text engine's reading of forms, for
    engine `reader`. Hints at the borehole's number always come from the replies. More arguments go to `tables.recognise`.
    """
    found = routed(objects)
    holes = identity.spreads(pages.select("doc_id", "page").distinct(), ["doc_id"], "page", canonical, subset).select("doc_id", "page", "spread", "position", "hole")
    spreads = holes.groupBy("doc_id", "spread", "position", "hole").agg((F.min("page") + 1).alias("first_page"), (F.max("page") + 1).alias("last_page"))
    at = found.join(holes, ["doc_id", "page"]).withColumn("sheet", identity.sheet_name(F.col("kind"), F.col("hole")))
    named = at.select("table_id", "doc_id", "spread", "hole", "sheet")

    own = at.where("route = 'table'").select("table_id", "kind", (F.col("x1") - F.col("x0")).cast("double").alias("width"), (F.col("y1") - F.col("y0")).cast("double").alias("height"), "x0", "y0", *(["ruled_rows"] if "ruled_rows" in objects.columns else []))
    placed = words.join(own.select("table_id", "kind", "width", "height"), "table_id").select("table_id", "kind", "width", "height", "word_id", "x0", ((F.col("x0") + F.col("x1")) / 2).alias("cx"), ((F.col("y0") + F.col("y1")) / 2).alias("y"), "text", "conf")
    on_rows = None if engine == "layout" else tables.place(placed, more.pop("tol", tables.TOLERANCE))
    cells = tables.recognise(placed, own, grid, engine, ink, found=on_rows, **more)
    rows = tables.whole_rows(own, on_rows) if on_rows else cells.select("table_id", "r").distinct()
    figures = tables.summary(own, cells, rows, grid)
    cells = cells.join(named.drop("hole"), "table_id")

    dims = forms.spec_fields(cells.sparkSession)
    asked = at.where("route = 'form'").select("table_id", "doc_id", "spread", "sheet", F.col("kind").alias("form"))
    answers = asked.join(replies.select("table_id", "values", "low_conf"), "table_id", "left")
    read = forms.fill(answers, dims, ["table_id", "doc_id", "spread", "sheet"])
    # The first form with a number decides: forms in page order, fields in theirs.
    order = read.join(at.select("table_id", F.col("page").alias("_page"), F.col("side").alias("_side")), "table_id").withColumn("_order", F.struct("_page", "_side", "ord"))
    hints = spreads.select("doc_id", "spread").join(identity.hole_hint(order, ["doc_id", "spread"], "_order"), ["doc_id", "spread"], "left").withColumn("hint", F.coalesce("hint", F.lit("1")))
    hints = spreads.join(hints, ["doc_id", "spread"]).withColumn("mismatch", (F.col("hint") != "") & (F.col("hint") != F.col("hole").cast("string")))
    if engine == "reader":
        source = raw.select("table_id", F.coalesce("text", F.lit("")).alias("value")) if raw is not None else asked.select("table_id", F.lit("").alias("value"))
        kept = asked.join(source, "table_id", "left").select("table_id", "doc_id", "spread", "sheet", "form", F.lit(0).alias("ord"), F.lit(specs.RAW_FIELD).alias("key"), F.coalesce("value", F.lit("")).alias("value"), F.lit("reader").alias("source"), F.lit(True).alias("needs_review"))
    else:
        kept = read.select("table_id", "doc_id", "spread", "sheet", "form", "ord", "key", "value", F.lit("layout").alias("source"), "needs_review")
    last = kept.groupBy("table_id", "doc_id", "spread", "sheet", "form").agg((F.max("ord") + 1).alias("ord")).where("form = 'form_journal'")
    hinted = last.join(hints.select("doc_id", "spread", "hint", "mismatch"), ["doc_id", "spread"]).select(
        "table_id", "doc_id", "spread", "sheet", "form", "ord", F.lit(specs.HINT_FIELD).alias("key"), F.col("hint").alias("value"), F.lit("layout").alias("source"), F.col("mismatch").alias("needs_review")
    )
    fields = kept.unionByName(hinted).withColumnRenamed("form", "kind")
    if not extract_forms:
        fields = fields.where("false")

    meta = table_meta(cells).unionByName(form_meta(fields)).unionByName(hole_meta(hints))
    routes = ["table", "form"] if extract_forms else ["table"]
    sheets = at.where(F.col("route").isin(*routes)).groupBy("doc_id", "spread").agg(F.count(F.lit(1)).alias("n_sheets"))
    objects_of = at.groupBy("doc_id", "spread").agg(F.count(F.lit(1)).alias("n_objects"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    report = hints.join(objects_of, ["doc_id", "spread"], "left").join(sheets, ["doc_id", "spread"], "left")
    boreholes = report.select("doc_id", "spread", "position", "hole", "hint", "mismatch", "first_page", "last_page", zero("n_objects"), zero("n_sheets"))
    documents = document_figures(boreholes, meta)
    return Result(named.join(figures, "table_id").drop("table_id"), cells, fields, meta, boreholes, documents)


def document_figures(boreholes: DataFrame, meta: DataFrame) -> DataFrame:
    """(doc_id, n_boreholes, n_sheets, n_cells, n_review, n_mismatch) of each file."""
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    of_cells = meta.where("obj_type <> 'borehole_id'").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_cells"), F.count_if("needs_review").alias("n_review"))
    documents = boreholes.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_boreholes"), F.sum("n_sheets").alias("n_sheets"), F.count_if("mismatch").alias("n_mismatch")).join(of_cells, "doc_id", "left")
    return documents.select("doc_id", "n_boreholes", "n_sheets", zero("n_cells"), zero("n_review"), "n_mismatch")


def _meta(df: DataFrame, **columns) -> DataFrame:
    names = [f.strip().rsplit(" ", 1) for f in META.split(",")]
    return df.select("doc_id", "spread", *[columns.get(n, F.lit(None)).cast(t).alias(n) for n, t in names])


def table_meta(cells: DataFrame) -> DataFrame:
    """The meta rows of tables' cells; the box as JSON text."""
    box = F.when(F.col("box").isNotNull(), F.to_json(F.array("box.x0", "box.y0", "box.x1", "box.y1")))
    return _meta(
        cells, sheet=F.col("sheet"), obj_type=F.col("kind"), r=F.col("r"), c=F.col("c"), rs=F.lit(1), cs=F.lit(1), bbox=F.coalesce(box, F.lit("")), text_source=F.col("source"), grid_text=F.col("q"),
        reader_text=F.col("reader_text"), conf=F.col("conf"), needs_review=F.col("needs_review"), text=F.col("text"),
    )


def form_meta(fields: DataFrame) -> DataFrame:
    """The meta rows of forms' fields, each a row in column 0."""
    return _meta(fields, sheet=F.col("sheet"), obj_type=F.col("kind"), r=F.col("ord"), c=F.lit(0), rs=F.lit(1), cs=F.lit(1), bbox=F.lit(""), text_source=F.col("source"), grid_text=F.col("value"), needs_review=F.col("needs_review"), text=F.col("value"))


def hole_meta(hints: DataFrame) -> DataFrame:
    """One meta row for each borehole: its number by position, and the hint that was read."""
    hole = F.col("hole").cast("string")
    return _meta(hints, sheet=F.concat(F.lit("скв"), hole), obj_type=F.lit("borehole_id"), r=F.lit(0), c=F.lit(0), rs=F.lit(1), cs=F.lit(1), bbox=F.lit(""), text_source=F.lit("position/canonical"), grid_text=F.col("hint"), needs_review=F.col("mismatch"), text=F.concat(F.lit("pos_N="), hole))


def from_replies(found: DataFrame, layout_replies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(grid, replies) for `run` from routed objects and the layout engine's texts (table_id, reply)."""
    of = found.select("table_id", "kind", "route").join(layout_replies, "table_id")
    return process.reply_cells(of.where("route = 'table'")).drop("low"), process.reply_fields(of.where("route = 'form'").withColumnRenamed("kind", "form"))


def numbered(boreholes: DataFrame) -> DataFrame:
    """Adds done and total, the boreholes of the file up to each and in all, to follow a run by."""
    w = Window.partitionBy("doc_id")
    return boreholes.withColumns({"done": F.row_number().over(w.orderBy("position")), "total": F.count(F.lit(1)).over(w)})
