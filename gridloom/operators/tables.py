"""Cells of tables of all kinds at once, from positioned words.

Words are dealt out by table once; every window after that, from clustering to the rows' numbers, is
over the table or a part of it. What a kind fixes (columns, labels, header rows) are literals
of a few dozen values inside the expressions, so no dimension is joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.functions import text as X
from gridloom.operators import cluster, ditto, layout, reconcile
from gridloom.plans import specs

TOLERANCE = 24.0
LEFT, RIGHT = [4, 5, 6], [7, 8, 9]  # fixed values: columns of sampling_right whose numbers are compared
RETRIED = [2, 7, 8, 9]  # fixed values: columns of sampling_right that are read again where they have ink but no text
HALF_ROW = 0.46  # fixed value: of the pitch, above and below a row's centre


def by_kind(kind: Column, values: dict, otherwise=None) -> Column:
    """The value that a kind has in a table of fixed values."""
    if not values:
        return F.lit(otherwise)
    found = F.try_element_at(X.literal_map(values), kind)
    return found if otherwise is None else F.coalesce(found, F.lit(otherwise))


def edges(kind: Column, width: Column) -> Column:
    """The bounds of a table's columns, from 0 to its width: running shares, rounded half to even."""
    shares = {}
    for k in specs.KINDS:
        run, sums = 0.0, []
        for row in specs.column_rows():
            if row[0] == k:
                run += row[5]
                sums.append(run)
        shares[k] = [s / run for s in sums[:-1]]
    inner = F.transform(by_kind(kind, shares), lambda s: F.bround(s * width).cast("int"))
    return F.concat(F.array(F.lit(0)), inner, F.array(width.cast("int")))


def band(x: Column, bounds: Column) -> Column:
    """The column with bounds[i] <= x < bounds[i + 1], or null."""
    return F.get(F.filter(F.sequence(F.lit(0), F.size(bounds) - 2), lambda i: (x >= F.get(bounds, i)) & (x < F.get(bounds, i + 1))), F.lit(0)).cast("int")


def body(at: DataFrame) -> DataFrame:
    """Adds first, ends (exclusive), dropped (a row of the header's words) and r, the row's number in the table's body, to clustered words with ci.

    The body begins at the first row with a key, else at row 0; from there the first row with a footer
    stem ends it, before the header test; keyless rows with a header stem are skipped. Rows without any word in a column count.
    """
    row, table = Window.partitionBy("table_id", "ri"), Window.partitionBy("table_id")
    low, placed = F.lower(F.coalesce("text", F.lit(""))), F.col("ci").isNotNull()
    flag = lambda c: F.max(F.coalesce(placed & c, F.lit(False)).cast("int")).over(row)
    at = at.withColumns({
        "_key": flag(X.looks_key(F.col("text"), F.col("ci"))), "_foot": flag(low.rlike("|".join(specs.FOOTER_STEMS))), "_head": flag(low.rlike("|".join(specs.HEADER_STEMS))),
        "_one": F.row_number().over(row.orderBy("y", "word_id")) == 1,
    })
    at = at.withColumn("first", F.coalesce(F.min(F.when(F.col("_key") == 1, F.col("ri"))).over(table), F.lit(0)))
    foot = F.min(F.when((F.col("_foot") == 1) & (F.col("ri") >= F.col("first")), F.col("ri"))).over(table)
    at = at.withColumn("ends", F.coalesce(foot, F.max("grp").over(table) + 1).cast("int"))
    at = at.withColumn("dropped", (F.col("_key") == 0) & (F.col("_head") == 1) & (F.col("ri") >= F.col("first")) & (F.col("ri") < F.col("ends")))
    gone = F.when(F.col("dropped") & F.col("_one"), 1).otherwise(0)
    before = F.coalesce(F.sum(gone).over(table.orderBy("ri").rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = at.withColumns({"r": (F.col("ri") - F.col("first") - before).cast("int"), "n_rows": (F.col("ends") - F.col("first") - F.sum(gone).over(table)).cast("int")})
    return at.drop("_key", "_foot", "_head", "_one")


class Placed:
    """Words of tables in rows and columns.

    slots: (table_id, r, c, y, y_conf). rows: (table_id, r, cy), every row of the body, with words or without.
    """

    def __init__(self, slots: DataFrame, rows: DataFrame):
        self.slots, self.rows = slots, rows


def place(words: DataFrame, tol: float = TOLERANCE) -> Placed:
    """Words (table_id, kind, width, height, word_id, x0, cx, y, text, conf) of tables of all kinds."""
    kind = F.col("kind")
    dealt = words.repartition("table_id").withColumn("ci", band(F.col("cx"), edges(kind, F.col("width"))))
    labels = {k: len(v) for k, v in specs.ROW_LABELS.items()}
    labelled = kind.isin(*labels)
    free = body(cluster.clustered(dealt.where(~labelled), tol))
    fixed = layout.anchored(dealt.where(labelled), by_kind(kind, specs.HEADER_ROWS), by_kind(kind, labels))
    kept = ["table_id", "kind", "r", "ci", "x0", "y", "word_id", "text", "conf"]
    at = free.where("ci is not null and ri >= first and ri < ends and not dropped").select(*kept).unionByName(layout.nearest_anchor(fixed).where("ci is not null").select(*kept))
    each = F.sort_array(F.collect_list(F.struct("x0", "y", "word_id", F.col("text").alias("t"))))
    conf = F.when(~F.first("kind").isin(*specs.WORD_PLACEMENT), F.avg("conf"))
    slots = at.groupBy("table_id", "r", F.col("ci").alias("c")).agg(X.strip(F.array_join(F.transform(each, lambda s: s["t"]), " ")).alias("y"), conf.alias("y_conf"))
    # Rows come from the centres, as a centre may have lost all its words to others.
    centre = free.groupBy("table_id", F.col("grp").alias("ri")).agg(F.first("cy").alias("cy"), F.first("first").alias("first"), F.first("ends").alias("ends"))
    gone = free.where("dropped").select("table_id", "ri").distinct()
    left = centre.where("ri >= first and ri < ends").join(gone, ["table_id", "ri"], "left_anti")
    rows = left.select("table_id", (F.row_number().over(Window.partitionBy("table_id").orderBy("ri")) - 1).alias("r"), "cy")
    even = fixed.groupBy("table_id").agg(F.first("anchors").alias("anchors")).select("table_id", F.posexplode("anchors").alias("r", "cy"))
    return Placed(slots, rows.unionByName(even))


def whole_rows(tables: DataFrame, placed: Placed) -> DataFrame:
    """placed.rows and, for tables with labels but no words, rows in proportion."""
    labels = {k: len(v) for k, v in specs.ROW_LABELS.items()}
    n, h = by_kind(F.col("kind"), labels), by_kind(F.col("kind"), specs.HEADER_ROWS)
    bare = tables.where(F.col("kind").isin(*labels)).join(placed.rows.select("table_id").distinct(), "table_id", "left_anti")
    even = bare.select("table_id", "height", n.alias("n"), h.alias("h"), F.explode(F.sequence(F.lit(0), n - 1)).alias("r"))
    cy = F.col("height") * F.col("h") / (F.col("h") + F.col("n")) + (F.col("r") + 0.5) * (F.col("height") * (1 - F.col("h") / (F.col("h") + F.col("n"))) / F.col("n"))
    return placed.rows.unionByName(even.select("table_id", "r", cy.alias("cy")))


def boxes(tables: DataFrame, rows: DataFrame) -> DataFrame:
    """(table_id, kind, r, c, box) of every place to fill, on the page: tables (table_id, kind, width, height, x0, y0), rows (table_id, r, cy)."""
    w = Window.partitionBy("table_id").orderBy("r")
    gaps = rows.withColumn("gap", F.lead("cy").over(w) - F.col("cy"))
    pitch = gaps.groupBy("table_id").agg(F.median("gap").alias("m"))
    fill = by_kind(F.col("kind"), {k: list(specs.FILL_COLUMNS.get(k) or range(len(specs.leaves(k)))) for k in specs.KINDS})
    bounds = edges(F.col("kind"), F.col("width"))
    columns = F.transform(fill, lambda c: F.struct(c.alias("c"), F.get("edges", c).alias("lo"), F.get("edges", c + 1).alias("hi")))
    sized = tables.join(pitch, "table_id", "left").withColumns({"edges": bounds, "half": HALF_ROW * F.coalesce("m", 0.05 * F.col("height"))}).withColumn("columns", columns)
    at = rows.join(sized.select("table_id", "kind", "x0", "y0", "half", "columns"), "table_id")
    at = at.select("table_id", "kind", "r", "x0", ((F.col("cy") - F.col("half")).cast("int") + F.col("y0")).cast("int").alias("top"), ((F.col("cy") + F.col("half")).cast("int") + F.col("y0")).cast("int").alias("low"), F.inline("columns"))
    box = F.struct((F.col("lo") + F.col("x0")).cast("int").alias("x0"), F.col("top").alias("y0"), (F.col("hi") + F.col("x0")).cast("int").alias("x1"), F.col("low").alias("y1"))
    return at.select("table_id", "kind", "r", "c", box.alias("box"))


def recognise(words: DataFrame, tables: DataFrame, grid: DataFrame, engine: str = "hybrid", ink: DataFrame | None = None, crops: DataFrame | None = None, retries: DataFrame | None = None, tol: float = TOLERANCE, found: Placed | None = None) -> DataFrame:
    """(table_id, kind, r, c, box, text, source, conf, needs_review, q, reader_text, grid_text, expanded) of tables of all kinds.

    tables: (table_id, kind, width, height, x0, y0), where a table stands on its page. grid: the layout engine's
    (table_id, r, c, q), by place; its rows beyond those that geometry finds go, but with engine `layout` they
    alone count. ink: (table_id, r, c) of places with ink; without it, places with words have ink.
    crops and retries: (table_id, r, c, text, conf) of single cells, read at first and again (see `inky_blanks`). found: what `place` makes of the words, if it is there.
    grid_text is the text with numbers blanked that the columns to the right repeat; expanded marks repeat marks with a value above.
    """
    on = ["table_id", "r", "c"]
    if engine == "layout":
        at = grid.join(tables.select("table_id", "kind"), "table_id").select(*on, "kind", F.lit(None).cast("struct<x0:int,y0:int,x1:int,y1:int>").alias("box"), "q", F.lit("").alias("y"), F.lit(None).cast("double").alias("y_conf"), F.lit(True).alias("ink"))
    else:
        found = found or place(words, tol)
        dense = boxes(tables, whole_rows(tables, found))
        at = dense.join(found.slots, on, "left").join(grid.select(*on, "q"), on, "left")
        if crops is not None:
            read = crops.select(*on, F.col("text").alias("_t"), F.col("conf").alias("_c"))
            better = (X.strict(F.col("_t")) != "") & ~F.col("kind").isin(*specs.WORD_PLACEMENT)
            at = at.join(read, on, "left").withColumns({"y": F.when(better, F.col("_t")).otherwise(F.col("y")), "y_conf": F.when(better, F.col("_c")).otherwise(F.col("y_conf"))}).drop("_t", "_c")
        words_there = F.coalesce("y", F.lit("")) != ""
        at = at.join(ink.select(*on, F.lit(True).alias("ink")), on, "left").withColumn("ink", F.coalesce("ink", F.lit(False))) if ink is not None else at.withColumn("ink", words_there)
    cells = reconcile.cells(at, F.col("kind"), engine).select(*on, "kind", "box", "text", "source", "conf", "needs_review", F.coalesce("q", F.lit("")).alias("q"), "reader_text")
    if retries is not None and engine != "layout":
        cells = cells.unionByName(retried(inky_blanks(dense, cells, ink), retries))
    sampling = F.col("kind") == "sampling_right"
    cells = reconcile.blank_repeats(cells.withColumn("grid_text", F.col("text")), ["table_id", "r"], LEFT, RIGHT, "grid_text", when=sampling)
    return ditto.expand(cells, ["table_id", "c"], ["r"], "grid_text", (F.col("c") > 0) | ~F.col("kind").isin(*specs.ROW_LABELS)).drop("value")


def inky_blanks(places: DataFrame, cells: DataFrame, ink: DataFrame | None) -> DataFrame:
    """(table_id, kind, r, c, box) of places of sampling_right in the columns `RETRIED` that have ink and no text: what to read again, larger."""
    wanted = places.where((F.col("kind") == "sampling_right") & F.col("c").isin(*RETRIED))
    on = ["table_id", "r", "c"]
    blank = wanted.join(cells.where(X.strict(F.col("text")) != "").select(*on), on, "left_anti")
    return blank if ink is None else blank.join(ink.select(*on), on, "left_semi")


def retried(blanks: DataFrame, readings: DataFrame) -> DataFrame:
    """Cells from second readings (table_id, r, c, text, conf) of blanks; one without confidence needs a review."""
    read = blanks.join(readings.select("table_id", "r", "c", "text", "conf"), ["table_id", "r", "c"]).withColumn("text", X.clean_cell(F.col("text"))).where("text <> ''")
    text = F.when(X.is_ditto(F.col("text")), F.lit("-ll-")).when(F.col("c") == 2, X.norm_code(F.col("text"))).otherwise(F.col("text"))
    return read.withColumn("text", text).select("table_id", "r", "c", "kind", "box", "text", F.lit("reader_retry").alias("source"), "conf", F.col("conf").isNull().alias("needs_review"), F.lit("").alias("q"), F.col("text").alias("reader_text"))


def read_cells(lines: DataFrame) -> DataFrame:
    """(table_id, r, c, text, conf) of crops read alone: the lines' texts (table_id, r, c, line, text, conf) in order, and their mean confidence where they have one."""
    each = F.sort_array(F.collect_list(F.struct("line", F.coalesce("text", F.lit("")).alias("t"))))
    return lines.groupBy("table_id", "r", "c").agg(X.strip(F.array_join(F.transform(each, lambda s: s["t"]), " ")).alias("text"), F.avg("conf").alias("conf"))


def summary(tables: DataFrame, cells: DataFrame, rows: DataFrame, grid: DataFrame) -> DataFrame:
    """(table_id, kind, n_rows, layout_rows, n_cells, n_review, n_expanded, n_both, n_disagree, rate, mismatch) of every table, with cells or without.

    tables may have ruled_rows, the horizontal rules seen on the page: mismatch says that more rows were found than those.
    """
    ruled = F.col("ruled_rows") if "ruled_rows" in tables.columns else F.lit(None).cast("int")
    n = rows.groupBy("table_id").agg(F.count(F.lit(1)).alias("n_rows"))
    lines = grid.groupBy("table_id").agg(F.countDistinct("r").alias("layout_rows"))
    own = cells.groupBy("table_id").agg(F.count(F.lit(1)).alias("n_cells"), F.count_if("needs_review").alias("n_review"), F.count_if("expanded").alias("n_expanded"))
    apart = reconcile.divergence(cells, ["table_id"], "q", "reader_text")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    every = tables.join(n, "table_id", "left").join(lines, "table_id", "left").join(own, "table_id", "left").join(apart, "table_id", "left")
    counts = [zero(c) for c in ("n_rows", "layout_rows", "n_cells", "n_review", "n_expanded", "n_both", "n_disagree")]
    return every.select("table_id", "kind", *counts, "rate", F.coalesce(reconcile.mismatch(ruled, F.coalesce("n_rows", F.lit(0))), F.lit(False)).alias("mismatch"))
