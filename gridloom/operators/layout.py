"""Columns and cells from positions: bands, fixed rows, slots, headers and footers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.functions import text as X
from gridloom.operators import cluster
from gridloom.plans import specs


def spec_columns(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(specs.column_rows(), "kind string, ci int, label string, group_label string, width int, frac double")


def column_bounds(columns: DataFrame, width: float | F.Column, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, kind, ci, lo, hi): running shares of the width, rounded half to even; the last ends at the width. keys tell apart tables whose width is a column."""
    of = [*keys, "kind"]
    w = Window.partitionBy(*of).orderBy("ci").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*of)
    by = Window.partitionBy(*of).orderBy("ci")
    end = width.cast("int") if isinstance(width, F.Column) else F.lit(int(width))
    hi = F.when(F.col("ci") == F.max("ci").over(whole), end).otherwise(F.bround(F.sum("frac").over(w) / F.col("total") * width).cast("int"))
    # the total is the last running sum, added up in the same order
    at = columns.withColumn("run", F.sum("frac").over(w)).withColumn("total", F.last("run").over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return at.withColumn("hi", hi).select(*of, "ci", F.coalesce(F.lag("hi").over(by), F.lit(0)).alias("lo"), "hi")


def leaf_labels(columns: DataFrame) -> DataFrame:
    """(kind, ci, label, ncols, width) of each column: its label after its group's, the kind's number of columns and the sum of their widths."""
    whole = Window.partitionBy("kind")
    return columns.select("kind", "ci", F.concat_ws(" — ", "group_label", "label").alias("label"), F.count(F.lit(1)).over(whole).alias("ncols"), F.sum("width").over(whole).alias("width"))


def detect_kind(tables: DataFrame, keys: list[str], text: str, ncols: str) -> DataFrame:
    """(keys, kind, hits): of the kinds with a table's number of columns, the one of whose keywords most stand in its text, the first of equals, even with none."""
    kinds = tables.sparkSession.createDataFrame([(k, i, len(specs.leaves(k)), list(specs.KEYWORDS[k])) for i, k in enumerate(specs.KINDS)], "kind string, pos int, _n int, kws array<string>")
    at = tables.join(F.broadcast(kinds), F.col(ncols) == F.col("_n"))
    hits = F.size(F.filter("kws", lambda w: F.contains(F.lower(text), w))).cast("long")
    return at.withColumn("hits", hits).groupBy(*keys).agg(F.min_by("kind", F.struct(-F.col("hits"), F.col("pos"))).alias("kind"), F.max("hits").alias("hits"))


def dense_grid(cells: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """(key, r, c, text) of every place of the least grid that holds all cells (key, r, c, text[, rs, cs]); of cells in one place the last by `order` counts, and a place without one is blank."""
    span = lambda at, n: F.max(F.col(at) + (F.col(n) if n in cells.columns else F.lit(1)))
    size = cells.groupBy(key).agg(span("r", "rs").alias("_nr"), span("c", "cs").alias("_nc"))
    one = cells.groupBy(key, "r", "c").agg(F.max_by("text", order or "text").alias("text"))
    places = size.where("_nr > 0 and _nc > 0").select(key, "_nc", F.explode(F.sequence(F.lit(0), F.col("_nr").cast("int") - 1)).alias("r"))
    places = places.select(key, "r", F.explode(F.sequence(F.lit(0), F.col("_nc").cast("int") - 1)).alias("c"))
    return places.join(one, [key, "r", "c"], "left").select(key, "r", "c", F.coalesce("text", F.lit("")).alias("text"))


def place(words: DataFrame, bounds: DataFrame, x: str = "cx") -> DataFrame:
    """Adds ci, the band with lo <= x < hi, or null; bounds of one kind are a dozen rows, sent to all executors."""
    b = F.broadcast(bounds.select("ci", "lo", "hi"))
    return words.join(b, (F.col(x) >= F.col("lo")) & (F.col(x) < F.col("hi")), "left").drop("lo", "hi")


def slots(placed: DataFrame, keys: list[str], order: list[str], text: str = "text") -> DataFrame:
    """(keys, text, n): the words of a slot in order, with spaces."""
    each = F.sort_array(F.collect_list(F.struct(*order, F.col(text).alias("_t"))))
    return placed.groupBy(*keys).agg(X.strip(F.array_join(F.transform(each, lambda s: s["_t"]), " ")).alias("text"), F.count(F.lit(1)).alias("n"))


def reconstruct(words: DataFrame, bounds: DataFrame, tol: float) -> DataFrame:
    """(table_id, ri, ci, text, n): words by gap clustering, nearest centre and band; words outside all bands make centres but no cells."""
    near = cluster.clustered(words.repartition("table_id"), tol)
    return slots(place(near, bounds).where("ci is not null"), ["table_id", "ri", "ci"], ["cx", "word_id"])


def table_body(cells: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Cells (table, ri, ci, text) without printed header rows and from the first footer row on.

    The body begins at the first row with a key (without one, at the first row); from there, the first
    row with a footer stem ends it, before the header test; keyless rows with a header stem are skipped.
    """
    keys = keys or ["table_id"]
    cells = cells.repartition(*keys)  # then all windows are where the rows are
    row = Window.partitionBy(*keys, "ri")
    low = F.lower(F.coalesce("text", F.lit("")))
    marked = cells.withColumns({
        "_key": F.max(X.looks_key(F.col("text"), F.col("ci")).cast("int")).over(row),
        "_foot": F.max(low.rlike("|".join(specs.FOOTER_STEMS)).cast("int")).over(row),
        "_head": F.max(low.rlike("|".join(specs.HEADER_STEMS)).cast("int")).over(row),
    })
    whole = Window.partitionBy(*keys)
    first = F.coalesce(F.min(F.when(F.col("_key") == 1, F.col("ri"))).over(whole), F.min("ri").over(whole))
    begun = marked.withColumn("_first", first)
    foot = F.min(F.when((F.col("_foot") == 1) & (F.col("ri") >= F.col("_first")), F.col("ri"))).over(whole)
    kept = begun.withColumn("_end", foot).where("ri >= _first and (_end is null or ri < _end) and not (_key = 0 and _head = 1)")
    return kept.drop("_key", "_foot", "_head", "_first", "_end")


def anchored(words: DataFrame, header_rows: Column, n_labels: Column) -> DataFrame:
    """Adds anchors array<double>, own, band and reach to words (table_id, word_id, y, ci, height) of tables with printed row labels.

    Anchors are clusters of the first column's words, junk among them; if their number isn't that of the labels, rows lie in proportion.
    """
    n, h = n_labels.cast("double"), header_rows.cast("double")
    step = F.col("height") * (1 - h / (h + n)) / n
    at = words.withColumns({"_step": step, "_first": F.coalesce(F.col("ci") == 0, F.lit(False)), "_labels": n_labels.cast("int"), "_top": F.col("height") * h / (h + n)})
    at = cluster.gap_groups(at, ["table_id", "_first"], "y", 0.5 * F.col("_step"), ["word_id"], "_grp")
    group, table = Window.partitionBy("table_id", "_first", "_grp"), Window.partitionBy("table_id")
    at = at.withColumn("_cy", F.when(F.col("_first"), F.sum("y").over(group).cast("double") / F.count(F.lit(1)).over(group)))
    at = at.withColumn("own", F.coalesce(F.max(F.when(F.col("_first"), F.col("_grp"))).over(table) + 1 == F.col("_labels"), F.lit(False)))
    found = F.array_sort(F.collect_set(F.when(F.col("own") & F.col("_first"), F.col("_cy"))).over(table))  # as many as labels, or none
    even = F.transform(F.sequence(F.lit(0), F.col("_labels") - 1), lambda i: F.col("_top") + (i + 0.5) * F.col("_step"))
    at = at.withColumn("anchors", F.when(F.col("own"), found).otherwise(even))
    spread = (F.get("anchors", F.col("_labels") - 1) - F.get("anchors", F.lit(0))) / F.greatest(F.col("_labels") - 1, F.lit(1))
    return at.withColumn("band", F.when(F.col("own") & (F.col("_labels") >= 2), spread).otherwise(F.col("_step"))).drop("_step", "_first", "_labels", "_top", "_grp", "_cy")


def nearest_anchor(at: DataFrame) -> DataFrame:
    """Adds r to anchored words: the nearest anchor within half a band; words of no row, and junk, go."""
    near = F.array_min(F.transform("anchors", lambda a, i: F.struct(F.abs(F.col("y") - a).alias("dist"), i.alias("r"))))
    return at.where(~X.is_junk(F.col("text"))).withColumn("_near", near).where("_near.dist <= 0.5 * band").withColumn("r", F.col("_near.r").cast("int")).drop("_near")


def fixed_rows(words: DataFrame, height: float, header_rows: int, n_labels: int) -> DataFrame:
    """Adds r to words (table_id, word_id, y, ci, text) of tables of one size with printed row labels; words of no row go."""
    at = anchored(words.repartition("table_id").withColumn("height", F.lit(float(height))), F.lit(header_rows), F.lit(n_labels))
    return nearest_anchor(at).drop("anchors", "own", "band", "height")
