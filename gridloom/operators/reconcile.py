"""One cell from two readings: the layout engine's text (q) and the text engine's (y)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.functions import text as X
from gridloom.plans import specs


def cells(df: DataFrame, kind: str | F.Column, engine: str = "hybrid") -> DataFrame:
    """Adds text, source, conf, needs_review and reader_text to rows of (r, c, q, y, y_conf, ink); rows without a cell go.

    kind: of all rows, or a column of each row's.

    engine: hybrid, or `reader` or `layout` for one engine alone. The first rule that holds decides: a
    repeat mark of the layout engine; the layout's text, doubted where the reader differs; for
    sampling_right the reader's text, doubted where the layout differs; what either has.
    """
    q = F.coalesce(F.col("q"), F.lit("")) if engine != "reader" else F.lit("")
    y = F.coalesce(F.col("y"), F.lit("")) if engine != "layout" else F.lit("")
    at = _once(df, _q=q, _y=y)
    if engine != "layout":
        at = at.where("ink or _y <> ''")
    q, y = F.col("_q"), F.col("_y")
    at = _once(at, _mark=X.is_ditto(q), _full=X.strict(q) != "", _read=y != "", _same=X.agree(q, y))  # what the rules ask of a row
    mark, full, read, same = (F.col(n) for n in ("_mark", "_full", "_read", "_same"))
    kind = F.lit(kind) if isinstance(kind, str) else kind
    sampling = kind == "sampling_right"
    if engine == "layout":
        rules = [(full, q, "layout", None, False)]
    elif engine == "reader":
        rules = [(read, y, "reader", F.col("y_conf"), False)]
    else:
        rules = [
            (mark, F.lit("-ll-"), "layout", None, False),
            (~sampling & full & read & same, q, "hybrid", specs.AGREE_CONF, False),
            (~sampling & full & read, q, "layout", specs.DISAGREE_CONF, True),
            (~sampling & full, q, "layout", specs.UNREAD_CONF, False),
            (read & full & same, y, "hybrid", F.col("y_conf"), False),
            (read & full, y, "reader", F.col("y_conf"), True),
            (read, y, "reader", F.col("y_conf"), False),
            (full, q, "layout", specs.UNREAD_CONF, True),
        ]
    lit = lambda x: x if isinstance(x, F.Column) else F.lit(x)
    picks = [
        F.when(c, F.struct(base.alias("_base"), F.lit(source).alias("source"), lit(conf).cast("double").alias("conf"), F.lit(review).alias("needs_review")))
        for c, base, source, conf, review in rules
    ]
    at = at.select("*", F.inline(F.array_compact(F.array(F.coalesce(*picks)))))
    at = _once(at.withColumnRenamed("_base", "_raw"), _base=X.clean_cell(F.col("_raw"))).where("_base <> ''")
    base, c = F.col("_base"), F.col("c")
    text = F.when(X.is_ditto(base), F.lit("-ll-"))
    if engine != "layout":
        text = text.when(sampling & (c == 0) & X.is_ditto_loose(base), F.lit("-ll-")).when(sampling & (c == 2), X.norm_code(base))
    text = text.otherwise(base)
    if engine != "layout":
        text = F.when(kind == "podschet", X.first_number(text)).otherwise(text)
    marked = mark if engine == "hybrid" else F.lit(False)
    reader = F.when(marked, F.lit("")).when(read, y).otherwise(base if engine != "layout" else F.lit(""))
    at = _once(at, text=text).where("text <> ''").withColumn("reader_text", reader)
    return at.drop("_q", "_y", "_mark", "_full", "_read", "_same", "_raw", "_base")


def _once(df: DataFrame, **columns: F.Column) -> DataFrame:
    """Adds columns whose values later filters and projections take as they are, instead of each working them out anew."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def divergence(df: DataFrame, keys: list[str], a: str = "q", b: str = "y") -> DataFrame:
    """(keys, n_both, n_disagree, rate): of cells where both engines have text, those that disagree; null rate without any."""
    both = (X.strict(F.col(a)) != "") & (X.strict(F.col(b)) != "")
    out = df.groupBy(*keys).agg(F.count_if(both).alias("n_both"), F.count_if(both & ~X.agree(F.col(a), F.col(b))).alias("n_disagree"))
    return out.withColumn("rate", F.try_divide(F.col("n_disagree"), F.col("n_both")))


def scored_divergence(df: DataFrame, keys: list[str], a: str = "q", b: str = "y") -> DataFrame:
    """As divergence, but by inequality of the scorer's texts."""
    both = (X.strict(F.col(a)) != "") & (X.strict(F.col(b)) != "")
    out = df.groupBy(*keys).agg(F.count_if(both).alias("n_both"), F.count_if(both & (X.fuzzy(F.col(a)) != X.fuzzy(F.col(b)))).alias("n_disagree"))
    return out.withColumn("rate", F.try_divide(F.col("n_disagree"), F.col("n_both")))


def blank_repeats(cells: DataFrame, keys: list[str], left: list[int], right: list[int], text: str = "text", when: F.Column | None = None) -> DataFrame:
    """Of rows with `when` (all), blanks a number of columns `left` whose digits (two or more) hold, or are held by, those of a column `right` of its row.

    A row's right-hand digits are gathered by a window, at most one for each right column, so the self join needs no pairs.
    """
    d = X.digits(F.col(text))
    own = Window.partitionBy(*keys)
    others = F.collect_set(F.when(F.col("c").isin(right) & (d != ""), d)).over(own)
    hit = (F.lit(True) if when is None else when) & F.col("c").isin(left) & (F.length(d) >= 2) & F.exists("_others", lambda x: F.contains(x, d) | F.contains(d, x))
    return cells.withColumn("_others", others).withColumn(text, F.when(hit, F.lit("")).otherwise(F.col(text))).drop("_others")


def mismatch(layout_rows: F.Column, found_rows: F.Column) -> F.Column:
    """Whether geometry found more rows than the page has rules for."""
    return (found_rows > 0) & (layout_rows > 0) & (found_rows > layout_rows)
