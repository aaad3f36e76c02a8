"""Scoring cells, rows, merges and column numbers against truth.

A truth file names a borehole and its objects by their printed names; `truth_cells`, `truth_merges` and
`truth_numbers` make relations of such files, `report` is all figures of a result against them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import text as X
from gridloom.plans import specs


def judged(truth: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """truth (keys, kind, r, c, text, ditto) with strict and fuzzy hits and `fixed` (by construction); empty and graphic cells go; a missing cell is blank."""
    real = truth.where("not coalesce(empty, false) and not coalesce(graphic, false)").where(X.strict(F.col("text")) != "")
    on = [*keys, "kind", "r", "c"]
    both = real.join(found.select(*on, F.col("text").alias("_got")), on, "left")
    got = F.coalesce("_got", F.lit(""))
    fixed = F.coalesce(F.col("ditto"), F.lit(False))
    for kind, columns in specs.FIXED_COLUMNS.items():
        fixed = fixed | ((F.col("kind") == kind) & F.col("c").isin(*columns))
    return both.select(*on, (X.strict(F.col("text")) == X.strict(got)).alias("strict"), (X.fuzzy(F.col("text")) == X.fuzzy(got)).alias("fuzzy"), fixed.alias("fixed"))


def counted(hits: DataFrame, by: list[str]) -> DataFrame:
    """(by, total, n_strict, n_fuzzy): hits summed once, so that figures of several groupings share the work before."""
    return hits.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), F.count_if("strict").alias("n_strict"), F.count_if("fuzzy").alias("n_fuzzy"))


def shares(sums: DataFrame, by: list[str]) -> DataFrame:
    """Totals and shares of `counted` for each group and over all (null group)."""
    out = sums.rollup(*by).agg(*[F.sum(c).alias(c) for c in ("total", "n_strict", "n_fuzzy")])
    return out.withColumns({"strict_share": F.col("n_strict") / F.col("total"), "fuzzy_share": F.col("n_fuzzy") / F.col("total")})


def accuracy(hits: DataFrame, by: list[str]) -> DataFrame:
    """Totals and shares for each group and over all (null group), in one pass."""
    return shares(counted(hits, by), by)


def row_counts(tables: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_rows) of every table, 0 where it has no cell."""
    n = cells.groupBy(*keys).agg(F.countDistinct("r").alias("n"))
    return tables.join(n, keys, "left").select(*keys, F.coalesce("n", F.lit(0)).alias("n_rows"))


def same_sets(a: DataFrame, b: DataFrame, key: str, item: str) -> DataFrame:
    """(key, same): whether both hold the same set of items for a key."""
    both = a.select(key, item, F.lit(1).alias("s")).unionByName(b.select(key, item, F.lit(2).alias("s"))).groupBy(key, item).agg(F.collect_set("s").alias("s"))
    return both.groupBy(key).agg(F.min(F.size("s") == 2).alias("same"))


TRUTH = (
    "borehole string, objects map<string, struct<data:array<array<struct<text:string,empty:boolean,graphic:boolean,ditto:boolean>>>, rows:array<array<struct<text:string,empty:boolean,graphic:boolean,ditto:boolean>>>, "
    "merges:array<string>, graph_numbers:array<int>>>"
)


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """(path, borehole, objects) of truth files, one JSON object each."""
    return spark.read.schema(TRUTH).option("multiLine", True).json(path).withColumn("path", F.col("_metadata.file_path"))


def kind_of(name: F.Column) -> F.Column:
    """The kind that a truth file's name of an object means; an unknown name stays as it is."""
    return F.coalesce(F.try_element_at(X.literal_map(specs.TRUTH_KINDS), name), name)


def _objects(truth: DataFrame) -> DataFrame:
    at = truth.select(F.coalesce("borehole", F.lit("")).alias("borehole"), F.explode("objects").alias("name", "object"))
    return at.select("borehole", kind_of(F.col("name")).alias("kind"), "object")


def truth_cells(truth: DataFrame) -> DataFrame:
    """(borehole, kind, r, c, text, empty, graphic, ditto) of truth files; `data` counts before `rows`."""
    rows = _objects(truth).select("borehole", "kind", F.posexplode(F.coalesce("object.data", "object.rows")).alias("r", "row"))
    return rows.select("borehole", "kind", "r", F.posexplode("row").alias("c", "cell")).select("borehole", "kind", "r", "c", "cell.*")


def truth_rows(truth: DataFrame) -> DataFrame:
    """(borehole, kind, truth_rows)."""
    return _objects(truth).select("borehole", "kind", F.coalesce(F.size(F.coalesce("object.data", "object.rows")), F.lit(0)).alias("truth_rows")).withColumn("truth_rows", F.greatest("truth_rows", F.lit(0)))


def truth_merges(truth: DataFrame) -> DataFrame:
    """(borehole, kind, item) of each merged range; an object without any has one row of null."""
    return _objects(truth).select("borehole", "kind", F.explode_outer("object.merges").alias("item"))


def truth_numbers(truth: DataFrame) -> DataFrame:
    """(borehole, kind, numbers) of objects whose column numbers the truth has."""
    return _objects(truth).where("object.graph_numbers is not null").select("borehole", "kind", F.col("object.graph_numbers").alias("numbers"))


def numbers_match(numbers: DataFrame) -> DataFrame:
    """Adds same: whether the printed numbers of the kind's columns are these, in order; false for a kind without any."""
    own = F.try_element_at(X.literal_map(specs.GRAPH_NUMBERS), F.col("kind"))
    known = F.coalesce(own, F.when(F.col("kind").isin(*specs.KINDS), F.array().cast("array<int>")))
    return numbers.withColumn("same", F.coalesce(known == F.col("numbers"), F.lit(False)))


def merges_match(truth: DataFrame, got: DataFrame) -> DataFrame:
    """(borehole, kind, same) of merged ranges: truth and got are (borehole, kind, item); an object of the truth without a sheet has none."""
    on = ["borehole", "kind"]
    wanted = truth.select(*on).distinct()
    both = truth.where("item is not null").select(*on, "item", F.lit(1).alias("s")).unionByName(got.join(wanted, on, "left_semi").select(*on, "item", F.lit(2).alias("s")))
    odd = both.groupBy(*on, "item").agg(F.countDistinct("s").alias("n")).where("n < 2").select(*on).distinct().withColumn("same", F.lit(False))
    return wanted.join(odd, on, "left").select(*on, F.coalesce("same", F.lit(True)).alias("same"))


def of_borehole(named: DataFrame, boreholes: DataFrame) -> DataFrame:
    """Rows of sheets (sheet, ...) with the borehole whose name and an underscore their sheet's name begins with; a truth without a name takes all.

    A sheet's name is cut at each of its underscores, so that this is a join by equality.
    """
    sheet = F.col("sheet")
    ends = F.filter(F.sequence(F.lit(1), F.greatest(F.length(sheet), F.lit(1))), lambda i: F.substring(sheet, i, F.lit(1)) == "_")
    begins = F.array_distinct(F.concat(F.array(F.lit("")), F.transform(ends, lambda i: F.substring(sheet, F.lit(1), i - 1))))
    return named.withColumn("borehole", F.explode(begins)).join(boreholes.select("borehole").distinct(), "borehole").select(*named.columns, "borehole")


def report(truth: DataFrame, cells: DataFrame, tables: DataFrame, merges: DataFrame) -> dict[str, DataFrame]:
    """All figures against truth files: accuracy (by kind, over all, and by bucket), rows, merges, numbers.

    truth: as `read_truth` gives it. cells: (sheet, kind, r, c, text) of data rows; tables: (sheet, kind, n_rows); merges: (sheet, kind, item).
    """
    wanted = truth_cells(truth)
    hits = judged(wanted, of_borehole(cells, truth.select(F.coalesce("borehole", F.lit("")).alias("borehole"))), ["borehole"])
    sums = counted(hits, ["borehole", "kind", "fixed"])
    named = truth.select(F.coalesce("borehole", F.lit("")).alias("borehole"))
    n = truth_rows(truth).join(of_borehole(tables, named).select("borehole", "kind", "n_rows"), ["borehole", "kind"], "left")
    return {
        "accuracy": shares(sums, ["borehole", "kind"]),
        "buckets": shares(sums, ["fixed"]),
        "rows": n.select("borehole", "kind", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), "truth_rows"),
        "merges": merges_match(truth_merges(truth), of_borehole(merges, named)),
        "numbers": numbers_match(truth_numbers(truth)),
    }


def write_report(found: dict[str, DataFrame], path: str) -> None:
    """Each part of a report as JSON lines in a folder of its own."""
    for name, df in found.items():
        df.write.mode("overwrite").json(f"{path}/{name}")


def summary_lines(found: dict[str, DataFrame]) -> list[str]:
    """A report as text. Boreholes are summed before anything is gathered, so there is a row for each kind."""
    share = lambda a, b: f"{a}/{b}={a / b:.1%}" if b else "-"
    sums = [F.sum(c).alias(c) for c in ("n_strict", "n_fuzzy", "total")]
    all_ = found["accuracy"].where("borehole is null and kind is null").select(F.lit("all").alias("kind"), "n_strict", "n_fuzzy", "total").collect()
    kinds = found["accuracy"].where("kind is not null").groupBy("kind").agg(*sums).orderBy("kind").collect()
    out = [f"text {r['kind']}: strict {share(r['n_strict'], r['total'])}, fuzzy {share(r['n_fuzzy'], r['total'])}" for r in [*all_, *kinds]]
    for r in found["buckets"].where("fixed is not null").orderBy("fixed").collect():
        out.append(f"{'fixed' if r['fixed'] else 'live'}: fuzzy {share(r['n_fuzzy'], r['total'])}")
    rows = found["rows"].groupBy("kind").agg(F.sum("n_rows").alias("n_rows"), F.sum("truth_rows").alias("truth_rows")).orderBy("kind").collect()
    out.append("rows: " + ", ".join(f"{r['kind']}={r['n_rows']}/{r['truth_rows']}" for r in rows))
    for name in ("merges", "numbers"):
        bad = [r["kind"] for r in found[name].where("not same").select("kind").distinct().orderBy("kind").collect()]
        out.append(f"{name}: {'all match' if not bad else 'differ in ' + ', '.join(bad)}")
    return out
