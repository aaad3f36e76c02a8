"""Line dedup: repeated runs of lines, by a suffix array over line ids.

Lines become ids, and every suffix of a document's sequence of repeated lines gets its rank among all
suffixes by distributed prefix doubling: the rank of the first 2 ** (k + 1) lines is that of the pair (rank
of the first 2 ** k, rank of the next 2 ** k), found by counting distinct pairs. Lines that occur
once can't be in a repeat; a suffix ends before them, and before its document's end. The suffixes that
agree in their first l lines are a common-prefix interval of the array, known by the ranks of two
overlapping powers of two. Within each interval, all but the first suffix (by document, then line) are later copies.

A run counts if it has at least `min_words` words (a line has one at least); its later copies are
deleted, the first stays. Only as many lines as decide this are compared: up to the first run from
the next line on that is long enough by itself; longer runs are found from there. So a suffix has at most
min_words + 1 lines, six doublings at most by default, whatever the corpus.

Edge cases: null text stays null; spaces at the end of a line don't count in comparing; blank
lines count as lines of one word; a document of which all lines go has the text ''. Rows that repeat
id and text are one document and never copies of one another; of equal texts under several ids, the
least id's stays; a null id stands before all others. Other columns are kept by `dedup`, whatever
their names: one named removed_lines makes the new column removed_lines_. An empty table gives no
rows. `stage` treats each case alike, drops documents of which nothing is left, and keeps null and blank texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.llm import util

MIN_WORDS = 50


RANGES = 128  # of a sum over ordered counts: no task sums more rows than these, or one range


def _before(counted: DataFrame, group: list[str], order: list[str], place: Column) -> DataFrame:
    """Adds `before`, the sum of n of the rows of the same group that stand before each by `order`.

    place, the number of a range, must not decrease along `order`; a group is summed by ranges, then within each.
    """
    counted = counted.withColumn("b", place)
    within = F.sum("n").over(Window.partitionBy(*group, "b").orderBy(*order)) - F.col("n")
    ranges = counted.groupBy(*group, "b").agg(F.sum("n").alias("m"))
    ranges = ranges.select(*group, "b", (F.sum("m").over(Window.partitionBy(*group or [F.lit(0)]).orderBy("b")) - F.col("m")).alias("start"))
    both = counted.withColumn("within", within).join(ranges if group else F.broadcast(ranges), [*group, "b"])
    return both.withColumn("before", F.col("start") + F.col("within")).drop("b", "within", "start")


def _ids(lines: DataFrame) -> DataFrame:
    """(h1, h2, rank) of each line that occurs more than once: the place where the array's suffixes begin with it."""
    counted = lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return _before(counted, [], ["h1", "h2"], F.shiftright("h1", 52)).select("h1", "h2", (F.col("before") + 1).alias("rank"))


def _sequences(lines: DataFrame) -> DataFrame:
    """(d, th, a) of each document with repeated lines, a its array of (pos, words, rank) in order."""
    repeated = lines.join(_ids(lines).hint("rebalance"), ["h1", "h2"]).select("d", "th", "pos", "words", "rank").distinct()
    return repeated.groupBy("d", "th").agg(F.sort_array(F.collect_list(F.struct("pos", "words", "rank"))).alias("a"))


def _limits(min_words: int):
    """Adds, for each suffix, the lines in its first run of enough words (0: none), and the lines to compare."""

    def of(pos: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(pos)
        total = np.concatenate([[0], np.cumsum(words)])
        end = np.append(np.flatnonzero(np.diff(pos) != 1) + 1, n)
        end = end[np.searchsorted(end, np.arange(n), "right")]  # where each suffix's lines end
        reach = np.searchsorted(total, total[:-1] + min_words)  # the first end with enough words
        enough = np.where(reach <= end, reach - np.arange(n), 0)
        after = np.append(reach[1:], n + 1)
        most = np.where(enough > 0, np.minimum(after, end) - np.arange(n), 0)
        return enough, np.maximum(most, enough)

    def run(batches):
        for pdf in batches:
            found = [of(np.array([x["pos"] for x in a]), np.array([x["words"] for x in a])) for a in pdf["a"]]
            yield pd.DataFrame({
                "d": pdf["d"], "th": pdf["th"], "pos": [[x["pos"] for x in a] for a in pdf["a"]], "enough": [e.tolist() for e, _ in found],
                "most": [m.tolist() for _, m in found], "r0": [[x["rank"] for x in a] for a in pdf["a"]],
            })

    return run


def _double(docs: DataFrame, k: int, top: int) -> DataFrame:
    """Ranks are `top` at most. Adds r{k + 1}, the ranks of the first 2 ** (k + 1) lines (0: the suffix has fewer), to arrays r0 .. r{k}."""
    old, new, step = f"r{k}", f"r{k + 1}", 2**k
    pairs = docs.select("d", "th", F.posexplode(old).alias("i", "r"), "pos", old).select(
        "d", "th", "i", "r",
        F.when(F.get("pos", F.col("i") + step) == F.get("pos", F.col("i")) + step, F.get(old, F.col("i") + step)).otherwise(0).alias("s"),
    )
    whole = pairs.where("r > 0 and s > 0")
    seen = whole.groupBy("r", "s").agg(F.count(F.lit(1)).alias("n"))
    ranked = _before(seen, ["r"], ["s"], F.floor(F.col("s") / (top // RANGES + 1))).select(F.col("r").alias("r_"), F.col("s").alias("s_"), (F.col("r") + F.col("before")).alias("new"))
    named = whole.join(ranked.hint("rebalance"), (F.col("r") == F.col("r_")) & (F.col("s") == F.col("s_")))
    back = named.groupBy("d", "th").agg(F.collect_list(F.struct("i", "new")).alias("found"))

    def fill(batches):
        for pdf in batches:
            column = []
            for pos, found in zip(pdf["pos"], pdf["found"]):
                rank = np.zeros(len(pos), dtype=np.int64)
                for x in found if found is not None else ():
                    rank[x["i"]] = x["new"]
                column.append(rank)
            pdf[new] = column
            yield pdf.drop(columns="found")

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.join(back, ["d", "th"], "left").mapInPandas(fill, f"{schema}, {new} array<long>")


def copies(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(d, th, spans array<struct<start, end>>) of lines that are later copies, end exclusive, by document key."""
    line = F.rtrim("line")
    lines = docs.select(*util.key_of(F.col("doc_id"), F.col("text")), F.posexplode(F.split("text", "\n")).alias("pos", "line")).select(
        "d", "th", "pos", F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2"), (F.length("line") - F.length(F.replace(F.col("line"), F.lit(" "), F.lit(""))) + 1).cast("long").alias("words")
    )
    schema = "d long, th long, pos array<long>, enough array<long>, most array<long>, r0 array<long>"
    at = util.stash(_sequences(lines).mapInPandas(_limits(min_words), schema).where(F.exists("enough", lambda x: x > 0)))
    longest, top, n_lines = at.agg(F.max(F.array_max("most")), F.max(F.array_max("r0")), F.sum(F.size("pos"))).first()
    levels = max(0, int(longest or 0).bit_length() - 1)
    for k in range(levels):
        at = util.stash(_double(at, k, top).coalesce(util.files(at.sparkSession, n_lines)), instead_of=[at])

    def prefixes(batches):
        """For each suffix that is long enough and each length to compare: the interval's name."""
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                ranks = [getattr(row, f"r{k}") for k in range(levels + 1)]
                for i in np.flatnonzero(np.asarray(row.enough) > 0).tolist():
                    for n in range(row.enough[i], row.most[i] + 1):
                        k = int(n).bit_length() - 1
                        out.append((row.d, row.th, row.pos[i], n, ranks[k][i], ranks[k][i + n - 2**k]))
            yield pd.DataFrame(out, columns=["d", "th", "pos", "n", "a", "b"])

    named = at.mapInPandas(prefixes, "d long, th long, pos long, n long, a long, b long")
    own = F.struct("d", "th", "pos")
    first = named.groupBy("n", "a", "b").agg(F.min(own).alias("first"), F.max(own).alias("last")).where("first < last").hint("rebalance")  # dealt anew, so that the join can split a hot interval
    later = named.join(first, ["n", "a", "b"]).where(F.col("first") < own)
    longest_each = later.groupBy("d", "th", "pos").agg(F.max("n").alias("n"))
    return longest_each.groupBy("d", "th").agg(F.sort_array(F.collect_list(F.struct(F.col("pos").alias("start"), (F.col("pos") + F.col("n")).alias("end")))).alias("spans"))


def merged(spans) -> list[list[int]]:
    out: list[list[int]] = []
    for s in spans:
        if out and s["start"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s["end"])
        else:
            out.append([s["start"], s["end"]])
    return out


def without(text: str, spans: list[list[int]]) -> str:
    lines, out, at = text.split("\n"), [], 0
    for s, e in spans:
        out += lines[at:s]
        at = e
    return "\n".join(out + lines[at:])


def dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs without later copies of repeated runs of lines; a column `removed_lines` lists the runs that went."""
    d_, th_, spans_, cut_, removed = util.free(docs.columns, "d", "th", "spans", "cut", "removed_lines")
    d, th = util.key_of(F.col("doc_id"), F.col("text"))
    found = copies(docs, min_words).withColumnsRenamed({"d": d_, "th": th_, "spans": spans_})
    joined = docs.join(found, (d == F.col(d_)) & (th == F.col(th_)), "left")

    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for text, spans in batches:
            runs = [merged(s) if s is not None else [] for s in spans]
            yield pd.DataFrame({"text": [without(t, r) if r else t for t, r in zip(text, runs)], "runs": runs})

    once = F.pandas_udf(cut, "text string, runs array<array<long>>").asNondeterministic()  # else a filter on what it returns is pushed below it and runs it again, in a second Python worker of the same task
    done = joined.withColumn(cut_, once("text", spans_))
    kept = [F.col(cut_)["text"].alias(c) if c.lower() == "text" else col for c, col in zip(docs.columns, util.named(docs.columns))]
    return done.select(*kept, F.col(cut_)["runs"].alias(removed))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = util.table(spark, sf_dir, "documents")
    docs = dedup(documents.select("doc_id", "text"))
    n_removed = F.aggregate("removed_lines", F.lit(0).cast("long"), lambda acc, x: acc + x[1] - x[0])
    runs = F.array_join(F.transform("removed_lines", lambda x: F.concat_ws(":", x[0].cast("string"), x[1].cast("string"))), ",")
    digests = docs.select("doc_id", n_removed.alias("n_removed"), runs.alias("removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
    return digests.repartition(util.files(spark, documents.count()))  # small rows, dealt anew: not a file for each partition of the texts


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later copies; a document of which nothing is left goes."""
    (removed,) = util.free(docs.columns, "removed_lines")
    left = dedup(docs)
    return left.where((F.size(removed) == 0) | (F.trim(F.coalesce("text", F.lit(""))) != "")).select(*util.named(docs.columns))


SQL = r"""
WITH l AS MATERIALIZED (
  SELECT doc_id, i, line, len(line) - len(replace(line, ' ', '')) + 1 AS w FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents WHERE text IS NOT NULL)
), t AS MATERIALIZED (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS upto FROM l),
runs AS MATERIALIZED (
  SELECT a.doc_id, a.i AS s, min(b.i) AS e FROM t AS a JOIN t AS b ON a.doc_id = b.doc_id AND b.i >= a.i AND b.upto - a.upto + a.w >= 50 GROUP BY a.doc_id, a.i
  UNION
  SELECT b.doc_id, max(a.i), b.i FROM t AS a JOIN t AS b ON a.doc_id = b.doc_id AND b.i >= a.i AND b.upto - a.upto + a.w >= 50 GROUP BY b.doc_id, b.i
), whole AS (SELECT doc_id, list(rtrim(line, ' ') ORDER BY i) AS lines FROM l GROUP BY doc_id),
keyed AS MATERIALIZED (SELECT doc_id, s, e, array_to_string(lines[s + 1 : e + 1], chr(10)) AS k FROM runs JOIN whole USING (doc_id)),
later AS (SELECT doc_id, s, e FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS n FROM keyed) WHERE n > 1),
gone AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(range(s, e + 1)) AS i FROM later),
islands AS (SELECT doc_id, min(i) AS a, max(i) + 1 AS b FROM (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS g FROM gone) GROUP BY doc_id, g),
spans AS (SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS n_removed, string_agg(a || ':' || b, ',' ORDER BY a) AS removed FROM islands GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text FROM l ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_removed, 0) AS n_removed, coalesce(removed, '') AS removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM documents AS d LEFT JOIN spans USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
