"""All queries over the reference's operators, and their SQL."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.functions import text as X
from gridloom.operators import annotation, cache, cluster, ditto, forms, identity, inventory, kernels, layout, reconcile, score, tables
from gridloom.plans import duck as D
from gridloom.plans import lenses as L
from gridloom.plans import specs
from gridloom.plans import process
from gridloom.sinks import sheets
from gridloom.streaming import sessions

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def bounds(spark: SparkSession, kind: str = "journal_left", width: int = 300) -> DataFrame:
    return layout.column_bounds(layout.spec_columns(spark), width).where(F.col("kind") == kind)


SPEC_COLUMNS = D.values(specs.column_rows(), "s(kind, ci, label, group_label, width, frac)")
BANDS = "bands AS (SELECT * FROM " + D.values(list(zip(range(8), L.BOUNDS, L.BOUNDS[1:])), "b(ci, lo, hi)") + ")"
CLUSTERS = f"""{L.WORDS}, gaps AS (SELECT *, CASE WHEN y - lag(y) OVER w > {L.TOL} THEN 1 ELSE 0 END AS new FROM words WINDOW w AS (PARTITION BY table_id ORDER BY y, word_id)),
grouped AS (SELECT *, CAST(sum(new) OVER (PARTITION BY table_id ORDER BY y, word_id ROWS UNBOUNDED PRECEDING) AS INTEGER) AS grp FROM gaps),
centres AS (SELECT table_id, grp AS ri, CAST(sum(y) AS DOUBLE) / count(*) AS cy, count(*) AS n FROM grouped GROUP BY table_id, grp)"""
NEAREST = CLUSTERS + """, near AS (
  SELECT w.table_id, w.word_id, any_value(w.y) AS y, any_value(w.cx) AS cx, any_value(w.text) AS text, arg_min(c.ri, {'d': abs(w.y - c.cy), 'r': c.ri}) AS ri, min(abs(w.y - c.cy)) AS dist
  FROM words AS w JOIN centres AS c USING (table_id) GROUP BY w.table_id, w.word_id)"""


def grouped(spark: SparkSession, sf: str) -> DataFrame:
    return cluster.gap_groups(L.words(spark, sf), ["table_id"], "y", float(L.TOL), ["word_id"])


# Rows and columns from positions


@query(f"WITH {NEAREST}, {BANDS} SELECT table_id, ri, ci, string_agg(text, ' ' ORDER BY cx, word_id) AS text, count(*) AS n FROM near JOIN bands ON cx >= lo AND cx < hi GROUP BY table_id, ri, ci")
def grid_reconstruct(spark, sf):
    return layout.reconstruct(L.words(spark, sf), bounds(spark), float(L.TOL))


@query(f"WITH {CLUSTERS} SELECT table_id, ri, CAST(floor(cy) AS BIGINT) AS cy, n FROM centres")
def row_gap_cluster(spark, sf):
    return cluster.centres(grouped(spark, sf), ["table_id"], "y").withColumn("cy", F.floor("cy"))


@query(f"WITH {NEAREST} SELECT word_id, ri, ri = grp AS own FROM near JOIN grouped USING (table_id, word_id)")
def nearest_row_assign(spark, sf):
    g = grouped(spark, sf)
    return cluster.nearest(g, cluster.centres(g, ["table_id"], "y"), ["table_id"], "y").select("word_id", "ri", (F.col("ri") == F.col("grp")).alias("own"))


@query(f"WITH {L.WORDS}, {BANDS} SELECT word_id, ci FROM words LEFT JOIN bands ON cx >= lo AND cx < hi")
def column_band_assign(spark, sf):
    return layout.place(L.words(spark, sf), bounds(spark)).select("word_id", "ci")


def kind_of(key: str) -> F.Column:
    """A kind for each row of a table, by its key."""
    return F.get(F.array(*map(F.lit, specs.KINDS)), (F.col(key) % len(specs.KINDS)).cast("int")).alias("kind")


def kind_sql(key: str) -> str:
    return f"[{', '.join(map(D.q, specs.KINDS))}][{key} % {len(specs.KINDS)} + 1]"


@query(f"""WITH p AS (SELECT DISTINCT {kind_sql('p_partkey')} AS kind, 300 + 20 * p_size AS w FROM part), s AS (SELECT *, sum(frac) OVER w AS run FROM {SPEC_COLUMNS} WINDOW w AS (PARTITION BY kind ORDER BY ci ROWS UNBOUNDED PRECEDING)), t AS (
SELECT s.*, w, last_value(run) OVER (PARTITION BY kind, w ORDER BY ci ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS total, max(ci) OVER (PARTITION BY kind, w) AS last FROM s JOIN p USING (kind)),
h AS (SELECT kind, w, ci, CAST(CASE WHEN ci = last THEN w ELSE round_even(run / total * w, 0) END AS INTEGER) AS hi FROM t)
SELECT kind, w AS page_width, ci, coalesce(lag(hi) OVER (PARTITION BY kind, w ORDER BY ci), 0) AS lo, hi FROM h""")
def column_bounds(spark, sf):
    """Bounds for tables of every kind and width, widths from the sizes of `part`."""
    own = L.table(spark, sf, "part").select(kind_of("p_partkey"), (300 + 20 * F.col("p_size")).alias("page_width")).distinct()
    return layout.column_bounds(own.join(F.broadcast(layout.spec_columns(spark)), "kind"), F.col("page_width"), ("page_width",))


H, HEAD, N = 1400.0, 2, 5
BAND0 = H * (1 - HEAD / (HEAD + N)) / N
FIXED = f"""words AS (SELECT user_id AS table_id, event_id AS word_id, CAST(event_id * 7919 % 1400 AS DOUBLE) AS y, CAST(event_id % 5 AS INTEGER) AS ci, event_type AS text FROM events),
a AS (SELECT *, CASE WHEN y - lag(y) OVER (PARTITION BY table_id ORDER BY y, word_id) > {0.5 * BAND0!r} THEN 1 ELSE 0 END AS new FROM words WHERE ci = 0),
b AS (SELECT *, sum(new) OVER (PARTITION BY table_id ORDER BY y, word_id ROWS UNBOUNDED PRECEDING) AS grp FROM a),
c AS (SELECT table_id, CAST(grp AS INTEGER) AS ri, CAST(sum(y) AS DOUBLE) / count(*) AS cy FROM b GROUP BY table_id, grp),
n AS (SELECT t.table_id, coalesce(count(c.ri) = {N}, false) AS own, CASE WHEN count(c.ri) = {N} THEN (max(cy) - min(cy)) / {N - 1} ELSE {BAND0!r} END AS band FROM (SELECT DISTINCT table_id FROM words) AS t LEFT JOIN c USING (table_id) GROUP BY t.table_id),
anchors AS (SELECT table_id, ri, cy FROM c JOIN n USING (table_id) WHERE own UNION ALL SELECT table_id, i, {H * HEAD / (HEAD + N)!r} + (i + 0.5) * {BAND0!r} FROM n, range({N}) AS t(i) WHERE NOT own),
near AS (SELECT w.table_id, w.word_id, any_value(w.ci) AS ci, arg_min(ri, {{'d': abs(y - cy), 'r': ri}}) AS r, min(abs(y - cy)) AS dist FROM words AS w JOIN anchors USING (table_id) WHERE NOT {D.junk('text')} GROUP BY w.table_id, w.word_id)"""


@query(f"WITH {FIXED} SELECT table_id, word_id, ci, CAST(r AS INTEGER) AS r FROM near JOIN n USING (table_id) WHERE dist <= 0.5 * band")
def fixed_row_anchor(spark, sf):
    e = L.table(spark, sf, "events")
    k = F.col("event_id")
    words = e.select(F.col("user_id").alias("table_id"), k.alias("word_id"), (k * 7919 % 1400).cast("double").alias("y"), (k % 5).cast("int").alias("ci"), F.col("event_type").alias("text"))
    return layout.fixed_rows(words, H, HEAD, N).select("table_id", "word_id", "ci", "r")


@query(f"WITH {CLUSTERS}, g AS (SELECT *, lead(cy) OVER (PARTITION BY table_id ORDER BY ri) - cy AS gap FROM centres) SELECT table_id, round(coalesce(median(gap), 70.0), 3) AS pitch FROM g GROUP BY table_id")
def row_pitch_median(spark, sf):
    return cluster.pitch(cluster.centres(grouped(spark, sf), ["table_id"], "y"), ["table_id"], 0.05 * H).withColumn("pitch", F.round("pitch", 3))


WORD_CELLS = "cells AS (SELECT doc_id AS table_id, r AS ri, CAST(i % 3 AS INTEGER) AS ci, i AS pos, word AS text FROM (SELECT doc_id, r, unnest(range(len(string_split(line, ' ')))) AS i, unnest(string_split(line, ' ')) AS word FROM lines))"


def word_cells(spark: SparkSession, sf: str) -> DataFrame:
    at = L.lines(spark, sf).select(F.col("doc_id").alias("table_id"), F.col("r").alias("ri"), F.posexplode(F.split("line", " ")).alias("pos", "text"))
    return at.withColumn("ci", F.col("pos") % 3)


@query(f"WITH {L.LINES}, {WORD_CELLS} SELECT table_id, ri, ci, {D.strip("string_agg(text, ' ' ORDER BY pos)")} AS text, count(*) AS n FROM cells GROUP BY table_id, ri, ci")
def slot_text_concat(spark, sf):
    return layout.slots(word_cells(spark, sf), ["table_id", "ri", "ci"], ["pos"])


BODY_CELLS = f"""body AS (SELECT table_id, ri, ci, {D.strip("string_agg(text, ' ' ORDER BY pos)")} AS text FROM cells GROUP BY table_id, ri, ci
UNION ALL SELECT -2 - v.t, c.ri, c.ci, c.text FROM (VALUES (0), (1), (2)) AS v(t), {D.values([(0, 0, 'Описание разреза'), (1, 0, '1'), (2, 0, '2'), (2, 1, 'Категория'), (3, 1, 'глубина'), (3, 0, 'xx'), (4, 0, '4'), (5, 0, 'Геолог'), (6, 0, '6')], 'c(ri, ci, text)')} WHERE NOT (v.t = 1 AND c.ri IN (1, 2, 4, 6)) AND NOT (v.t = 2 AND c.ri = 5))"""
BODY_ROWS = [(0, 0, "Описание разреза"), (1, 0, "1"), (2, 0, "2"), (2, 1, "Категория"), (3, 1, "глубина"), (3, 0, "xx"), (4, 0, "4"), (5, 0, "Геолог"), (6, 0, "6")]


@query(f"""WITH {L.LINES}, {WORD_CELLS}, {BODY_CELLS}, m AS (
  SELECT *, max(CASE WHEN {D.key('text', 'ci')} THEN 1 ELSE 0 END) OVER w AS k, max(CASE WHEN {D.stem('lower(text)', specs.FOOTER_STEMS)} THEN 1 ELSE 0 END) OVER w AS f,
         max(CASE WHEN {D.stem('lower(text)', specs.HEADER_STEMS)} THEN 1 ELSE 0 END) OVER w AS h FROM body WINDOW w AS (PARTITION BY table_id, ri)
), b AS (SELECT *, coalesce(min(CASE WHEN k = 1 THEN ri END) OVER (PARTITION BY table_id), min(ri) OVER (PARTITION BY table_id)) AS first FROM m),
e AS (SELECT *, min(CASE WHEN f = 1 AND ri >= first THEN ri END) OVER (PARTITION BY table_id) AS ends FROM b)
SELECT table_id, ri, ci, text FROM e WHERE ri >= first AND (ends IS NULL OR ri < ends) AND NOT (k = 0 AND h = 1)""")
def header_trim_footer_cut(spark, sf):
    made = spark.createDataFrame(BODY_ROWS, "ri int, ci int, text string").crossJoin(spark.range(3).withColumnRenamed("id", "t"))
    made = made.where("not (t = 1 and ri in (1, 2, 4, 6)) and not (t = 2 and ri = 5)").select((-2 - F.col("t")).alias("table_id"), "ri", "ci", "text")
    real = layout.slots(word_cells(spark, sf).repartition("table_id"), ["table_id", "ri", "ci"], ["pos"]).drop("n")
    return layout.table_body(real.unionByName(made)).select("table_id", "ri", "ci", "text")


# Text rules


@query(f"WITH {L.TOKENS} SELECT word, n, {D.junk('word')} AS junk FROM tokens")
def junk_word_filter(spark, sf):
    return L.tokens(spark, sf).withColumn("junk", X.is_junk(F.col("word")))


@query(f"WITH {L.TOKENS} SELECT word, n, {D.ditto('word')} AS ditto FROM tokens")
def ditto_strict_flag(spark, sf):
    return L.tokens(spark, sf).withColumn("ditto", X.is_ditto(F.col("word")))


@query(f"WITH {L.TOKENS} SELECT word, n, {D.loose('word')} AS ditto FROM tokens")
def ditto_loose_flag(spark, sf):
    return L.tokens(spark, sf).withColumn("ditto", X.is_ditto_loose(F.col("word")))


def expanded(when: str | None) -> str:
    hit = f"{D.ditto('text')} AND last IS NOT NULL" + (f" AND {when}" if when else "")
    return f"""WITH {L.MARKED}, f AS (SELECT *, last_value(CASE WHEN NOT {D.ditto('text')} AND {D.strict('text')} <> '' THEN text END IGNORE NULLS)
      OVER (PARTITION BY table_id ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM marked)
    SELECT table_id, r, CASE WHEN {hit} THEN last ELSE text END AS value, {hit} AS expanded FROM f"""


@query(expanded(None))
def ditto_expand(spark, sf):
    return ditto.expand(L.marked(spark, sf), ["table_id"], ["r"]).select("table_id", "r", "value", "expanded")


@query(expanded("c > 0"))
def ditto_expand_mask_labelled(spark, sf):
    return ditto.expand(L.marked(spark, sf), ["table_id"], ["r"], when=F.col("c") > 0).select("table_id", "r", "value", "expanded")


def over_lines(name: str, column, sql: str) -> None:
    def run(spark, sf):
        return L.lines(spark, sf).select("doc_id", "r", column(F.col("line")).alias("out"))

    run.__name__ = name
    query(f"WITH {L.LINES} SELECT doc_id, r, {sql} AS out FROM lines")(run)


over_lines("text_norm", X.norm, D.norm("line"))
over_lines("clean_cell", X.clean_cell, D.clean("line"))
over_lines("fuzzy_text", X.fuzzy, D.fuzzy("line"))
over_lines("strict_text", X.strict, D.strict("line"))
over_lines("first_number", X.first_number, D.number("line"))
over_lines("digits_only", X.digits, D.digits("line"))
over_lines("mask_secrets", X.mask_secrets, D.secrets("line"))


@query(f"WITH {L.TOKENS} SELECT word, n, {D.code('word')} AS code FROM tokens")
def code_normalize(spark, sf):
    return L.tokens(spark, sf).withColumn("code", X.norm_code(F.col("word")))


@query(f"WITH {L.TOKENS} SELECT word, {D.key('word', '0')} AS key0, {D.key('word', '1')} AS key1, {D.key('word', '2')} AS key2 FROM tokens")
def row_key_test(spark, sf):
    return L.tokens(spark, sf).select("word", *[X.looks_key(F.col("word"), F.lit(c)).alias(f"key{c}") for c in range(3)])


# Two engines' readings


@query(f"WITH {L.ENGINES} SELECT table_id, r, {D.agree('q', 'y')} AS agree FROM engines")
def engines_agree(spark, sf):
    return L.engines(spark, sf).select("table_id", "r", X.agree(F.col("q"), F.col("y")).alias("agree"))


def reconciled(kind: str, engine: str) -> str:
    q = "''" if engine == "reader" else "coalesce(q, '')"
    sampling, hybrid = kind == "sampling_right", engine == "hybrid"
    full = f"{D.strict('q')} <> ''"
    rules = []
    if hybrid:
        rules.append((D.ditto("q"), "'-ll-'", "layout", "NULL", False))
        if not sampling:
            rules += [(f"{full} AND y <> '' AND {D.agree('q', 'y')}", "q", "hybrid", "0.95", False), (f"{full} AND y <> ''", "q", "layout", "0.45", True), (full, "q", "layout", "0.5", False)]
        else:
            rules += [(f"y <> '' AND {full} AND {D.agree('q', 'y')}", "y", "hybrid", "y_conf", False), (f"y <> '' AND {full}", "y", "reader", "y_conf", True)]
    rules.append(("y <> ''", "y", "reader", "y_conf", False))
    if hybrid and sampling:
        rules.append((full, "q", "layout", "0.5", True))
    pick = lambda i, show: "CASE " + " ".join(f"WHEN {c} THEN {show(r)}" for c, r in [(x[0], x[i]) for x in rules]) + " END"
    text = f"CASE WHEN {D.ditto('base')} THEN '-ll-' ELSE base END"
    if sampling:
        text = f"CASE WHEN {D.ditto('base')} OR (c = 0 AND {D.loose('base')}) THEN '-ll-' WHEN c = 2 THEN {D.code('base')} ELSE base END"
    if kind == "podschet":
        text = D.number(text)
    mark = D.ditto("q") if hybrid else "false"
    return f"""WITH {L.ENGINES}, e AS (SELECT table_id, r, c, {q} AS q, coalesce(y, '') AS y, y_conf, ink FROM engines), b AS (
      SELECT *, {D.clean(pick(1, str))} AS base, {pick(2, D.q)} AS source, CAST({pick(3, str)} AS DOUBLE) AS conf, {pick(4, lambda x: str(x).lower())} AS needs_review FROM e WHERE ink OR y <> ''
    ), t AS (SELECT *, {text} AS text FROM b WHERE source IS NOT NULL AND base <> '')
    SELECT table_id, r, c, text, source, conf, needs_review, CASE WHEN {mark} THEN '' WHEN y <> '' THEN y ELSE base END AS reader_text FROM t WHERE text <> ''"""


def reconcile_query(name: str, kind: str, engine: str = "hybrid") -> None:
    def run(spark, sf):
        return reconcile.cells(L.engines(spark, sf), kind, engine).select("table_id", "r", "c", "text", "source", "conf", "needs_review", "reader_text")

    run.__name__ = name
    query(reconciled(kind, engine))(run)


reconcile_query("reconcile_journal", "journal_left")
reconcile_query("reconcile_sampling", "sampling_right")
reconcile_query("reconcile_podschet_number", "podschet")
reconcile_query("engine_reader_only", "journal_left", "reader")


@query(f"WITH {L.ENGINES} SELECT table_id, r, c, CASE WHEN {D.ditto(D.clean('q'))} THEN '-ll-' ELSE {D.clean('q')} END AS text FROM engines WHERE {D.strict('q')} <> ''")
def engine_index_grid(spark, sf):
    return reconcile.cells(L.engines(spark, sf), "journal_left", "layout").select("table_id", "r", "c", "text")


def diverged(differ: str) -> str:
    both = f"({D.strict('q')} <> '' AND {D.strict('y')} <> '')"
    return f"""WITH {L.ENGINES}, d AS (SELECT table_id, count(*) FILTER ({both}) AS n_both, count(*) FILTER ({both} AND {differ}) AS n_disagree FROM engines GROUP BY table_id)
    SELECT *, CASE WHEN n_both > 0 THEN round(n_disagree / n_both, 9) END AS rate FROM d"""


@query(diverged(f"NOT {D.agree('q', 'y')}"))
def divergence_pipeline(spark, sf):
    return reconcile.divergence(L.engines(spark, sf), ["table_id"]).withColumn("rate", F.round("rate", 9))


@query(diverged(f"{D.fuzzy('q')} <> {D.fuzzy('y')}"))
def divergence_scorer(spark, sf):
    return reconcile.scored_divergence(L.engines(spark, sf), ["table_id"]).withColumn("rate", F.round("rate", 9))


NUMBERS = """numbers AS (SELECT doc, r, c, text FROM (SELECT l_orderkey AS doc, l_linenumber AS r, i AS c,
  CASE WHEN i < 4 THEN 'x' WHEN i = 4 THEN CAST(l_partkey AS VARCHAR) WHEN i = 5 THEN CAST(l_suppkey AS VARCHAR) || ' кг' WHEN i = 6 THEN CAST(l_partkey % 10 AS VARCHAR)
       WHEN i = 7 THEN CAST(l_suppkey % 100 AS VARCHAR) WHEN i = 8 THEN CASE WHEN l_partkey % 3 = 0 THEN '' ELSE CAST(l_partkey % 100 AS VARCHAR) END ELSE '№' END AS text
  FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY ALL), range(10) AS t(i)))"""


@query(f"""WITH {NUMBERS}, d AS (SELECT *, {D.digits('text')} AS d FROM numbers), o AS (SELECT doc, r, list(d) FILTER (c IN (7, 8, 9) AND d <> '') AS others FROM d GROUP BY doc, r)
SELECT doc, r, CAST(c AS INTEGER) AS c, CASE WHEN c IN (4, 5, 6) AND length(d) >= 2 AND len(list_filter(coalesce(others, []), lambda x: contains(x, d) OR contains(d, x))) > 0 THEN '' ELSE text END AS text FROM d JOIN o USING (doc, r)""")
def dedup_numeric(spark, sf):
    li = L.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("r")).agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"))
    p, s, i = F.col("p"), F.col("s"), F.col("c")
    at = li.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(9))))
    text = (
        F.when(i < 4, F.lit("x")).when(i == 4, p.cast("string")).when(i == 5, F.concat(s.cast("string"), F.lit(" кг"))).when(i == 6, (p % 10).cast("string"))
        .when(i == 7, (s % 100).cast("string")).when(i == 8, F.when(p % 3 == 0, F.lit("")).otherwise((p % 100).cast("string"))).otherwise(F.lit("№"))
    )
    return reconcile.blank_repeats(at.select("doc", "r", "c", text.alias("text")), ["doc", "r"], [4, 5, 6], [7, 8, 9])


# Scores

TRUTH = f"""{L.MARKED}, truth AS (SELECT table_id, {D.q('podschet')} AS kind, r, c, truth AS text, r % 5 = 0 AS ditto FROM marked WHERE table_id % 3 = 0
  UNION ALL SELECT table_id, CASE WHEN table_id % 3 = 1 THEN 'journal_left' ELSE 'kontrol' END, r, c, CAST(price AS VARCHAR), false FROM marked WHERE table_id % 3 > 0),
found AS (SELECT table_id, kind, r, c, CASE (table_id + r) % 4 WHEN 0 THEN text WHEN 1 THEN ' ' || lower(text) WHEN 2 THEN replace(text, '.', ',') ELSE 'zz' END AS text FROM truth WHERE (table_id + r) % 7 > 0),
hits AS (SELECT t.kind, {D.strict('t.text')} = {D.strict('f.text')} AS s, {D.fuzzy('t.text')} = {D.fuzzy("coalesce(f.text, '')")} AS f,
  coalesce(t.ditto, false) OR (t.kind = 'podschet' AND t.c IN (0, 1)) OR (t.kind IN ('pokazateli', 'kontrol', 'samorodki') AND t.c = 0) AS fixed
  FROM truth AS t LEFT JOIN found AS f USING (table_id, kind, r, c))"""


def truth(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    m = L.marked(spark, sf)
    t = F.col("table_id")
    kind = F.when(t % 3 == 0, F.lit("podschet")).when(t % 3 == 1, F.lit("journal_left")).otherwise(F.lit("kontrol"))
    real = m.select("table_id", kind.alias("kind"), "r", "c", F.when(t % 3 == 0, F.col("truth")).otherwise(F.col("price").cast("string")).alias("text"), ((t % 3 == 0) & (F.col("r") % 5 == 0)).alias("ditto"), F.lit(False).alias("empty"), F.lit(False).alias("graphic"))
    k = (t + F.col("r")) % 4
    x = F.col("text")
    got = F.when(k == 0, x).when(k == 1, F.concat(F.lit(" "), F.lower(x))).when(k == 2, F.replace(x, F.lit("."), F.lit(","))).otherwise(F.lit("zz"))
    return real, real.where((t + F.col("r")) % 7 > 0).select("table_id", "kind", "r", "c", got.alias("text"))


def accuracy_sql(by: str) -> str:
    return f"""WITH {TRUTH} SELECT {by}, count(*) AS total, count(*) FILTER (s) AS n_strict, count(*) FILTER (f) AS n_fuzzy,
    round(count(*) FILTER (s) / count(*), 9) AS strict_share, round(count(*) FILTER (f) / count(*), 9) AS fuzzy_share FROM hits GROUP BY GROUPING SETS (({by}), ())"""


def accuracy(spark: SparkSession, sf: str, by: str) -> DataFrame:
    found = score.accuracy(score.judged(*truth(spark, sf), ["table_id"]), [by])
    return found.withColumns({c: F.round(c, 9) for c in ("strict_share", "fuzzy_share")})


@query(accuracy_sql("kind"))
def text_accuracy_by_kind(spark, sf):
    return accuracy(spark, sf, "kind")


@query(accuracy_sql("fixed"))
def text_accuracy_buckets(spark, sf):
    return accuracy(spark, sf, "fixed")


@query("SELECT c_custkey AS table_id, count(DISTINCT o_orderdate) AS n_rows FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'O' GROUP BY c_custkey")
def row_count_check(spark, sf):
    tables = L.table(spark, sf, "customer").select(F.col("c_custkey").alias("table_id"))
    cells = L.table(spark, sf, "orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("table_id"), F.col("o_orderdate").alias("r"))
    return score.row_counts(tables, cells, ["table_id"])


def _header_rows() -> list[tuple]:
    """The header's cells by column: (kind, r, c, rs, cs, text, upright)."""
    rows = []
    for kind in specs.KINDS:
        high = specs.HEADER_ROWS[kind]
        upright = [u for _, what, *rest in specs.COLUMNS[kind] for u in ([x[2] for x in what] if isinstance(what, list) else rest)]
        for at, (label, group, _) in enumerate(specs.leaves(kind)):
            if group:
                rows.append((kind, 1, at, 1, 1, label, upright[at]))
            elif (kind, at) == ("podschet", 0):
                rows += [(kind, 0, 0, 1, 1, specs.TITLES[kind], False), (kind, 1, 0, 1, 1, label, False)]
            else:
                rows.append((kind, 0, at, 1 if (kind, at) == ("podschet", 4) else high, 1, label, upright[at] and (kind, at) != ("podschet", 4)))
        for group in dict.fromkeys(g for _, g, _ in specs.leaves(kind) if g):
            under = [i for i, (_, g, _) in enumerate(specs.leaves(kind)) if g == group]
            rows.append((kind, 0, under[0], 1, len(under), group, False))
        rows += [(kind, high, i, 1, 1, str(n), False) for i, n in enumerate(specs.GRAPH_NUMBERS.get(kind, ()))]
    return rows


HEADER_NAMES = "h(kind, r, c, rs, cs, text, upright)"
HEADERS = "(SELECT kind, chr(CAST(65 + c AS INTEGER)) || (r + 1) || ':' || chr(CAST(65 + c + cs - 1 AS INTEGER)) || (r + rs) AS item FROM headers WHERE rs > 1 OR cs > 1)"


@query(f"""WITH headers AS (SELECT * FROM {D.values(_header_rows(), HEADER_NAMES)}), t AS (SELECT n_nationkey AS n, kind, item FROM nation, {HEADERS} WHERE NOT (n_nationkey % 3 = 1 AND item = 'B1:C1') UNION ALL SELECT n_nationkey, 'kontrol', NULL FROM nation),
g AS (SELECT n_nationkey AS n, kind, item FROM nation, {HEADERS} WHERE n_nationkey % 4 <> 2 UNION ALL SELECT n_nationkey, 'kontrol', 'A1:A2' FROM nation WHERE n_nationkey % 5 = 0), w AS (SELECT DISTINCT n, kind FROM t)
SELECT CAST(w.n AS VARCHAR) AS borehole, w.kind, coalesce(list_sort((SELECT list(DISTINCT item) FROM t WHERE t.n = w.n AND t.kind = w.kind AND item IS NOT NULL)), []) = coalesce(list_sort((SELECT list(DISTINCT item) FROM g WHERE g.n = w.n AND g.kind = w.kind)), []) AS same FROM w""")
def merges_match(spark, sf):
    header = sheets.header_cells(spark)
    ranges = sheets.merges(header.withColumn("sheet", F.lit("")).where("rs > 1 or cs > 1")).drop("sheet")
    n = L.table(spark, sf, "nation").select(F.col("n_nationkey").alias("n"), F.col("n_nationkey").cast("string").alias("borehole"))
    each = n.join(F.broadcast(ranges))
    truth = each.where("not (n % 3 = 1 and item = 'B1:C1')").select("borehole", "kind", "item").unionAll(n.select("borehole", F.lit("kontrol"), F.lit(None)))
    got = each.where("n % 4 <> 2").select("borehole", "kind", "item").unionAll(n.where("n % 5 = 0").select("borehole", F.lit("kontrol"), F.lit("A1:A2")))
    return score.merges_match(truth, got)


NUMBERS_GOT = [(k, list(v)) for k, v in specs.GRAPH_NUMBERS.items()] + [("sampling_right", list(range(9, 18))), ("kontrol", []), ("kontrol", [1]), ("гр1-8", [1])]


@query("WITH own AS (SELECT * FROM (VALUES " + ", ".join(f"({D.q(k)}, {list(specs.GRAPH_NUMBERS.get(k, ()))}::INTEGER[])" for k in specs.KINDS) + ") AS v(kind, own)), made AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {D.q(k)}, {n}::INTEGER[])" for i, (k, n) in enumerate(NUMBERS_GOT)) + f") AS v(i, kind, numbers)), got AS (SELECT c_custkey AS i, kind, CASE WHEN c_custkey % 11 = 0 THEN list_append(numbers, 1) ELSE numbers END AS numbers FROM customer JOIN made ON made.i = c_custkey % {len(NUMBERS_GOT)}) SELECT i, kind, coalesce(own = numbers, false) AS same FROM got LEFT JOIN own USING (kind)")
def graph_numbers_match(spark, sf):
    """Column numbers of a truth row for each customer, every eleventh with a number too many."""
    made = spark.createDataFrame([(i, *x) for i, x in enumerate(NUMBERS_GOT)], "turn long, kind string, numbers array<int>")
    c = L.table(spark, sf, "customer").select(F.col("c_custkey").alias("i"), (F.col("c_custkey") % len(NUMBERS_GOT)).alias("turn"))
    got = c.join(F.broadcast(made), "turn").withColumn("numbers", F.when(F.col("i") % 11 == 0, F.array_append("numbers", 1)).otherwise(F.col("numbers")))
    return score.numbers_match(got).select("i", "kind", "same")


KIND_KEYS = [(k, i, len(specs.leaves(k)), w) for i, k in enumerate(specs.KINDS) for w in specs.KEYWORDS[k]]


@query(f"""WITH {L.LINES}, k AS (SELECT * FROM {D.values(KIND_KEYS, 'k(kind, pos, ncols, kw)')}), s AS (
  SELECT doc_id, r, kind, any_value(pos) AS pos, count(*) FILTER (contains(lower(line), kw)) AS hits FROM lines JOIN k ON ncols = abs(doc_id + r) % 8 + 3 GROUP BY doc_id, r, kind)
SELECT doc_id, r, arg_min(kind, {{'h': -hits, 'p': pos}}) AS kind, max(hits) AS hits FROM s GROUP BY doc_id, r""")
def kind_detect(spark, sf):
    at = L.lines(spark, sf).withColumn("ncols", (F.abs(F.col("doc_id") + F.col("r")) % 8 + 3).cast("int"))
    return layout.detect_kind(at, ["doc_id", "r"], "line", "ncols")


# Objects, identity, sheets

MAIN = f"""{L.BOXES}, fit AS (SELECT page_id, x, y, x + w AS x1, y + h AS y1, w * h AS a FROM boxes WHERE w * h >= 0.015 * height * width AND w >= 0.12 * width AND h >= 0.03 * height AND h >= 0.55 * height AND w >= 0.40 * width AND v_rules >= 4),
m AS (SELECT page_id, arg_min({{'x0': x, 'y0': y, 'x1': x1, 'y1': y1}}, {{'a': -a, 'y': y, 'x': x}}) AS main FROM fit GROUP BY page_id),
t AS (SELECT page_id, arg_min({{'x0': x, 'y0': y, 'x1': x + w, 'y1': y + h}}, {{'y': y, 'x': x, 'b': b}}) AS top FROM boxes WHERE w * h >= 0.015 * height * width AND w >= 0.12 * width AND h >= 0.03 * height AND y < 0.35 * height AND h < 0.45 * height GROUP BY page_id),
halves AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'L' ELSE 'R' END AS side, 1000 AS w, 1400 AS h, main, top FROM pages LEFT JOIN m USING (page_id) LEFT JOIN t USING (page_id))"""


def _made(where: str, rows: list[tuple]) -> str:
    return " UNION ALL ".join(f"SELECT page_id, side, {D.q(k)} AS kind, CAST(trunc({x0}) AS INTEGER) AS x0, CAST(trunc({y0}) AS INTEGER) AS y0, CAST(trunc({x1}) AS INTEGER) AS x1, CAST(trunc({y1}) AS INTEGER) AS y1, CAST({c} AS DOUBLE) AS conf FROM halves WHERE {where}" for k, x0, y0, x1, y1, c in rows)


def _shares(rows) -> list[tuple]:
    return [(k, f"w * CAST({a} AS DOUBLE)", f"h * CAST({b} AS DOUBLE)", f"w * CAST({c} AS DOUBLE)", f"h * CAST({d} AS DOUBLE)", p) for k, a, b, c, d, p in rows]


OBJECTS = "objects AS (" + " UNION ALL ".join([
    _made("main IS NOT NULL AND side = 'L'", [("journal_left", "main.x0", "main.y0", "main.x1", "main.y1", 0.9)]),
    _made("main IS NOT NULL AND side = 'R'", [("sampling_right", "w * CAST(0.058 AS DOUBLE)", "main.y0", "w * CAST(0.492 AS DOUBLE)", "main.y1", 0.85), *_shares(inventory.RIGHT_OF_MAIN)]),
    _made("main IS NULL AND side = 'L' AND top IS NOT NULL", [("samorodki", "top.x0", "top.y0", "top.x1", "top.y1", 0.75), ("form_act", "0", "top.y1", "w", "h", 0.55)]),
    _made("main IS NULL AND side = 'L' AND top IS NULL", _shares(inventory.LEFT_NONE)),
    _made("main IS NULL AND side = 'R'", _shares(inventory.RIGHT_NONE)),
]) + ")"


def located(spark: SparkSession, sf: str) -> DataFrame:
    boxes = inventory.regions(L.boxes(spark, sf))
    main = inventory.main_table(boxes, ["page_id"])
    small = boxes.where("y < 0.35 * height and h < 0.45 * height")
    box = F.struct(F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + F.col("w")).alias("x1"), (F.col("y") + F.col("h")).alias("y1"))
    top = small.groupBy("page_id").agg(F.min_by(box, F.struct("y", "x", "b")).alias("top"))
    k = F.col("page_id")
    halves = L.table(spark, sf, "pages").select("page_id", F.when(k % 2 == 0, F.lit("L")).otherwise(F.lit("R")).alias("side"), F.lit(1000).alias("width"), F.lit(1400).alias("height"))
    return inventory.locate(halves.join(main, "page_id", "left").join(top, "page_id", "left")).drop("width", "height")


@query(f"WITH {MAIN}, {OBJECTS} SELECT kind, count(*) AS n FROM objects GROUP BY kind")
def inventory_counts(spark, sf):
    return inventory.counts(located(spark, sf))


@query(f"WITH {MAIN}, {OBJECTS} SELECT * FROM objects")
def object_locator(spark, sf):
    return located(spark, sf)


@query(f"WITH {MAIN} SELECT page_id, main.x0 AS x0, main.y0 AS y0, main.x1 AS x1, main.y1 AS y1 FROM m")
def region_filter_pick_main(spark, sf):
    return inventory.main_table(inventory.regions(L.boxes(spark, sf)), ["page_id"]).select("page_id", "main.*")


HOLES = "spreads AS (SELECT page_id, page_id // 40 AS doc, page_id // 2 AS spread, dense_rank() OVER (PARTITION BY page_id // 40 ORDER BY page_id // 2) AS position FROM pages)"


@query(f"WITH {HOLES} SELECT page_id, doc, spread, CAST(position AS INTEGER) AS position, CAST(position AS BIGINT) AS hole FROM spreads")
def borehole_identity(spark, sf):
    p = L.table(spark, sf, "pages").select("page_id", F.floor(F.col("page_id") / 40).cast("long").alias("doc"))
    return identity.spreads(p, ["doc"], "page_id").select("page_id", "doc", "spread", "position", "hole")


@query("""WITH f AS (SELECT event_id, i AS ord, CASE i WHEN 0 THEN 'Отряд' WHEN 1 THEN '4. Скважина №' ELSE 'Скважина №' END AS key,
  CASE WHEN i = 0 THEN '99' WHEN event_id % 3 = 0 THEN 'n/a' WHEN i = 1 AND event_id % 3 = 1 THEN NULL ELSE json_extract_string(props, '$.k') || ' #' || CAST(event_id % 50 AS VARCHAR) || ' 7' END AS value FROM events, range(3) AS t(i)),
n AS (SELECT event_id, ord, regexp_extract(coalesce(value, ''), '\\p{Nd}+', 0) AS d FROM f WHERE contains(lower(key), 'скважина'))
SELECT event_id, coalesce(arg_min(d, ord) FILTER (d <> ''), '1') AS hint, coalesce(arg_min(d, ord) FILTER (d <> ''), '1') <> CAST(event_id % 50 AS VARCHAR) AS mismatch FROM n GROUP BY event_id""")
def borehole_hint_mismatch(spark, sf):
    e = L.table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("ord"))
    i, n = F.col("ord"), F.col("event_id")
    key = F.when(i == 0, F.lit("Отряд")).when(i == 1, F.lit("4. Скважина №")).otherwise(F.lit("Скважина №"))
    value = F.when(i == 0, F.lit("99")).when(n % 3 == 0, F.lit("n/a")).when((i == 1) & (n % 3 == 1), F.lit(None)).otherwise(F.concat("k", F.lit(" #"), (n % 50).cast("string"), F.lit(" 7")))
    found = identity.hole_hint(e.select("event_id", "ord", key.alias("key"), value.alias("value")), ["event_id"])
    return found.withColumn("mismatch", F.col("hint") != (F.col("event_id") % 50).cast("string"))


SHEET = "CASE kind " + " ".join(f"WHEN {D.q(k)} THEN {D.q(v)}" for k, v in specs.SHEET_NAMES.items()) + " ELSE kind END"


@query(f"""WITH {MAIN}, {OBJECTS}, s AS (SELECT page_id, kind, substring(regexp_replace('скв' || CAST(page_id // 2 % 30 AS VARCHAR) || '_' || {SHEET}, '[\\[\\]:*?/\\\\]', '_', 'g'), 1, 31) AS name FROM objects)
SELECT page_id, kind, name, count(*) OVER (PARTITION BY name) > 1 AS clash FROM s""")
def sheet_name_unique(spark, sf):
    hole = (F.floor(F.col("page_id") / 2) % 30).cast("long")
    named = located(spark, sf).select("page_id", "kind", identity.safe_name(identity.sheet_name(F.col("kind"), hole)).alias("name"))
    bad = identity.clashes(named, "name").select("name", F.lit(True).alias("clash"))
    return named.join(bad, "name", "left").select("page_id", "kind", "name", F.coalesce("clash", F.lit(False)).alias("clash"))


@query(f"""WITH r AS ({reconciled('journal_left', 'hybrid')}) SELECT 'скв' || CAST(table_id AS VARCHAR) || '_гр1-8' AS sheet, 'journal_left' AS obj_type, r, c, 1 AS rs, 1 AS cs, '[' || CAST(c * 10 AS VARCHAR) || ',' || CAST(r * 10 AS VARCHAR) || ']' AS bbox,
source AS text_source, reader_text, conf, needs_review, text FROM r UNION ALL
SELECT 'скв' || CAST(c_custkey AS VARCHAR) || '_титул', 'form_journal', NULL, NULL, NULL, NULL, NULL, 'layout', NULL, NULL, c_custkey % 2 = 0, c_name FROM customer""")
def meta_rows(spark, sf):
    cells = reconcile.cells(L.engines(spark, sf), "journal_left")
    name = lambda kind, n: identity.sheet_name(F.lit(kind), F.col(n))
    table = cells.select(
        name("journal_left", "table_id").alias("sheet"), F.lit("journal_left").alias("obj_type"), "r", "c", F.lit(1).alias("rs"), F.lit(1).alias("cs"),
        F.to_json(F.array((F.col("c") * 10), (F.col("r") * 10))).alias("bbox"), F.col("source").alias("text_source"), "reader_text", "conf", "needs_review", "text",
    )
    form = L.table(spark, sf, "customer").select(name("form_journal", "c_custkey").alias("sheet"), F.lit("form_journal").alias("obj_type"), F.lit("layout").alias("text_source"), (F.col("c_custkey") % 2 == 0).alias("needs_review"), F.col("c_name").alias("text"))
    return table.unionByName(form, allowMissingColumns=True)


# Cache, replies, forms, annotations


@query("""WITH k AS (SELECT doc_id, lang, sha256(coalesce(text, '') || '|m1|' || coalesce(lang, '')) AS key FROM documents), c AS (SELECT DISTINCT key FROM k WHERE doc_id % 3 = 0)
SELECT 'hit' AS kind, doc_id, key FROM k WHERE key IN (FROM c) UNION ALL SELECT 'miss', min(doc_id), key FROM k WHERE key NOT IN (FROM c) GROUP BY key""")
def cache_key_split(spark, sf):
    d = L.table(spark, sf, "documents")
    k = d.select("doc_id", X.cache_key(F.coalesce("text", F.lit("")), F.lit("|m1|"), F.coalesce("lang", F.lit(""))).alias("key"))
    known = k.where("doc_id % 3 = 0").select("key").distinct()
    missed = cache.misses(k, known).select("key")
    first = k.groupBy("key").agg(F.min("doc_id").alias("doc_id"))
    miss = missed.join(first, "key").select(F.lit("miss").alias("kind"), "doc_id", "key")
    return cache.hits(k, known).select(F.lit("hit").alias("kind"), "doc_id", "key").unionByName(miss)


def _reply(t: str | None) -> str | None:
    import re

    t = re.sub(r"```$", "", re.sub(r"^```(?:json)?", "", (t or "").strip()).strip()).strip()
    for s in (t, *re.findall(r"(?s)\{.*\}", t)):
        try:
            json.loads(s)
            return s
        except ValueError:
            continue
    return None


REPLY_ROWS = [(i, r, _reply(r)) for i, r in enumerate(L.REPLIES)]


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, NULL AS body FROM events UNION ALL SELECT * FROM " + D.values([(-1 - i, None, out) for i, _, out in REPLY_ROWS], "v(event_id, k, body)"))
def json_reply_parse(spark, sf):
    e = L.table(spark, sf, "events")
    fence = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).otherwise(F.concat(F.lit("Reply: "), "props"))
    real = e.select("event_id", F.get_json_object(X.reply_json(fence), "$.k").alias("k"), F.lit(None).cast("string").alias("body"))
    made = spark.createDataFrame([(-1 - i, r) for i, r, _ in REPLY_ROWS], "event_id long, reply string")
    return real.unionAll(made.select("event_id", F.lit(None).cast("string"), X.reply_json(F.col("reply"))))


@query(f"WITH {L.LINES} SELECT doc_id, r, array_to_string(list_resize(string_split(line, ' ')[1:8], 8, ''), '|') AS cells FROM lines")
def row_pad_truncate(spark, sf):
    return L.lines(spark, sf).select("doc_id", "r", F.array_join(forms.pad_row(F.split("line", " "), 8), "|").alias("cells"))


FIELD_ROWS = [(form, i, key) for form, keys in specs.FORM_FIELDS.items() for i, key in enumerate(keys)]


@query(f"""WITH f AS (SELECT * FROM {D.values(FIELD_ROWS, 'f(form, ord, key)')}), e AS (SELECT event_id, json_extract_string(props, '$.k') AS k, CASE WHEN event_id % 4 = 0 THEN 'form_act' ELSE 'form_journal' END AS form FROM events)
SELECT event_id, form, CAST(ord AS INTEGER) AS ord, key, CASE WHEN key = 'Скважина №' OR key = '4. Скважина №' THEN 'k' || k WHEN key = 'Отряд' THEN 'x y' ELSE '' END AS value, key = 'Отряд' AND event_id % 5 = 0 AS needs_review FROM e JOIN f USING (form)""")
def kv_field_fill(spark, sf):
    e = L.table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))
    mark = F.concat(F.lit("k"), F.col("k"))
    values = F.create_map(F.lit("Скважина №"), mark, F.lit("4. Скважина №"), mark, F.lit("Отряд"), F.lit(" x y "), F.lit("extra"), F.lit("z"))
    low = F.when(F.col("event_id") % 5 == 0, F.array(F.lit("Отряд")))
    replies = e.select("event_id", F.when(F.col("event_id") % 4 == 0, F.lit("form_act")).otherwise(F.lit("form_journal")).alias("form"), values.alias("values"), low.alias("low_conf"))
    return forms.fill(replies, forms.spec_fields(spark), ["event_id"])


@query("""WITH w AS (SELECT event_id, i, CASE WHEN i = 2 THEN '' ELSE event_type END AS text, event_id % 100 AS x, (event_id * 7 + i * 13) % 90 AS y FROM events, range(3) AS t(i))
SELECT event_id, CAST(i AS INTEGER) AS word, text, CAST(CASE WHEN event_id % 6 = 0 THEN 0 ELSE x END AS INTEGER) AS x0, CAST(y AS INTEGER) AS y0, CAST(x + 20 AS INTEGER) AS x1, CAST(y + 8 AS INTEGER) AS y1,
CASE WHEN event_id % 3 = 0 THEN 0.5 WHEN event_id % 3 = 1 THEN NULL ELSE 0.25 END AS conf FROM w WHERE text <> '' AND NOT (i = 1 AND event_id % 4 = 0)""")
def annotation_normalize(spark, sf):
    e = L.table(spark, sf, "events").select("event_id", "event_type")
    n = F.col("event_id")
    conf = F.when(n % 3 == 0, F.lit(', "confidence": 0.5, "conf": 0.9')).when(n % 3 == 1, F.lit(', "confidence": "high", "score": 0.7')).otherwise(F.lit(', "score": "0.25"'))

    def word(i):
        x, y = (n % 100).cast("string"), ((n * 7 + i * 13) % 90).cast("string")
        x0 = F.when(n % 6 == 0, F.lit("{")).otherwise(F.concat(F.lit('{"x": "'), x, F.lit('", ')))
        x1, y1 = (n % 100 + 20).cast("string"), ((n * 7 + i * 13) % 90 + 8).cast("string")
        vertices = F.concat(F.lit('{"vertices": ['), x0, F.lit('"y": "'), y, F.lit('"}, {"x": '), x1, F.lit(', "y": '), y1, F.lit("}]}"))
        vertices = F.when(F.lit(i == 1) & (n % 4 == 0), F.lit('{"vertices": []}')).otherwise(vertices)
        return F.concat(F.lit('{"text": "'), F.lit("") if i == 2 else F.col("event_type"), F.lit('"'), conf, F.lit(', "boundingBox": '), vertices, F.lit("}"))

    body = F.concat(F.lit('{"blocks": [{"lines": [{"text": "", "words": ['), F.concat_ws(", ", word(0), word(1), word(2)), F.lit("]}]}]}"))
    parsed = e.select("event_id", F.from_json(body, annotation.SCHEMA).alias("a"))
    return annotation.words(parsed, "a").select("event_id", "word", "text", "box.*", "conf")


# Dense grids and sheets


@query(f"""WITH {L.ENGINES}, s AS (SELECT table_id, r, c, max(q) AS text FROM engines GROUP BY table_id, r, c), d AS (SELECT table_id, max(r) AS nr, max(c) AS nc FROM s GROUP BY table_id)
SELECT d.table_id, g.r, h.c, coalesce(s.text, '') AS text FROM d, range(1000) AS g(r), range(4) AS h(c) LEFT JOIN s ON s.table_id = d.table_id AND s.r = g.r AND s.c = h.c WHERE g.r <= nr AND h.c <= nc""".replace("FROM d, range(1000) AS g(r), range(4) AS h(c) LEFT JOIN s ON", "FROM d JOIN range(1000) AS g(r) ON g.r <= nr JOIN range(4) AS h(c) ON h.c <= nc LEFT JOIN s ON").replace(" WHERE g.r <= nr AND h.c <= nc", ""))
def dense_grid_sparse_cells(spark, sf):
    found = layout.dense_grid(L.engines(spark, sf).select("table_id", "r", "c", F.col("q").alias("text")), "table_id")
    return found.withColumns({"r": F.col("r").cast("long"), "c": F.col("c").cast("long")})


LABEL_ROWS = [(k, r, label, (specs.UNITS.get(k) or ("",) * 9)[r]) for k, labels in specs.ROW_LABELS.items() for r, label in enumerate(labels)]


@query(f"""WITH {L.ENGINES}, l AS (SELECT * FROM {D.values(LABEL_ROWS, 'l(kind, r, label, unit)')} WHERE kind = 'podschet'), t AS (SELECT DISTINCT table_id FROM engines), x AS (SELECT table_id, r, c, max(q) AS q FROM engines GROUP BY table_id, r, c)
SELECT t.table_id, CAST(l.r AS INTEGER) AS r, CAST(c.c AS INTEGER) AS c, CASE c.c WHEN 0 THEN label WHEN 1 THEN unit ELSE CASE WHEN c.c IN (2, 3) THEN coalesce(x.q, '') ELSE '' END END AS text
FROM t CROSS JOIN l CROSS JOIN range(5) AS c(c) LEFT JOIN x ON x.table_id = t.table_id AND x.r = l.r AND x.c = c.c""")
def labelled_sheet_cells(spark, sf):
    e = L.engines(spark, sf).groupBy(F.col("table_id").alias("sheet"), "r", "c").agg(F.max("q").alias("text"), F.lit(None).cast("double").alias("conf"))
    found = sheets.labelled(e.select("sheet", F.lit("podschet").alias("kind")).distinct(), e)
    return found.select(F.col("sheet").alias("table_id"), "r", "c", "text")


@query(f"WITH r AS ({reconciled('journal_left', 'hybrid')}) SELECT table_id, r, c, CASE WHEN conf < 0.55 THEN 'orange' WHEN text = '-ll-' THEN 'yellow' ELSE 'none' END AS fill FROM r")
def low_conf_fill_class(spark, sf):
    at = reconcile.cells(L.engines(spark, sf), "journal_left")
    fill = F.coalesce(sheets.fill_of(F.col("conf"), F.col("text")), F.lit("none"))
    return at.select("table_id", "r", "c", fill.alias("fill"))


@query("""WITH RECURSIVE l AS (SELECT doc_id // 20 AS p, doc_id AS line, CAST(doc_id * 7919 % 300 AS INTEGER) AS y0, CAST(doc_id * 104729 % 500 AS INTEGER) AS x0 FROM documents),
n AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY y0, x0, line) AS i FROM l),
b AS (SELECT p, i, line, x0, y0 AS anchor, 0 AS band FROM n WHERE i = 1 UNION ALL
  SELECT n.p, n.i, n.line, n.x0, CASE WHEN abs(n.y0 - anchor) > 14 THEN n.y0 ELSE anchor END, band + CASE WHEN abs(n.y0 - anchor) > 14 THEN 1 ELSE 0 END FROM b JOIN n ON n.p = b.p AND n.i = b.i + 1)
SELECT p AS page_id, line AS line_id, band, CAST(row_number() OVER (PARTITION BY p ORDER BY band, x0, line) - 1 AS INTEGER) AS place FROM b""")
def reading_order_lines(spark, sf):
    k = F.col("doc_id")
    at = L.table(spark, sf, "documents").select(F.floor(k / 20).cast("long").alias("page_id"), k.alias("line_id"), (k * 7919 % 300).cast("int").alias("y0"), (k * 104729 % 500).cast("int").alias("x0"))
    return cluster.lines_by_first(at, ["page_id"], 14).select("page_id", "line_id", "band", "place")


# Kernels on tiles

SUMS = "list_transform(range(8), lambda x: list_aggregate(list_transform(range(8), lambda y: CAST(tile[y * 8 + x + 1] AS DOUBLE)), 'sum') / 8)"


@query(f"WITH {L.TILES}, m AS (SELECT vec_id, ({SUMS})[4:4] AS part FROM tiles) SELECT vec_id, CAST(3 + list_position(part, list_max(part)) - 1 AS INTEGER) AS seam FROM m")
def spread_split_seam(spark, sf):
    return L.tiles(spark, sf).select("vec_id", kernels.seam(F.col("tile"), 8, 8).alias("seam"))


@query(f"WITH {L.TILES} SELECT vec_id, len(list_filter(tile, lambda v: v < 128 - 10)) / 64 AS dark, len(list_filter(list_transform(range(36), lambda i: tile[(1 + i // 6) * 8 + 1 + i % 6 + 1]), lambda v: v < 118)) / 36 AS inner_dark, 0.0::DOUBLE AS small FROM tiles")
def dark_ratio(spark, sf):
    t, limit = F.col("tile"), F.lit(128)
    share = lambda box: kernels.dark_share(t, 8, 8, limit, box)
    return L.tiles(spark, sf).select("vec_id", share((0, 0, 8, 8)).alias("dark"), share((1, 1, 7, 7)).alias("inner_dark"), share((0, 0, 5, 8)).alias("small"))


@query(f"""WITH {L.TILES}, r AS (SELECT vec_id, list_transform(range(8), lambda y: CAST(list_aggregate(tile[y * 8 + 1 : y * 8 + 8], 'sum') AS DOUBLE)) AS s FROM tiles)
SELECT vec_id, list_aggregate(list_transform(range(1, 8), lambda i: (s[i + 1] - s[i]) * (s[i + 1] - s[i])), 'sum') AS sharpness FROM r""")
def profile_sharpness(spark, sf):
    return L.tiles(spark, sf).select("vec_id", kernels.sharpness(F.col("tile"), 8, 8).alias("sharpness"))


@query(f"WITH {CLUSTERS} SELECT table_id, min(y) AS first, max(y) AS last, count(*) AS n FROM grouped GROUP BY table_id, grp")
def stream_row_sessions(spark, sf):
    return sessions.by_gap(L.words(spark, sf))


# Sheets, bands and replies


@query(f"SELECT s_suppkey AS sheet, h.* FROM supplier JOIN (SELECT * FROM {D.values(_header_rows(), HEADER_NAMES)}) AS h ON h.kind = {kind_sql('s_suppkey')}")
def sheet_header_merges(spark, sf):
    """The header of a sheet for each supplier, of any kind."""
    own = L.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("sheet"), kind_of("s_suppkey"))
    return own.join(F.broadcast(sheets.header_cells(spark)), "kind")


@query(f"""WITH {L.ENGINES}, d AS (SELECT 's' || CAST(table_id AS VARCHAR) AS sheet, r, c, max(q) AS text, min(y_conf) AS conf FROM engines GROUP BY table_id, r, c),
up AS (SELECT DISTINCT sheet FROM d WHERE r = 0 AND c = 0 AND {D.strict('text')} <> '' AND NOT regexp_matches({D.strict('text')}, '^[{D.DIGIT}]+$'))
SELECT sheet, r - CASE WHEN up.sheet IS NULL THEN 0 ELSE 1 END + 3 AS r, c, text, CASE WHEN conf < 0.55 THEN 'orange' WHEN {D.ditto('text')} THEN 'yellow' END AS fill FROM d LEFT JOIN up USING (sheet) WHERE NOT (up.sheet IS NOT NULL AND r = 0)
UNION ALL SELECT t.sheet, h.r, h.c, h.text, NULL FROM (SELECT DISTINCT sheet FROM d) AS t CROSS JOIN (SELECT * FROM {D.values(_header_rows(), HEADER_NAMES)} WHERE kind = 'journal_left') AS h""")
def sheet_cells_freeform(spark, sf):
    e = L.engines(spark, sf).groupBy("table_id", "r", "c").agg(F.max("q").alias("text"), F.min("y_conf").alias("conf"))
    cells = e.select(F.concat(F.lit("s"), F.col("table_id").cast("string")).alias("sheet"), F.lit("journal_left").alias("kind"), "r", "c", "text", "conf")
    return sheets.sheet_cells(cells, sheets.header_cells(spark)).select("sheet", "r", "c", "text", "fill")


@query(f"""WITH {CLUSTERS}, p AS (SELECT *, lead(cy) OVER (PARTITION BY table_id ORDER BY ri) - cy AS gap FROM centres), m AS (SELECT table_id, median(gap) AS m FROM p GROUP BY table_id)
SELECT table_id, ri FROM p JOIN m USING (table_id) WHERE gap >= 0.55::DOUBLE * m AND gap <= 1.7::DOUBLE * m""")
def uniform_row_bands(spark, sf):
    return cluster.uniform_bands(cluster.centres(grouped(spark, sf), ["table_id"], "y"), ["table_id"]).select("table_id", "ri")


@query(f"WITH {L.LINES}, n AS (SELECT doc_id, r, substring({D.norm('line')}, 1, 6) AS x, substring({D.norm('lag(line) OVER (PARTITION BY doc_id ORDER BY r)')}, 1, 6) AS y FROM lines) SELECT doc_id, r, x <> '' AND x = y AS similar FROM n")
def similar_prefix(spark, sf):
    before = F.lag("line").over(Window.partitionBy("doc_id").orderBy("r"))
    return L.lines(spark, sf).withColumn("before", before).select("doc_id", "r", X.similar(F.col("line"), F.col("before")).alias("similar"))


@query(f"WITH {L.LINES} SELECT doc_id, r, ({D.strict('line')} <> '' AND NOT regexp_matches({D.strict('line')}, '^[{D.DIGIT}]+$')) AS header FROM lines")
def header_like_row(spark, sf):
    return L.lines(spark, sf).select("doc_id", "r", X.like_header(F.col("line")).alias("header"))


@query("""WITH k AS (SELECT event_id, json_extract_string(props, '$.k') AS k FROM events)
SELECT event_id AS table_id, CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c, CASE WHEN r = 0 AND c = 0 THEN k WHEN r = 0 AND c = 2 THEN 'x' WHEN r = 1 AND c < 3 THEN 'v' || CAST(c AS VARCHAR) ELSE '' END AS q, r = 1 AND c = 2 AND event_id % 2 = 0 AS low
FROM k, range(2) AS t(r), range(3) AS u(c)""")
def layout_reply_cells(spark, sf):
    e = L.table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))
    low = F.when(F.col("event_id") % 2 == 0, F.lit("[[1, 2], [9, 9]]")).otherwise(F.lit("[]"))
    reply = F.concat(F.lit('```json\n{"rows": [["'), F.col("k"), F.lit('", null, "x"], ["v0", "v1", "v2", "cut"]], "low_conf": '), low, F.lit("}\n```"))
    return process.reply_cells(e.select(F.col("event_id").alias("table_id"), reply.alias("reply")), "kontrol")


@query("""WITH b AS (SELECT event_id, event_id % 50 AS x0, event_id % 70 AS y0, event_id % 50 + event_id % 9 - 3 AS x1, event_id % 70 + event_id % 11 - 2 AS y1 FROM events)
SELECT event_id, x1 - x0 AS w, y1 - y0 AS h, greatest(0, x1 - x0) * greatest(0, y1 - y0) AS area FROM b""")
def box_area(spark, sf):
    n = F.col("event_id")
    w, h = n % 9 - 3, n % 11 - 2
    box = F.struct((n % 50).alias("x0"), (n % 70).alias("y0"), (n % 50 + w).alias("x1"), (n % 70 + h).alias("y1"))
    return L.table(spark, sf, "events").select("event_id", annotation.measures(box).alias("m")).select("event_id", "m.*")


@query(f"""WITH l AS (SELECT kind, ci, coalesce(group_label || ' — ', '') || label AS label, count(*) OVER (PARTITION BY kind) AS ncols, CAST(sum(width) OVER (PARTITION BY kind) AS BIGINT) AS width FROM {SPEC_COLUMNS})
SELECT c_custkey AS table_id, l.* FROM customer JOIN l ON kind = {kind_sql('c_custkey')}""")
def leaf_labels(spark, sf):
    """The labels of a table's columns, a table for each customer."""
    own = L.table(spark, sf, "customer").select(F.col("c_custkey").alias("table_id"), kind_of("c_custkey"))
    return own.join(F.broadcast(layout.leaf_labels(layout.spec_columns(spark))), "kind")


@query(f"""WITH l AS (SELECT event_id // 6 AS table_id, event_id // 3 % 2 AS r, 0 AS c, event_id % 3 AS line, event_type AS text, CASE WHEN event_id % 4 = 0 THEN NULL ELSE (event_id % 100) / 100 END AS conf FROM events)
SELECT table_id, CAST(r AS INTEGER) AS r, c, {D.strip("string_agg(text, ' ' ORDER BY line)")} AS text, round(avg(conf), 9) AS conf FROM l GROUP BY table_id, r, c""")
def mean_confidence(spark, sf):
    n = F.col("event_id")
    lines = L.table(spark, sf, "events").select(F.floor(n / 6).alias("table_id"), (F.floor(n / 3) % 2).cast("int").alias("r"), F.lit(0).alias("c"), (n % 3).alias("line"), F.col("event_type").alias("text"), F.when(n % 4 != 0, (n % 100) / 100).alias("conf"))
    return tables.read_cells(lines).withColumn("conf", F.round("conf", 9))


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
