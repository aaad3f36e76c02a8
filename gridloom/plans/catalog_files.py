"""Queries over whole files, and their SQL; importing this adds them to the catalog's.

Lens: every eight rows of `pages` are a file of four boreholes, with the objects that front and main pages have;
`events` are the words on them, and what the layout engine replied is made by place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import tables
from gridloom.plans import boreholes, specs
from gridloom.plans import duck as D
from gridloom.plans import lenses as L
from gridloom.plans.catalog import SPEC_COLUMNS, query

HEIGHT = 600
# kind, side, odd page, place among the page's tables (-1: a form)
OBJECTS = [
    ("samorodki", "L", 0, 0), ("podschet", "R", 0, 1), ("form_act", "L", 0, -1), ("form_journal", "R", 0, -1),
    ("journal_left", "L", 1, 0), ("sampling_right", "R", 1, 1), ("pokazateli", "R", 1, 2), ("kontrol", "R", 1, 3), ("unknown", "R", 1, -2),
]


def lens(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    p = L.table(spark, sf, "pages").select("page_id", F.floor(F.col("page_id") / 8).cast("long").alias("doc_id"), (F.col("page_id") % 8).cast("int").alias("page"), (800 + 100 * (F.col("page_id") % 3)).cast("int").alias("width"))
    of = spark.createDataFrame(OBJECTS, "kind string, side string, odd int, pos int")
    objects = p.join(F.broadcast(of), F.col("odd") == F.col("page") % 2).select("page_id", "doc_id", "page", "kind", "side", "pos", F.lit(50).alias("x0"), F.lit(60).alias("y0"), (F.col("width") + 50).alias("x1"), F.lit(60 + HEIGHT).alias("y1"), F.lit(9).alias("ruled_rows"))
    found = boreholes.routed(objects)
    e = F.col("event_id")
    n = F.broadcast(L.table(spark, sf, "pages").agg(F.count(F.lit(1)).alias("n")))
    at = L.table(spark, sf, "events").join(n).select("event_id", "event_type", (e * 7 % F.col("n")).alias("page_id"), F.floor(e / F.col("n")).alias("turn"))
    on = [at["page_id"] == found["page_id"], F.col("pos") == at["turn"] % F.when(F.col("page") % 2 == 0, 2).otherwise(4)]
    width = F.col("x1") - 50
    text = (
        F.when(e % 9 == 0, (e % 40).cast("string")).when(e % 9 == 1, F.lit("глина")).when(e % 9 == 2, F.lit("-ll-")).when(e % 9 == 3, F.lit("12,5")).when(e % 9 == 4, F.lit("H3"))
        .when(e % 9 == 5, F.col("event_type")).when(e % 9 == 6, F.lit("3.4")).when(e % 63 == 7, F.lit("Описание")).when(e % 45 == 8, F.lit("геолог")).otherwise(F.lit("x"))
    )
    x = (e * 37 % width).cast("int")
    y = (e * 53 % 12 * 45 + e % 5).cast("int")
    words = at.join(found, on).select("table_id", e.alias("word_id"), x.alias("x0"), y.alias("y0"), (x + 10).alias("x1"), (y + 8).alias("y1"), text.alias("text"), (e % 100 / 100).alias("conf"))
    r, c = F.col("r"), F.col("c")
    k = (F.col("page_id") + 3 * r + 5 * c) % 6
    q = F.when(k == 0, F.lit("-ll-")).when(k == 1, F.lit("")).when(k == 2, F.lit("глина")).when(k == 3, F.lit("12,5")).when(k == 4, F.lit("x")).otherwise(r.cast("string"))
    columns = tables.by_kind(F.col("kind"), {k: len(specs.leaves(k)) for k in specs.KINDS})
    places = found.where("route = 'table'").withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(6)))).withColumn("c", F.explode(F.sequence(F.lit(0), columns - 1)))
    number = (F.floor(F.col("page_id") / 2) % 5).cast("string")
    name = F.when(F.col("kind") == "form_act", F.lit("Скважина №")).otherwise(F.lit("4. Скважина №"))
    value = F.when((F.col("kind") == "form_journal") | (F.col("page_id") % 3 > 0), F.concat(F.lit("№ "), number, F.lit(" бис"))).otherwise(F.lit("нет"))
    replies = found.where("route = 'form' and page_id % 5 > 0").select("table_id", F.create_map(name, value, F.lit("Дата"), F.lit("1.2")).alias("values"), F.when(F.col("page_id") % 2 == 0, F.array(F.lit("Дата"), F.lit("Отряд"))).alias("low_conf"))
    return {"pages": p.select("doc_id", "page"), "objects": objects.drop("page_id", "pos"), "words": words, "grid": places.select("table_id", "r", "c", q.alias("q")), "replies": replies}


FIELDS = D.values([(form, i, key) for form, keys in specs.FORM_FIELDS.items() for i, key in enumerate(keys)], "f(form, ord, key)")
FIXED = D.values([(k, specs.HEADER_ROWS[k], len(v)) for k, v in specs.ROW_LABELS.items()], "f(kind, h, n)")
FILLED = D.values([(k, c) for k in specs.KINDS for c in (specs.FILL_COLUMNS.get(k) or range(len(specs.leaves(k))))], "f(kind, c)")
SHEET = "CASE kind " + " ".join(f"WHEN {D.q(k)} THEN {D.q(v)}" for k, v in specs.SHEET_NAMES.items()) + " ELSE kind END"
SAMPLING = "kind = 'sampling_right'"
FULL, AGREE = f"{D.strict('q')} <> ''", D.agree("q", "y")
RULES = [
    (D.ditto("q"), "'-ll-'", "layout", "NULL", False),
    (f"NOT {SAMPLING} AND {FULL} AND y <> '' AND {AGREE}", "q", "hybrid", "0.95", False), (f"NOT {SAMPLING} AND {FULL} AND y <> ''", "q", "layout", "0.45", True), (f"NOT {SAMPLING} AND {FULL}", "q", "layout", "0.5", False),
    (f"y <> '' AND {FULL} AND {AGREE}", "y", "hybrid", "y_conf", False), (f"y <> '' AND {FULL}", "y", "reader", "y_conf", True), ("y <> ''", "y", "reader", "y_conf", False), (FULL, "q", "layout", "0.5", True),
]


def pick(i: int, show=str) -> str:
    return "CASE " + " ".join(f"WHEN {r[0]} THEN {show(r[i])}" for r in RULES) + " END"


FILES = f"""p AS (SELECT page_id, page_id // 8 AS doc_id, CAST(page_id % 8 AS INTEGER) AS page, CAST(800 + 100 * (page_id % 3) AS INTEGER) AS width FROM pages),
o AS (SELECT p.*, kind, side, pos, doc_id || '/' || page || '/' || side || '/' || kind AS table_id FROM p JOIN {D.values(OBJECTS, 'k(kind, side, odd, pos)')} ON odd = page % 2 WHERE kind <> 'unknown'),
holes AS (SELECT DISTINCT doc_id, page // 2 AS spread, dense_rank() OVER (PARTITION BY doc_id ORDER BY page // 2) AS hole FROM p),
total AS (SELECT count(*) AS n FROM pages),
words AS (SELECT table_id, kind, width, event_id AS word_id, CAST(event_id * 37 % width AS INTEGER) AS x0, CAST(event_id * 37 % width AS INTEGER) + 5.0::DOUBLE AS cx, (event_id * 53 % 12 * 45 + event_id % 5) + 4.0::DOUBLE AS y, event_id % 100 / 100 AS conf,
  CASE WHEN event_id % 9 = 0 THEN CAST(event_id % 40 AS VARCHAR) WHEN event_id % 9 = 1 THEN 'глина' WHEN event_id % 9 = 2 THEN '-ll-' WHEN event_id % 9 = 3 THEN '12,5' WHEN event_id % 9 = 4 THEN 'H3'
       WHEN event_id % 9 = 5 THEN event_type WHEN event_id % 9 = 6 THEN '3.4' WHEN event_id % 63 = 7 THEN 'Описание' WHEN event_id % 45 = 8 THEN 'геолог' ELSE 'x' END AS text
  FROM events JOIN total ON true JOIN o ON o.page_id = event_id * 7 % n AND pos = event_id // n % (CASE WHEN page % 2 = 0 THEN 2 ELSE 4 END)),
sums AS (SELECT kind, ci, sum(frac) OVER (PARTITION BY kind ORDER BY ci ROWS UNBOUNDED PRECEDING) AS run FROM {SPEC_COLUMNS}),
cuts AS (SELECT kind, v.width AS width, ci, CASE WHEN ci = max(ci) OVER (PARTITION BY kind, v.width) THEN v.width ELSE CAST(round_even(run / last_value(run) OVER (PARTITION BY kind, v.width ORDER BY ci ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) * v.width, 0) AS INTEGER) END AS hi FROM sums, (VALUES (800), (900), (1000)) AS v(width)),
bands AS (SELECT kind, width, ci, coalesce(lag(hi) OVER (PARTITION BY kind, width ORDER BY ci), 0) AS lo, hi FROM cuts),
placed AS (SELECT w.*, ci FROM words AS w LEFT JOIN bands AS b ON b.kind = w.kind AND b.width = w.width AND cx >= lo AND cx < hi),
-- tables without row labels
g0 AS (SELECT *, CASE WHEN y - lag(y) OVER (PARTITION BY table_id ORDER BY y, word_id) > 24 THEN 1 ELSE 0 END AS new FROM placed WHERE kind NOT IN (SELECT kind FROM {FIXED})),
g1 AS (SELECT *, CAST(sum(new) OVER (PARTITION BY table_id ORDER BY y, word_id ROWS UNBOUNDED PRECEDING) AS INTEGER) AS grp FROM g0),
centre AS (SELECT table_id, grp AS ri, CAST(sum(y) AS DOUBLE) / count(*) AS cy FROM g1 GROUP BY table_id, grp),
near AS (SELECT g1.table_id, word_id, arg_min(ri, {{'d': abs(y - cy), 'r': ri}}) AS ri FROM g1 JOIN centre USING (table_id) GROUP BY g1.table_id, word_id),
marked AS (SELECT *, ci IS NOT NULL AND {D.key('text', 'ci')} AS k, ci IS NOT NULL AND {D.stem('lower(text)', specs.FOOTER_STEMS)} AS f, ci IS NOT NULL AND {D.stem('lower(text)', specs.HEADER_STEMS)} AS h FROM g1 JOIN near USING (table_id, word_id)),
flags AS (SELECT table_id, ri, bool_or(k) AS k, bool_or(f) AS f, bool_or(h) AS h FROM marked GROUP BY table_id, ri),
begun AS (SELECT c.table_id, c.ri, cy, coalesce(k, false) AS k, coalesce(f, false) AS f, coalesce(h, false) AS h, coalesce(min(CASE WHEN k THEN c.ri END) OVER (PARTITION BY c.table_id), 0) AS first FROM centre AS c LEFT JOIN flags AS x ON x.table_id = c.table_id AND x.ri = c.ri),
ended AS (SELECT *, min(CASE WHEN f AND ri >= first THEN ri END) OVER (PARTITION BY table_id) AS ends FROM begun),
kept AS (SELECT table_id, ri, cy, row_number() OVER (PARTITION BY table_id ORDER BY ri) - 1 AS r FROM ended WHERE ri >= first AND (ends IS NULL OR ri < ends) AND NOT (h AND NOT k)),
-- tables with row labels
f0 AS (SELECT *, {HEIGHT} * (1 - h::DOUBLE / (h + n)::DOUBLE) / n AS step, {HEIGHT} * h::DOUBLE / (h + n)::DOUBLE AS top FROM placed JOIN {FIXED} USING (kind)),
f1 AS (SELECT *, CASE WHEN y - lag(y) OVER (PARTITION BY table_id ORDER BY y, word_id) > 0.5 * step THEN 1 ELSE 0 END AS new FROM f0 WHERE ci = 0),
f2 AS (SELECT *, sum(new) OVER (PARTITION BY table_id ORDER BY y, word_id ROWS UNBOUNDED PRECEDING) AS grp FROM f1),
f3 AS (SELECT table_id, grp, any_value(n) AS n, CAST(sum(y) AS DOUBLE) / count(*) AS cy FROM f2 GROUP BY table_id, grp),
own AS (SELECT table_id, (max(cy) - min(cy)) / (any_value(n) - 1) AS band FROM f3 GROUP BY table_id HAVING count(*) = any_value(n)),
size AS (SELECT o.table_id, h, n, {HEIGHT} * (1 - h::DOUBLE / (h + n)::DOUBLE) / n AS step, {HEIGHT} * h::DOUBLE / (h + n)::DOUBLE AS top FROM o JOIN {FIXED} USING (kind)),
anchors AS (SELECT table_id, grp AS r, cy FROM f3 JOIN own USING (table_id) UNION ALL SELECT table_id, i, top + (i + 0.5::DOUBLE) * step FROM size JOIN range(9) AS t(i) ON i < n WHERE table_id NOT IN (SELECT table_id FROM own)),
fit AS (SELECT w.table_id, w.word_id, arg_min(r, {{'d': abs(y - cy), 'r': r}}) AS r, min(abs(y - cy)) AS dist FROM f0 AS w JOIN anchors AS a ON a.table_id = w.table_id WHERE NOT {D.junk('text')} GROUP BY w.table_id, w.word_id),
-- all tables
every AS (SELECT table_id, r, cy FROM kept UNION ALL SELECT table_id, r, cy FROM anchors),
body AS (SELECT m.table_id, m.kind, r, ci AS c, x0, y, word_id, text, conf FROM marked AS m JOIN kept USING (table_id, ri) WHERE ci IS NOT NULL
  UNION ALL SELECT w.table_id, kind, r, ci, x0, y, w.word_id, text, conf FROM f0 AS w JOIN fit ON fit.table_id = w.table_id AND fit.word_id = w.word_id JOIN size ON size.table_id = w.table_id LEFT JOIN own ON own.table_id = w.table_id
  WHERE ci IS NOT NULL AND dist <= 0.5 * coalesce(band, size.step)),
slots AS (SELECT table_id, r, c, {D.strip("string_agg(text, ' ' ORDER BY x0, y, word_id)")} AS y, CASE WHEN any_value(kind) = 'podschet' THEN NULL ELSE avg(conf) END AS y_conf FROM body GROUP BY table_id, r, c),
pitch AS (SELECT table_id, coalesce(median(gap), 0.05 * {HEIGHT}) AS m FROM (SELECT table_id, lead(cy) OVER (PARTITION BY table_id ORDER BY r) - cy AS gap FROM every) GROUP BY table_id),
dense AS (SELECT o.table_id, o.kind, o.page_id, r, f.c, lo + 50 AS bx0, CAST(trunc(cy - 0.46::DOUBLE * m) AS INTEGER) + 60 AS by0, hi + 50 AS bx1, CAST(trunc(cy + 0.46::DOUBLE * m) AS INTEGER) + 60 AS by1
  FROM every JOIN o USING (table_id) JOIN pitch USING (table_id) JOIN {FILLED} ON f.kind = o.kind JOIN bands AS b ON b.kind = o.kind AND b.width = o.width AND b.ci = f.c),
e AS (SELECT d.*, coalesce(y, '') AS y, y_conf, CASE WHEN r > 6 THEN '' ELSE CASE (page_id + 3 * r + 5 * c) % 6 WHEN 0 THEN '-ll-' WHEN 1 THEN '' WHEN 2 THEN 'глина' WHEN 3 THEN '12,5' WHEN 4 THEN 'x' ELSE CAST(r AS VARCHAR) END END AS q FROM dense AS d LEFT JOIN slots USING (table_id, r, c)),
b AS (SELECT *, {D.clean(pick(1))} AS base, {pick(2, D.q)} AS source, CAST({pick(3)} AS DOUBLE) AS conf, {pick(4, lambda x: str(x).lower())} AS needs_review FROM e WHERE y <> ''),
t AS (SELECT *, CASE WHEN {D.ditto('base')} OR ({SAMPLING} AND c = 0 AND {D.loose('base')}) THEN '-ll-' WHEN {SAMPLING} AND c = 2 THEN {D.code('base')} ELSE base END AS txt, CASE WHEN {D.ditto('q')} THEN '' WHEN y <> '' THEN y ELSE base END AS reader_text FROM b WHERE source IS NOT NULL AND base <> ''),
cells AS (SELECT *, CASE WHEN kind = 'podschet' THEN {D.number('txt')} ELSE txt END AS text FROM t WHERE kind <> 'podschet' OR {D.number('txt')} <> ''),
-- forms and boreholes
asked AS (SELECT table_id, doc_id, page // 2 AS spread, page, side, page_id, kind, ord, key FROM o JOIN {FIELDS} ON form = kind),
fields AS (SELECT *, page_id % 5 > 0 AS read, CASE WHEN page_id % 5 = 0 THEN '' WHEN key = CASE kind WHEN 'form_act' THEN 'Скважина №' ELSE '4. Скважина №' END THEN CASE WHEN kind = 'form_journal' OR page_id % 3 > 0 THEN '№ ' || CAST(page_id // 2 % 5 AS VARCHAR) || ' бис' ELSE 'нет' END WHEN key = 'Дата' THEN '1.2' ELSE '' END AS value,
  page_id % 5 > 0 AND page_id % 2 = 0 AND key IN ('Дата', 'Отряд') AS low FROM asked),
hints AS (SELECT h.doc_id, h.spread, h.hole, coalesce(hint, '1') AS hint, coalesce(hint, '1') <> CAST(h.hole AS VARCHAR) AS mismatch FROM holes AS h LEFT JOIN (
  SELECT doc_id, spread, arg_min(regexp_extract(value, '\\p{{Nd}}+', 0), {{'p': page, 's': side, 'o': ord}}) AS hint FROM fields WHERE contains(lower(key), 'скважина') AND regexp_extract(value, '\\p{{Nd}}+', 0) <> '' GROUP BY doc_id, spread) USING (doc_id, spread)),
meta AS (SELECT o.doc_id, o.page // 2 AS spread, kind AS obj_type, r, c, '[' || bx0 || ',' || by0 || ',' || bx1 || ',' || by1 || ']' AS bbox, source AS text_source, q AS grid_text, reader_text, conf, needs_review, text FROM cells JOIN o USING (table_id, kind)
  UNION ALL SELECT doc_id, spread, kind, ord, 0, '', 'layout', value, NULL, NULL, low, value FROM fields
  UNION ALL SELECT hints.doc_id, hints.spread, 'form_journal', {len(specs.JOURNAL_FIELDS)}, 0, '', 'layout', hint, NULL, NULL, mismatch, hint FROM hints JOIN o ON o.doc_id = hints.doc_id AND o.page // 2 = hints.spread AND kind = 'form_journal'
  UNION ALL SELECT doc_id, spread, 'borehole_id', 0, 0, '', 'position/canonical', hint, NULL, NULL, mismatch, 'pos_N=' || hole FROM hints)"""


def result(spark: SparkSession, sf: str) -> boreholes.Result:
    return boreholes.run(**lens(spark, sf))


@query(f"WITH {FILES} SELECT doc_id, spread, 'скв' || hole || CASE obj_type WHEN 'borehole_id' THEN '' ELSE '_' || {SHEET.replace('kind', 'obj_type')} END AS sheet, obj_type, CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c, 1 AS rs, 1 AS cs, bbox, text_source, grid_text, reader_text, round(conf, 9) AS conf, needs_review, text FROM meta JOIN hints USING (doc_id, spread)")
def borehole_meta(spark, sf):
    """Every meta row of every file: tables' cells, forms' fields, boreholes' numbers."""
    return result(spark, sf).meta.withColumn("conf", F.round("conf", 9))


@query(f"""WITH {FILES} SELECT h.doc_id, h.spread, CAST(h.hole AS INTEGER) AS position, h.hole, hint, mismatch, min(page) + 1 AS first_page, max(page) + 1 AS last_page, count(*) AS n_objects, count(*) AS n_sheets
FROM hints AS h JOIN o ON o.doc_id = h.doc_id AND o.page // 2 = h.spread GROUP BY ALL""")
def borehole_result(spark, sf):
    return result(spark, sf).boreholes


@query(f"""WITH {FILES}, m AS (SELECT doc_id, count(*) AS n_cells, count(*) FILTER (needs_review) AS n_review FROM meta WHERE obj_type <> 'borehole_id' GROUP BY doc_id), h AS (SELECT doc_id, count(*) AS n_boreholes, count(*) FILTER (mismatch) AS n_mismatch FROM hints GROUP BY doc_id)
SELECT h.doc_id, n_boreholes, (SELECT count(*) FROM o WHERE o.doc_id = h.doc_id) AS n_sheets, coalesce(n_cells, 0) AS n_cells, coalesce(n_review, 0) AS n_review, n_mismatch FROM h LEFT JOIN m USING (doc_id)""")
def document_result(spark, sf):
    return result(spark, sf).documents


BOTH = f"({D.strict('q')} <> '' AND {D.strict('reader_text')} <> '')"


@query(f"""WITH {FILES}, n AS (SELECT table_id, count(*) AS n_rows FROM every GROUP BY table_id), s AS (SELECT table_id, count(*) AS n_cells, count(*) FILTER (needs_review) AS n_review, count(*) FILTER ({BOTH}) AS n_both, count(*) FILTER ({BOTH} AND NOT {D.agree('q', 'reader_text')}) AS n_disagree FROM cells GROUP BY table_id)
SELECT doc_id, page // 2 AS spread, 'скв' || hole || '_' || {SHEET} AS sheet, kind, coalesce(n_rows, 0) AS n_rows, coalesce(n_cells, 0) AS n_cells, coalesce(n_review, 0) AS n_review, coalesce(n_both, 0) AS n_both, coalesce(n_disagree, 0) AS n_disagree, CASE WHEN n_both > 0 THEN round(n_disagree / n_both, 9) END AS rate, coalesce(n_rows, 0) > 9 AS mismatch
FROM o JOIN holes ON holes.doc_id = o.doc_id AND holes.spread = o.page // 2 LEFT JOIN n USING (table_id) LEFT JOIN s USING (table_id) WHERE kind IN (SELECT kind FROM {FILLED})""".replace("SELECT doc_id, page // 2", "SELECT o.doc_id, page // 2"))
def table_result(spark, sf):
    """Every table of every file with its figures, those without cells too."""
    return result(spark, sf).tables.select("doc_id", "spread", "sheet", "kind", "n_rows", "n_cells", "n_review", "n_both", "n_disagree", F.round("rate", 9).alias("rate"), "mismatch")
