"""Queries over streams, replies of unknown shape, page counts and truth files, and their SQL; importing this adds them to the catalog's."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import text as X
from gridloom.operators import annotation, inventory, lineage, rules, score, tables
from gridloom.plans import boreholes, process
from gridloom.plans import duck as D
from gridloom.plans import lenses as L
from gridloom.plans import specs
from gridloom.plans.catalog import CLUSTERS, HEADER_NAMES, LABEL_ROWS, MAIN, OBJECTS, _header_rows, query
from gridloom.plans.catalog_files import FIELDS, FILES, FILLED, SAMPLING, SHEET, lens, result
from gridloom.sinks import sheets
from gridloom.sources import pages
from gridloom.streaming import sessions

LATE_DAYS = 1


@query(f"""WITH {CLUSTERS}, s AS (SELECT table_id, min(y) AS first, max(y) AS last, count(*) AS n FROM grouped GROUP BY table_id, grp)
SELECT * FROM s WHERE last + {L.TOL} <= (SELECT max(y) FROM words) - {LATE_DAYS * 86_400_000_000}""")
def stream_sessions_closed(spark, sf):
    """The runs that a stream over `events` has given out when it has read them all: those whose end the watermark has passed."""
    at = f"{sf}/events.parquet"
    events = spark.readStream.schema(spark.read.parquet(at).schema).parquet(f"{sf}/events.parque[t]")  # a pattern may name one file, a path must name a folder
    words = events.select(F.col("user_id").alias("table_id"), L.micros("ts").alias("y"))
    return sessions.appended(sessions.by_gap(words, late=f"{LATE_DAYS} days"))


@query("""WITH f AS (SELECT p_partkey, p_size % 5 AS n FROM part) SELECT 'f' || p_partkey || '.pdf' AS path, CAST(i AS INTEGER) AS page FROM f, range(2) AS t(i) WHERE i < n""")
def page_index(spark, sf):
    """The first two pages of files whose trees tell their counts, of which every fifth has none."""
    p = L.table(spark, sf, "part")
    n = (F.col("p_size") % 5).cast("string")
    tree = F.when(F.col("p_size") % 5 > 0, F.concat(F.lit("%PDF-1.4 << /Type /Pages /Kids [ ] /Count "), n, F.lit(" >> << /Count 0 /Type /Pages >>"))).otherwise(F.lit("%PDF-1.4 compressed"))
    listed = p.select(F.concat(F.lit("f"), F.col("p_partkey").cast("string"), F.lit(".pdf")).alias("path"), tree.cast("binary").alias("content"))
    return pages.pages(listed, pages.page_count(F.col("content")), [0, 1])


SHAPES = "event_id % 7"


@query(f"""WITH e AS (SELECT event_id, event_type, {SHAPES} AS k, CAST(event_id % 50 AS INTEGER) AS x FROM events),
t AS (SELECT event_id, event_type, k, x, i AS "table" FROM e, range(2) AS r(i) WHERE k IN (0, 1, 2, 3) AND (i = 0 OR k = 0)),
c AS (SELECT t.*, j FROM t LEFT JOIN (SELECT j FROM range(2) AS r(j)) ON NOT (k = 2 OR (k = 0 AND "table" = 1)))
SELECT event_id, CAST("table" AS INTEGER) AS "table", CASE WHEN k = 0 AND "table" = 1 THEN 0 WHEN k = 3 THEN 0 ELSE x END AS rows, CASE WHEN k = 0 AND "table" = 1 THEN 0 WHEN k = 2 THEN 0 ELSE 3 END AS cols,
  CASE WHEN k = 0 AND "table" = 0 THEN '0,' || least(x, 7) || ',' || (x + 9) || ',' || greatest(x, 7) END AS table_box,
  CAST(CASE WHEN j IS NULL THEN NULL WHEN k = 3 AND j = 1 THEN 0 ELSE j END AS INTEGER) AS r, CAST(CASE WHEN j IS NULL THEN NULL WHEN k = 3 AND j = 1 THEN 0 ELSE 2 END AS INTEGER) AS c,
  CAST(CASE WHEN j IS NULL THEN NULL WHEN j = 0 AND k < 3 THEN 2 ELSE 1 END AS INTEGER) AS rs, CAST(CASE WHEN j IS NOT NULL THEN 1 END AS INTEGER) AS cs, CASE WHEN j IS NULL THEN NULL WHEN j = 0 THEN event_type ELSE '' END AS text FROM c""")
def annotation_tables(spark, sf):
    """Cells of tables in replies of seven shapes: whole, in a fence with numbers as texts, without cells, with other names, no array, broken, and empty."""
    e = L.table(spark, sf, "events")
    k, x = F.col("event_id") % 7, (F.col("event_id") % 50).cast("string")
    say = lambda *parts: F.concat(*[p if isinstance(p, F.Column) else F.lit(p) for p in parts])
    text = F.to_json(F.struct(F.col("event_type").alias("text")))
    t = F.substring(text, F.lit(2), F.length(text) - 2)
    cells = lambda r, c, rs: say('"cells":[{"', r, '":0,"', c, '":2,"', rs, '":2,', t, '},{"', r, '":1,"', c, '":2}]')
    box = say('"boundingBox":{"vertices":[{"y":', x, '},{"x":"', (F.col("event_id") % 50 + 9).cast("string"), '","y":"7"},{"x":"1","y":"', x, '"}]}')
    whole = say('{"tables":[{"rowCount":', x, ',"columnCount":3,', cells("rowIndex", "columnIndex", "rowSpan"), ",", box, '},{}],"other":[1]}')
    fenced = say('```json\n{"result":{"textAnnotation":{"tables":[{"rows":"', x, '","cols":"3",', cells("row", "col", "rs"), "}]}}}\n```")
    bare = say('{"tables":[{"row_count":', x, ',"columns":9}]}')
    misnamed = say('{"tables":[{"height":', x, ',"cols":3,"cells":[{"r":0,"c":2,"rowSpan":null,', t, '},{"R":1,"column":"x","text":null}]}]}')
    reply = F.when(k == 0, whole).when(k == 1, fenced).when(k == 2, bare).when(k == 3, misnamed).when(k == 4, F.lit('{"tables":{"rowCount":1}}')).when(k == 5, F.lit('{"tables":[{"rowCount":1')).otherwise(F.lit(""))
    found = annotation.reply_tables(e.select("event_id", reply.alias("reply")), "reply")
    b = F.col("table_box")
    return found.select("event_id", "table", "rows", "cols", F.when(b.isNotNull(), F.concat_ws(",", *[b[n].cast("string") for n in ("x0", "y0", "x1", "y1")])).alias("table_box"), "r", "c", "rs", "cs", "text")


TRUTH_ROWS = 8


def _truth_text(r: F.Column, c: F.Column) -> F.Column:
    k = (F.col("page_id") + 3 * r + 5 * c) % 6
    own = F.when(k == 0, F.lit("-ll-")).when(k == 1, F.lit("")).when(k == 2, F.lit("Глина.")).when(k == 3, F.lit("12,5")).when(k == 4, F.lit("x")).otherwise(r.cast("string"))
    return F.when(r * c % 7 == 3, F.lit("другое")).otherwise(own)


TRUTH = f"""{FILES}, truth AS (SELECT 'd' || o.doc_id || '_скв' || hole AS borehole, kind, o.table_id, r, c, r * c % 7 = 3 AS odd, (r + c) % 11 = 0 AS empty, (r + 2 * c) % 13 = 0 AS graphic, (o.page_id + 3 * r + 5 * c) % 6 AS k,
  CASE WHEN r * c % 7 = 3 THEN 'другое' ELSE CASE (o.page_id + 3 * r + 5 * c) % 6 WHEN 0 THEN '-ll-' WHEN 1 THEN '' WHEN 2 THEN 'Глина.' WHEN 3 THEN '12,5' WHEN 4 THEN 'x' ELSE CAST(r AS VARCHAR) END END AS want
  FROM o JOIN holes ON holes.doc_id = o.doc_id AND holes.spread = o.page // 2, range({TRUTH_ROWS}) AS a(r), range(8) AS b(c) WHERE kind = 'journal_left'),
judged AS (SELECT t.borehole, t.kind, t.want, coalesce(x.text, '') AS got, t.k = 0 AND NOT t.odd AS fixed FROM truth AS t LEFT JOIN cells AS x ON x.table_id = t.table_id AND x.r = t.r AND x.c = t.c WHERE NOT empty AND NOT graphic AND {D.strict('want')} <> '')"""


@query(f"""WITH {TRUTH}, hits AS (SELECT borehole, kind, fixed, {D.strict('want')} = {D.strict('got')} AS strict, {D.fuzzy('want')} = {D.fuzzy('got')} AS fuzzy FROM judged),
n AS (SELECT table_id, count(*) AS n_rows FROM every GROUP BY table_id)
SELECT 'accuracy' AS part, borehole, kind, NULL AS fixed, count(*) AS a, count(*) FILTER (strict) AS b, count(*) FILTER (fuzzy) AS c FROM hits GROUP BY ROLLUP (borehole, kind)
UNION ALL SELECT 'buckets', NULL, NULL, fixed, count(*), count(*) FILTER (strict), count(*) FILTER (fuzzy) FROM hits GROUP BY ROLLUP (fixed)
UNION ALL SELECT DISTINCT 'rows', borehole, kind, NULL, {TRUTH_ROWS}, coalesce(n_rows, 0), NULL FROM truth LEFT JOIN n USING (table_id)""")
def score_report(spark, sf):
    """A run's sheets against truth files with wrong, empty, graphic and repeated cells and a row too many; figures by borehole and kind, by bucket, and rows."""
    p = lens(spark, sf)
    seq = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    flag = lambda r, c: F.struct(_truth_text(r, c).alias("text"), ((r + c) % 11 == 0).alias("empty"), ((r + 2 * c) % 13 == 0).alias("graphic"), (_truth_text(r, c) == "-ll-").alias("ditto"))
    data = F.transform(seq(TRUTH_ROWS), lambda r: F.transform(seq(8), lambda c: flag(r, c)))
    number = F.col("doc_id") * 8 + F.col("page")
    of = p["objects"].where("kind = 'journal_left'").withColumn("page_id", number)
    name = F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit("_скв"), (F.floor(F.col("page") / 2) + 1).cast("string"))
    objects = F.create_map(F.lit("гр1-8"), F.struct(data.alias("data"), F.lit(None).alias("rows"), F.lit(None).alias("merges"), F.lit(None).alias("graph_numbers")))
    truth = of.select(name.alias("borehole"), objects.cast(score.TRUTH.partition("objects ")[2]).alias("objects"))
    found = result(spark, sf)
    sheet = F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit("_"), F.col("sheet")).alias("sheet")
    none = found.cells.sparkSession.createDataFrame([], "sheet string, kind string, item string")
    parts = score.report(truth, found.cells.select(sheet, "kind", "r", "c", "text"), found.tables.select(sheet, "kind", "n_rows"), none)
    null = lambda t: F.lit(None).cast(t)
    shares = ["total", "n_strict", "n_fuzzy"]
    out = parts["accuracy"].select(F.lit("accuracy").alias("part"), "borehole", "kind", null("boolean").alias("fixed"), *[F.col(x).alias(y) for x, y in zip(shares, "abc")])
    out = out.unionByName(parts["buckets"].select(F.lit("buckets").alias("part"), null("string").alias("borehole"), null("string").alias("kind"), "fixed", *[F.col(x).alias(y) for x, y in zip(shares, "abc")]))
    return out.unionByName(parts["rows"].select(F.lit("rows").alias("part"), "borehole", "kind", null("boolean").alias("fixed"), F.col("truth_rows").cast("long").alias("a"), F.col("n_rows").cast("long").alias("b"), null("long").alias("c")))


AGAIN = (" H3 ", "-//-", "  ", "12,5 м", "нc")


@query(f"""WITH p AS (SELECT 't' || o_custkey AS table_id, o_orderkey AS r, [{', '.join(map(str, tables.RETRIED))}][o_orderkey % {len(tables.RETRIED)} + 1] AS c, o_orderkey % 10 AS k, o_orderkey % 3 = 0 AS has_text, o_orderkey % 4 > 0 AS ink,
  CASE WHEN o_orderkey % 6 = 5 THEN o_orderpriority ELSE [{', '.join(map(D.q, AGAIN))}][o_orderkey % 5 + 1] END AS said, CASE WHEN o_orderkey % 7 > 0 THEN round(o_orderkey % 100 / 100, 2) END AS conf FROM orders),
b AS (SELECT *, {D.clean("said")} AS base FROM p WHERE k < 9 AND NOT has_text AND ink)
SELECT table_id, r, CAST(c AS INTEGER) AS c, CASE WHEN {D.ditto("base")} THEN '-ll-' WHEN c = 2 THEN {D.code("base")} ELSE base END AS text, conf, conf IS NULL AS needs_review FROM b WHERE base <> ''""")
def second_readings(spark, sf):
    """Places with ink and no text, or a dash for one, that are read again; those of other kinds, without ink or with text are not."""
    o, key = L.table(spark, sf, "orders"), F.col("o_orderkey")
    column = F.get(F.array(*[F.lit(c) for c in tables.RETRIED]), (key % len(tables.RETRIED)).cast("int"))
    box = F.lit(None).cast("struct<x0:int,y0:int,x1:int,y1:int>").alias("box")
    kind = F.when(key % 10 < 9, F.lit("sampling_right")).otherwise(F.lit("kontrol")).alias("kind")
    places = o.select(F.concat(F.lit("t"), F.col("o_custkey").cast("string")).alias("table_id"), kind, key.alias("r"), column.alias("c"), box, "o_orderpriority")
    on, r = ["table_id", "r", "c"], F.col("r")
    cells = places.where(r % 3 < 2).select(*on, F.when(r % 3 == 0, F.lit("1")).otherwise(F.lit(" ")).alias("text"))
    ink = places.where(r % 4 > 0).select(*on)
    said = F.when(r % 6 == 5, F.col("o_orderpriority")).otherwise(F.get(F.array(*map(F.lit, AGAIN)), (r % 5).cast("int")))
    again = places.select(*on, said.alias("text"), F.when(r % 7 > 0, F.round(r % 100 / 100, 2)).alias("conf"))
    return tables.retried(tables.inky_blanks(places.drop("o_orderpriority"), cells, ink), again).select(*on, "text", "conf", "needs_review")


DARK, RULE, NEAR = 118, 3, 1
PIXELS = f"{L.TILES}, px AS (SELECT vec_id, i // 8 AS y, i % 8 AS x, tile[i + 1] < {DARK} AS dark FROM tiles, range(64) AS t(i))"


def _dark_runs(spark, sf, column=False):
    tile = rules.turned(F.col("tile"), 8, 8) if column else F.col("tile")
    return rules.runs(L.tiles(spark, sf), ["vec_id"], tile, 8, lambda v: v < DARK)


@query(f"""WITH {PIXELS}, s AS (SELECT vec_id, 'h' AS side, y AS line, x AS place, dark FROM px UNION ALL SELECT vec_id, 'v', x, y, dark FROM px),
e AS (SELECT *, dark AND coalesce(lag(dark) OVER w, true) AND coalesce(lead(dark) OVER w, true) AS core FROM s WINDOW w AS (PARTITION BY vec_id, side, line ORDER BY place)),
o AS (SELECT *, core OR coalesce(lag(core) OVER w, false) OR coalesce(lead(core) OVER w, false) AS kept FROM e WINDOW w AS (PARTITION BY vec_id, side, line ORDER BY place)),
f AS (SELECT vec_id, side, line FROM o WHERE kept GROUP BY ALL HAVING count(*) >= {RULE}),
g AS (SELECT *, CASE WHEN line - lag(line) OVER w > {NEAR} THEN 1 ELSE 0 END AS new FROM f WINDOW w AS (PARTITION BY vec_id, side ORDER BY line)),
n AS (SELECT *, sum(new) OVER (PARTITION BY vec_id, side ORDER BY line) AS i FROM g)
SELECT vec_id, side, CAST(i AS INTEGER) AS i, CAST(min(line) AS INTEGER) AS first, CAST(max(line) AS INTEGER) AS last, CAST(sum(line) // count(*) AS INTEGER) AS middle, count(*) AS thickness FROM n GROUP BY vec_id, side, i""")
def rule_lines(spark, sf):
    """Ruled lines both ways, of dark runs of three pixels or more; neighbouring lines are one."""
    each = [_dark_runs(spark, sf, column).select(F.lit(side).alias("side"), "*") for side, column in (("h", False), ("v", True))]
    keys = ["vec_id", "side"]
    return rules.lines(rules.opened(each[0].unionByName(each[1]), 3, 8), keys, RULE, NEAR)


@query(f"""WITH RECURSIVE {PIXELS}, d AS (SELECT vec_id, y, x FROM px WHERE dark),
reach AS (SELECT vec_id, y, x, y * 8 + x AS root FROM d UNION SELECT d.vec_id, d.y, d.x, r.root FROM reach AS r JOIN d ON d.vec_id = r.vec_id AND abs(d.y - r.y) <= 1 AND abs(d.x - r.x) <= 1),
lab AS (SELECT vec_id, y, x, min(root) AS root FROM reach GROUP BY ALL), box AS (SELECT vec_id, root, min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h, count(*) AS pixels FROM lab GROUP BY vec_id, root)
SELECT vec_id, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY y, x, root) - 1 AS INTEGER) AS i, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, CAST(w AS INTEGER) AS w, CAST(h AS INTEGER) AS h, pixels FROM box""")
def ink_regions(spark, sf):
    """What hangs together in each tile, from the top and then from the left."""
    return rules.regions(_dark_runs(spark, sf), ["vec_id"])


TABLE_KINDS = D.values([(k, len(specs.leaves(k)), specs.HEADER_ROWS[k] + (k in specs.GRAPH_NUMBERS), k in specs.ROW_LABELS) for k in specs.KINDS], "k(kind, n_columns, high, by_label)")
TITLES_OF = D.values([(k, v) for k, v in specs.FORM_TITLES.items()], "f(kind, title)")
HEADS = D.values([(i, x) for i, x in enumerate(specs.FORM_HEADER)], "h(c, label)")


@query(f"""WITH {FILES}, dg AS (SELECT *, {D.digits('text')} AS d FROM cells), facing AS (SELECT table_id, r, list(DISTINCT d) AS others FROM dg WHERE {SAMPLING} AND c IN (7, 8, 9) AND d <> '' GROUP BY table_id, r),
shown AS (SELECT dg.table_id, kind, dg.r, c, conf, CASE WHEN {SAMPLING} AND c IN (4, 5, 6) AND length(d) >= 2 AND len(list_filter(coalesce(others, []), lambda x: contains(x, d) OR contains(d, x))) > 0 THEN '' ELSE text END AS text FROM dg LEFT JOIN facing USING (table_id, r)),
above AS (SELECT *, last_value(CASE WHEN NOT {D.ditto('text')} AND {D.strict('text')} <> '' THEN text END IGNORE NULLS) OVER (PARTITION BY table_id, c ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM shown),
x AS (SELECT table_id, r, c, text, CASE WHEN conf < 0.55 THEN 'orange' WHEN {D.ditto('text')} AND last IS NOT NULL THEN 'yellow' END AS fill FROM above),
named AS (SELECT o.doc_id, o.table_id, o.kind, o.page // 2 AS spread, 'скв' || hole || '_' || {SHEET.replace('kind', 'o.kind')} AS sheet FROM o JOIN holes ON holes.doc_id = o.doc_id AND holes.spread = o.page // 2),
n AS (SELECT table_id, count(*) AS n_rows FROM every GROUP BY table_id), sized AS (SELECT named.*, n_columns, high, by_label, coalesce(n_rows, 0) AS n_rows FROM named JOIN {TABLE_KINDS} USING (kind) LEFT JOIN n USING (table_id)),
printed AS (SELECT sized.*, a.r AS r, b.c FROM sized, generate_series(0, n_rows + {sheets.BLANK_ROWS} - 1) AS a(r), generate_series(0, n_columns - 1) AS b(c) WHERE NOT by_label),
head AS (SELECT table_id FROM x WHERE r = 0 AND c = 0 AND {D.strict('text')} <> '' AND NOT regexp_matches({D.strict('text')}, '^[{D.DIGIT}]+$')),
free AS (SELECT p.*, p.table_id IN (SELECT table_id FROM head) AS up, coalesce(x.text, '') AS text, fill FROM printed AS p LEFT JOIN x USING (table_id, r, c)),
label AS (SELECT sized.*, l.r, l.label, l.unit, b.c FROM sized JOIN {D.values(LABEL_ROWS, 'l(kind, r, label, unit)')} USING (kind), generate_series(0, n_columns - 1) AS b(c)),
filled AS (SELECT l.*, CASE WHEN l.c = 0 THEN label WHEN l.c = 1 AND unit <> '' THEN unit WHEN f.c IS NOT NULL THEN coalesce(x.text, '') ELSE '' END AS text, CASE WHEN l.c = 0 OR (l.c = 1 AND unit <> '') THEN 'label' WHEN f.c IS NOT NULL AND fill = 'orange' THEN fill END AS fill
  FROM label AS l LEFT JOIN x ON x.table_id = l.table_id AND x.r = l.r AND x.c = l.c LEFT JOIN {FILLED} ON f.kind = l.kind AND f.c = l.c WHERE NOT (l.kind = 'podschet' AND l.c = 4)),
asking AS (SELECT doc_id, spread, kind, ord, key, value, low FROM fields UNION ALL SELECT h.doc_id, h.spread, 'form_journal', {len(specs.JOURNAL_FIELDS)}, {D.q(specs.HINT_FIELD)}, hint, mismatch FROM hints AS h JOIN named ON named.doc_id = h.doc_id AND named.spread = h.spread AND kind = 'form_journal'),
forms AS (SELECT * FROM named JOIN {TITLES_OF} USING (kind)),
entry AS (SELECT forms.doc_id, sheet, kind, ord, key, value, low FROM forms JOIN asking USING (doc_id, spread, kind)),
every_cell AS (SELECT doc_id, sheet, kind, r - up::INTEGER + high AS r, c, 1 AS rs, 1 AS cs, text, fill, false AS upright FROM free WHERE NOT (up AND r = 0)
  UNION ALL SELECT doc_id, sheet, kind, r + high, c, 1, 1, text, fill, false FROM filled
  UNION ALL SELECT doc_id, sheet, kind, h.r, h.c, CASE WHEN kind = 'podschet' AND h.c = 4 THEN 7 ELSE h.rs END, h.cs, h.text, NULL, h.upright FROM sized JOIN {D.values(_header_rows(), HEADER_NAMES)} USING (kind)
  UNION ALL SELECT doc_id, sheet, kind, 0, 0, 1, 1, title, NULL, false FROM forms
  UNION ALL SELECT doc_id, sheet, kind, 2, c, 1, 1, label, 'head', false FROM forms, {HEADS}
  UNION ALL SELECT doc_id, sheet, kind, ord + 3, c, 1, 1, CASE c WHEN 0 THEN key WHEN 1 THEN value ELSE 'layout' END, CASE WHEN c = 1 AND low THEN 'review' END, false FROM entry, range(3) AS t(c))
SELECT CAST(doc_id AS VARCHAR) AS doc_id, sheet, kind, CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c, CAST(rs AS INTEGER) AS rs, CAST(cs AS INTEGER) AS cs, text, fill, upright FROM every_cell""")
def whole_sheets(spark, sf):
    """Every cell of every sheet of every file: headers, numbers, labels, units, values with their fills, blank rows, signatures and forms."""
    return sheets.whole(result(spark, sf).stored(lineage.place(spark), ("cells", "tables", "fields")))


OBJECTS_OF = FILES.partition(",\nholes AS")[0]  # the first tables of FILES
ASKED = f"""own AS (SELECT *, CASE WHEN "group" IS NULL THEN label ELSE "group" || ' — ' || label END AS named FROM {D.values([(k, i, label, group) for k, i, label, group, _, _ in specs.column_rows()], 's(kind, ci, label, "group")')}),
t AS (SELECT kind, 'Columns, in order: ' || string_agg(named, '; ' ORDER BY ci) || '. Reply with JSON {{"rows": [[...]], "low_conf": [[row, column], ...]}} and ' || count(*) || ' texts in each row.' AS prompt FROM own GROUP BY kind),
f AS (SELECT form, 'Form: ' || title || '. Fields: ' || string_agg(key, '; ' ORDER BY ord) || '. Reply with JSON {{"fields": {{name: text}}, "low_conf": [name, ...]}}, an empty text for an empty field.' AS prompt FROM {FIELDS} JOIN {TITLES_OF.replace('f(kind', 'x(kind')} ON x.kind = form GROUP BY form, title)"""


@query(f"""WITH {OBJECTS_OF}, {ASKED} SELECT table_id, coalesce(t.prompt, f.prompt) AS prompt FROM o LEFT JOIN t USING (kind) LEFT JOIN f ON form = kind""")
def prompts(spark, sf):
    """What a layout engine is asked for each object of each file."""
    found = boreholes.routed(lens(spark, sf)["objects"])
    asked = {**{k: process.prompt(k) for k in specs.KINDS}, **{f: process.form_prompt(f) for f in specs.FORMS}}
    return found.where("route in ('table', 'form')").select("table_id", F.try_element_at(X.literal_map(asked), F.col("kind")).alias("prompt"))


def _halves(spark, sf):
    """Half pages of files of four, with synthetic boxes, as `images.halves` gives them."""
    k, box = F.col("page_id"), F.struct("x", "y", "w", "h", "v_rules")
    boxes = L.boxes(spark, sf).groupBy("page_id", "side", "width", "height").agg(F.collect_list(box).alias("boxes"))
    path = F.concat(F.lit("f"), F.floor(k / 4).cast("string")).alias("path")
    return boxes.select(path, (k % 4).cast("int").alias("page"), "side", "width", "height", (k % 200 / 8 - 12).alias("deskew"), (k % 30).cast("int").alias("h_lines"), (k % 17).cast("int").alias("v_lines"), "boxes")


@query(f"""WITH {MAIN}, {OBJECTS}, listed AS (SELECT 'f' || page_id // 4 AS path, page_id, kind FROM objects), sums AS (SELECT path, count(*) AS n, count(DISTINCT page_id) AS pages FROM listed GROUP BY path), kinds AS (SELECT path, kind, count(*) AS n FROM listed GROUP BY path, kind)
SELECT path, CAST(i AS INTEGER) AS n, ['file: ' || path, 'pages: ' || pages, 'objects: ' || n, '', 'by kind:'][i + 1] AS line FROM sums, range(5) AS r(i)
UNION ALL SELECT path, CAST(row_number() OVER (PARTITION BY path ORDER BY kind) + 4 AS INTEGER), '  ' || kind || repeat(' ', greatest(0, 16 - length(kind))) || ' ' || n FROM kinds""")
def inventory_report(spark, sf):
    """From boxes on half pages to each file's summary of objects, as lines."""
    return inventory.report(inventory.of_halves(_halves(spark, sf)))


@query("""SELECT 'f' || page_id // 4 AS path, CAST(page_id % 4 + 1 AS INTEGER) AS page, CASE WHEN page_id % 2 = 0 THEN 'L' ELSE 'R' END AS side, round_even(page_id % 200 / 8 - 12, 2) AS deskew_deg, CAST(page_id % 30 AS INTEGER) AS h_lines, CAST(page_id % 17 AS INTEGER) AS v_lines, 1000 AS w, 1400 AS h,
'p0' || (page_id % 4 + 1) || '_' || CASE WHEN page_id % 2 = 0 THEN 'L' ELSE 'R' END || '_enhanced.png' AS enhanced FROM pages""")
def half_page_manifest(spark, sf):
    return inventory.manifest(_halves(spark, sf))
