"""Sheets: cells with headers, numbers and labels as one relation, written as JSON, Parquet or workbooks."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.functions import text as X
from gridloom.operators import identity, tables
from gridloom.plans import boreholes, specs

FILLS = {"orange": "FFFFC000", "yellow": "FFFFFF99", "review": "FFFFC7CE", "label": "FFF2F2F2", "head": "FFD9E1F2"}
BLANK_ROWS = 2  # after the last row of a table without row labels


def header_cells(spark: SparkSession) -> DataFrame:
    """(kind, r, c, rs, cs, text, upright): the printed header of each table, with the cells that a merge joins, and the row of column numbers.

    Of podschet, the first column has the table's title over its label, and the signature's column joins its data rows too (see `signature`).
    """
    rows = []
    for kind in specs.KINDS:
        high, c = specs.HEADER_ROWS[kind], 0
        for label, what, *upright in specs.COLUMNS[kind]:
            if isinstance(what, list):
                rows.append((kind, 0, c, 1, len(what), label, False))
                rows += [(kind, 1, c + i, 1, 1, sub, up) for i, (sub, _, up) in enumerate(what)]
                c += len(what)
                continue
            if kind in specs.TITLES and c == 0:
                rows += [(kind, 0, 0, 1, 1, specs.TITLES[kind], False), (kind, 1, 0, 1, 1, label, False)]
            elif specs.SIGNATURE_COLUMN.get(kind) == c + 1:
                rows.append((kind, 0, c, 1, 1, label, False))
            else:
                rows.append((kind, 0, c, high, 1, label, upright[0]))
            c += 1
        rows += [(kind, high, i, 1, 1, str(n), False) for i, n in enumerate(specs.GRAPH_NUMBERS.get(kind, ()))]
    return spark.createDataFrame(rows, "kind string, r int, c int, rs int, cs int, text string, upright boolean")


def data_offset(kind: str) -> int:
    return specs.HEADER_ROWS[kind] + (kind in specs.GRAPH_NUMBERS)


def fill_of(conf: F.Column, text: F.Column, expanded: F.Column | None = None) -> F.Column:
    """Low confidence is orange, before the yellow of a repeat mark, or of one with a value above where that is known."""
    return F.when(conf < specs.LOW_CONF, F.lit("orange")).when(X.is_ditto(text) if expanded is None else expanded, F.lit("yellow"))


def labelled(sheets: DataFrame, cells: DataFrame) -> DataFrame:
    """(sheet, kind, r, c, text, fill) of the data rows of tables with printed row labels, every place of them.

    Labels and units are the form's own, values come from cells (sheet, r, c, text, conf) in the columns to fill, and all else is blank.
    """
    rows = [(k, r, label, (specs.UNITS.get(k) or ())[r : r + 1]) for k, labels in specs.ROW_LABELS.items() for r, label in enumerate(labels)]
    frame = [(k, r, c, label if c == 0 else unit[0] if unit and c == 1 else None, c in specs.FILL_COLUMNS[k]) for k, r, label, unit in rows for c in range(len(specs.leaves(k)))]
    places = F.broadcast(cells.sparkSession.createDataFrame(frame, "kind string, r int, c int, own string, fills boolean"))
    at = sheets.select("sheet", "kind").join(places, "kind").join(cells.select("sheet", "r", "c", "text", "conf"), ["sheet", "r", "c"], "left")
    value = F.coalesce("own", F.when(F.col("fills"), F.col("text")), F.lit(""))
    fill = F.when(F.col("own").isNotNull(), F.lit("label")).when(F.col("fills") & (F.col("conf") < specs.LOW_CONF), F.lit("orange"))
    return at.select("sheet", "kind", "r", "c", value.alias("text"), fill.alias("fill"))


def freeform(cells: DataFrame, n_rows: DataFrame | None = None) -> DataFrame:
    """(sheet, kind, r, c, text, fill) of the data rows of tables without row labels.

    The first row goes if it looks like a header: its first cell is neither blank nor a number. n_rows (sheet, n_rows): then every place of each row is
    there, and two blank rows after the last.
    """
    first = X.strip(F.col("text"))
    head = cells.where((F.col("r") == 0) & (F.col("c") == 0) & (first != "") & ~first.rlike(f"^{X.DIGIT}+$")).select("sheet", F.lit(1).alias("_up")).distinct()
    expanded = F.col("expanded") if "expanded" in cells.columns else None
    at = cells.withColumn("fill", fill_of(F.col("conf"), F.col("text"), expanded)).select("sheet", "kind", "r", "c", "text", "fill")
    if n_rows is not None:
        columns = tables.by_kind(F.col("kind"), {k: len(specs.leaves(k)) for k in specs.KINDS})
        places = n_rows.where(~F.col("kind").isin(*specs.ROW_LABELS) & F.col("kind").isin(*specs.KINDS)).withColumn("r", F.explode(F.sequence(F.lit(0), F.col("n_rows").cast("int") + BLANK_ROWS - 1)))
        places = places.select("sheet", "kind", "r", F.explode(F.sequence(F.lit(0), columns - 1)).alias("c"))
        at = places.join(at.drop("kind"), ["sheet", "r", "c"], "left").select("sheet", "kind", "r", "c", F.coalesce("text", F.lit("")).alias("text"), "fill")
    moved = at.join(head, "sheet", "left").where("_up is null or r > 0")
    return moved.select("sheet", "kind", (F.col("r") - F.coalesce("_up", F.lit(0))).cast("int").alias("r"), "c", "text", "fill")


def sheet_cells(cells: DataFrame, header: DataFrame, all_sheets: DataFrame | None = None) -> DataFrame:
    """(sheet, kind, r, c, rs, cs, text, fill, upright) of whole sheets from data cells (sheet, kind, r, c, text, conf[, expanded]).

    all_sheets (sheet, kind, n_rows), of tables without any cell too; with it, every place of a table is there, labels and units among them, and the signature's
    column joins the rows. A table of an unknown kind is its cells alone, from the first row on.
    """
    offsets = F.coalesce(tables.by_kind(F.col("kind"), {k: data_offset(k) for k in specs.KINDS}), F.lit(0))
    known, by_label = F.col("kind").isin(*specs.KINDS), F.col("kind").isin(*specs.ROW_LABELS)
    plain = lambda df: df.select("sheet", "kind", "r", "c", "text", fill_of(F.col("conf"), F.col("text")).alias("fill"))
    free = freeform(cells.where(known & ~by_label), all_sheets)
    rest = plain(cells.where(by_label)) if all_sheets is None else labelled(all_sheets.where(by_label), cells)
    data = free.unionByName(rest).unionByName(plain(cells.where(~known)).withColumn("fill", F.lit(None).cast("string")))
    data = data.select("sheet", "kind", (F.col("r") + offsets).cast("int").alias("r"), "c", F.lit(1).alias("rs"), F.lit(1).alias("cs"), "text", "fill", F.lit(False).alias("upright"))
    sheets = (cells if all_sheets is None else all_sheets).select("sheet", "kind").distinct()
    top = sheets.join(F.broadcast(header), "kind").select("sheet", "kind", "r", "c", "rs", "cs", "text", F.lit(None).cast("string").alias("fill"), "upright")
    return signature(top.unionByName(data)) if all_sheets is not None else top.unionByName(data)


def signature(cells: DataFrame) -> DataFrame:
    """Whole sheets in which the signature's column is one cell, from the header to the last row."""
    column = tables.by_kind(F.col("kind"), {k: c - 1 for k, c in specs.SIGNATURE_COLUMN.items()}, -1)
    high = tables.by_kind(F.col("kind"), {k: data_offset(k) + len(specs.ROW_LABELS[k]) for k in specs.SIGNATURE_COLUMN}, 1)
    signed = F.col("c") == column
    return cells.where(~signed | (F.col("r") == 0)).withColumn("rs", F.when(signed, high).otherwise(F.col("rs")).cast("int"))


def merges(cells: DataFrame) -> DataFrame:
    """(sheet, kind, item) of each merged range of whole sheets, such as B1:D1."""
    letter = lambda c: F.concat(F.when(c >= 26, F.chr(F.lit(64) + F.floor(c / 26).cast("int"))).otherwise(F.lit("")), F.chr(F.lit(65) + c % 26))
    c, r, end, last = F.col("c"), F.col("r"), F.col("c") + F.col("cs") - 1, F.col("r") + F.col("rs")
    item = F.concat(letter(c), (r + 1).cast("string"), F.lit(":"), letter(end), last.cast("string"))
    return cells.where("rs > 1 or cs > 1").select("sheet", "kind", item.alias("item"))


def form_cells(fields: DataFrame) -> DataFrame:
    """(sheet, kind, r, c, rs, cs, text, fill, upright) of forms' sheets from fields (sheet, kind, ord, key, value, source, needs_review): the title, a row of headers, and a row for each field."""
    title = tables.by_kind(F.col("kind"), specs.FORM_TITLES)
    sheets = fields.select("sheet", "kind").distinct()
    at = lambda df, r, c, text, fill: df.select("sheet", "kind", r.cast("int").alias("r"), c.cast("int").alias("c"), F.lit(1).alias("rs"), F.lit(1).alias("cs"), text.alias("text"), fill.cast("string").alias("fill"), F.lit(False).alias("upright"))
    heads = sheets.select("sheet", "kind", F.posexplode(F.array(*map(F.lit, specs.FORM_HEADER))).alias("i", "label"))
    part = F.struct(F.lit(0).alias("c"), F.col("key").alias("t"), F.lit(None).cast("string").alias("f"))
    value = F.struct(F.lit(1).alias("c"), F.col("value").alias("t"), F.when(F.col("needs_review"), F.lit("review")).alias("f"))
    source = F.struct(F.lit(2).alias("c"), F.coalesce("source", F.lit("")).alias("t"), F.lit(None).cast("string").alias("f"))
    body = fields.select("sheet", "kind", "ord", F.explode(F.array(part, value, source)).alias("p"))
    return (
        at(sheets, F.lit(0), F.lit(0), title, F.lit(None))
        .unionByName(at(heads, F.lit(2), F.col("i"), F.col("label"), F.lit("head")))
        .unionByName(at(body, F.col("ord") + 3, F.col("p.c"), F.col("p.t"), F.col("p.f")))
    )


def meta_cells(meta: DataFrame) -> DataFrame:
    """(doc_id, name, r, c, text) of the sheet _meta of each document: a row of names, then the meta rows in order."""
    names = [f.strip().rsplit(" ", 1)[0] for f in boreholes.META.split(",")]
    w = Window.partitionBy("doc_id").orderBy("spread", "sheet", "obj_type", "r", "c")
    each = meta.withColumn("_r", F.row_number().over(w)).select("doc_id", F.col("_r").alias("r"), F.posexplode(F.array(*[F.col(n).cast("string") for n in names])).alias("c", "text"))
    head = meta.select("doc_id").distinct().select("doc_id", F.lit(0).alias("r"), F.posexplode(F.array(*map(F.lit, names))).alias("c", "text"))
    return head.unionByName(each).select("doc_id", F.lit("_meta").alias("name"), "r", "c", F.coalesce("text", F.lit("")).alias("text"))


def checked(sheets: DataFrame) -> DataFrame:
    """Sheets with safe names; two sheets of one workbook with the same safe name raise an error."""
    named = sheets.withColumn("name", identity.safe_name(F.col("sheet")))
    same = F.size(F.collect_set("sheet").over(Window.partitionBy("doc_id", "name")))
    return named.withColumn("name", F.when(same > 1, F.raise_error(F.concat(F.lit("sheet name used twice: "), "name"))).otherwise(F.col("name")))


def whole(result: boreholes.Result) -> DataFrame:
    """(doc_id, sheet, kind, r, c, rs, cs, text, fill, upright) of every sheet of a run: tables with headers, labels and blank rows, and forms."""
    spark = result.cells.sparkSession
    key = F.concat_ws("\u0001", F.col("doc_id").cast("string"), "sheet")  # sheets of two documents may have one name
    back = lambda df: df.select(F.split_part("sheet", F.lit("\u0001"), F.lit(1)).alias("doc_id"), F.split_part("sheet", F.lit("\u0001"), F.lit(2)).alias("sheet"), "kind", "r", "c", "rs", "cs", "text", "fill", "upright")
    cells = result.cells.select(key.alias("sheet"), "kind", "r", "c", F.col("grid_text").alias("text"), "conf", "expanded")
    tables_ = result.tables.select(key.alias("sheet"), "kind", "n_rows")
    forms = result.fields.select(key.alias("sheet"), "kind", "ord", "key", "value", "source", "needs_review")
    return back(sheet_cells(cells, header_cells(spark), tables_)).unionByName(back(form_cells(forms)))


def write_result(result: boreholes.Result, path: str) -> None:
    """The parts of a run as Parquet, and from them its whole sheets; sheets of one document with one safe name raise an error before anything of them is written."""
    at = whole(result.stored(path))
    names = checked(at.select("doc_id", "sheet").distinct())
    at.join(names, ["doc_id", "sheet"]).write.mode("overwrite").parquet(f"{path}/sheets")


def write_json(cells: DataFrame, meta: DataFrame, path: str) -> None:
    """cells and meta of each document as JSON lines, one folder a document."""
    cells.write.mode("overwrite").partitionBy("doc_id").json(f"{path}/cells")
    meta.write.mode("overwrite").partitionBy("doc_id").json(f"{path}/meta")


def column_name(c: int) -> str:
    out = ""
    c += 1
    while c:
        c, r = divmod(c - 1, 26)
        out = chr(65 + r) + out
    return out


def workbook(sheets: list[tuple[str, list[tuple]]]) -> bytes:
    """A workbook of (name, [(r, c, rs, cs, text, fill[, upright])]), all text, with nothing but the standard library."""
    out = io.BytesIO()
    main, rel, pack = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships", "http://schemas.openxmlformats.org/package/2006"
    styles = {name: i + 1 for i, name in enumerate(FILLS)}
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:

        def put(name: str, body: str) -> None:
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), '<?xml version="1.0" encoding="UTF-8"?>' + body)

        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i + 1}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(len(sheets)))
        put("[Content_Types].xml", f'<Types xmlns="{pack}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/>{kinds}</Types>')
        put("_rels/.rels", f'<Relationships xmlns="{pack}/relationships"><Relationship Id="r" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        names = "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{i + 1}" r:id="s{i + 1}"/>' for i, (n, _) in enumerate(sheets))
        put("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>{names}</sheets></workbook>')
        links = "".join(f'<Relationship Id="s{i + 1}" Type="{rel}/worksheet" Target="worksheets/sheet{i + 1}.xml"/>' for i in range(len(sheets)))
        put("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{pack}/relationships">{links}<Relationship Id="st" Type="{rel}/styles" Target="styles.xml"/></Relationships>')
        fills = "".join(f'<fill><patternFill patternType="solid"><fgColor rgb="{c}"/></patternFill></fill>' for c in FILLS.values())
        xfs = '<xf numFmtId="0" fontId="0" fillId="0" borderId="0"/>' + "".join(f'<xf numFmtId="0" fontId="0" fillId="{i + 2}" borderId="0" applyFill="1"/>' for i in range(len(FILLS)))
        xfs += '<xf numFmtId="0" fontId="0" fillId="0" borderId="0" applyAlignment="1"><alignment textRotation="90" wrapText="1"/></xf>'
        put("xl/styles.xml", f'<styleSheet xmlns="{main}"><fonts count="1"><font/></fonts><fills count="{len(FILLS) + 2}"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill>{fills}</fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="{len(FILLS) + 2}">{xfs}</cellXfs></styleSheet>')
        for i, (_, cells) in enumerate(sheets):
            rows: dict[int, list[str]] = {}
            for r, c, _, _, text, fill, *upright in sorted(cells, key=lambda x: x[:2]):
                number = styles.get(fill) or (len(FILLS) + 1 if any(upright) else 0)
                style = f' s="{number}"' if number else ""
                rows.setdefault(r, []).append(f'<c r="{column_name(c)}{r + 1}"{style} t="inlineStr"><is><t xml:space="preserve">{escape(text or "")}</t></is></c>')
            body = "".join(f'<row r="{r + 1}">{"".join(cs)}</row>' for r, cs in sorted(rows.items()))
            merges = [f"{column_name(c)}{r + 1}:{column_name(c + cs - 1)}{r + rs}" for r, c, rs, cs, *_ in cells if rs > 1 or cs > 1]
            merged = f'<mergeCells count="{len(merges)}">{"".join(f"<mergeCell ref={chr(34)}{m}{chr(34)}/>" for m in merges)}</mergeCells>' if merges else ""
            put(f"xl/worksheets/sheet{i + 1}.xml", f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData>{merged}</worksheet>')
    return out.getvalue()


def workbooks(cells: DataFrame) -> DataFrame:
    """(doc_id, content): a workbook of each document's checked sheets (doc_id, name, r, c, rs, cs, text, fill).

    A document is one borehole file of some thousand cells, so it is a group in pandas.
    """

    columns = ["r", "c", "rs", "cs", "text", "fill", *(["upright"] if "upright" in cells.columns else [])]

    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        sheets = [(n, list(g[columns].itertuples(index=False, name=None))) for n, g in pdf.groupby("name", sort=True)]
        return pd.DataFrame({"doc_id": [pdf["doc_id"].iloc[0]], "content": [workbook(sheets)]})

    return cells.groupBy("doc_id").applyInPandas(make, "doc_id string, content binary")
