"""Whole files, their sheets and their scores, on a file written by hand."""

from __future__ import annotations

import dataclasses
import json

import pytest
from pyspark.sql import functions as F

from gridloom import cli
from gridloom.operators import identity, score, tables
from gridloom.plans import boreholes, process, specs
from gridloom.sinks import sheets
from gridloom.streaming import boreholes as arriving

OBJECTS = [
    ("d", 0, "L", "form_act", 0, 100, 800, 600), ("d", 0, "R", "form_journal", 0, 0, 800, 500), ("d", 0, "R", "podschet", 0, 500, 1000, 1900), ("d", 1, "L", "journal_left", 10, 20, 1010, 1420),
    ("d", 1, "R", "unknown", 0, 0, 9, 9), ("d", 2, "R", "form_journal", 0, 0, 800, 500), ("d", 3, "L", "kontrol", 0, 0, 540, 600),
]


@pytest.fixture(scope="module")
def file(spark):
    objects = spark.createDataFrame([(*o, 3) for o in OBJECTS], "doc_id string, page int, side string, kind string, x0 int, y0 int, x1 int, y1 int, ruled_rows int")
    pages = spark.createDataFrame([("d", i) for i in range(4)] + [("e", 0)], "doc_id string, page int")
    at = {0: 20, 1: 80, 4: 400, 6: 830}
    rows = [(0, 4, "описание"), (1, 0, "1"), (1, 1, "2,5"), (1, 4, "глина"), (2, 0, "2"), (2, 4, "-//-"), (2, 6, "IV"), (3, 0, "мастер")]
    words = [("d/1/L/journal_left", i, at[c] - 5, 100 * r + i % 3, at[c] + 5, 100 * r + i % 3 + 10, t, 0.8) for i, (r, c, t) in enumerate(rows)]
    words += [("d/0/R/podschet", i, 90, 400 + 250 * i + 15, 110, 400 + 250 * i + 25, "метка", 0.9) for i in range(5)] + [("d/0/R/podschet", 9, 475, 420, 485, 430, "4,5 м", 0.9)]
    words = spark.createDataFrame(words, "table_id string, word_id long, x0 int, y0 int, x1 int, y1 int, text string, conf double")
    grid = json.dumps({"rows": [["1", "2,5", "", "", "Глина."], "2"], "low_conf": []})
    act, journal = json.dumps({"fields": {"Скважина №": "нет"}}), json.dumps({"fields": {"4. Скважина №": "№ 7", "Отряд": "5"}, "low_conf": ["Отряд"]})
    replies = spark.createDataFrame([("d/1/L/journal_left", f"```json\n{grid}\n```"), ("d/0/L/form_act", act), ("d/0/R/form_journal", f"Here: {journal}"), ("d/2/R/form_journal", "no json")], "table_id string, reply string")
    return pages, objects, words, replies


@pytest.fixture(scope="module")
def result(file, tmp_path_factory):
    pages, objects, words, replies = file
    return boreholes.run(pages, objects, words, *boreholes.from_replies(boreholes.routed(objects), replies)).stored(str(tmp_path_factory.mktemp("run")))


def test_cells_of_all_kinds(result):
    got = {(r["sheet"], r["r"], r["c"]): (r["text"], r["source"], r["needs_review"], r["expanded"]) for r in result.cells.collect()}
    assert got == {
        ("скв1_гр1-8", 0, 0): ("1", "hybrid", False, False), ("скв1_гр1-8", 0, 1): ("2,5", "hybrid", False, False), ("скв1_гр1-8", 0, 4): ("Глина.", "hybrid", False, False),
        ("скв1_гр1-8", 1, 0): ("2", "hybrid", False, False), ("скв1_гр1-8", 1, 4): ("-ll-", "reader", False, True), ("скв1_гр1-8", 1, 6): ("IV", "reader", False, False), ("скв1_подсчёт", 0, 2): ("4,5", "reader", False, False),
    }
    box = result.cells.where("sheet = 'скв1_гр1-8' and r = 0 and c = 1").first()["box"]
    assert (box["x0"], box["x1"]) == (59, 135) and box["y1"] - box["y0"] in (91, 92, 93)  # on the page; 0.46 of the pitch up and down


def test_boreholes_and_reports(result):
    b = {(r["doc_id"], r["hole"]): r.asDict() for r in result.boreholes.collect()}
    assert (b["d", 1]["hint"], b["d", 1]["mismatch"], b["d", 1]["n_objects"], b["d", 1]["first_page"], b["d", 1]["last_page"]) == ("7", True, 4, 1, 2)
    assert (b["d", 2]["hint"], b["d", 2]["mismatch"], b["d", 2]["n_objects"]) == ("1", True, 2)  # no form can be read: the hint is 1
    assert b["e", 1]["n_objects"] == 0 and not b["e", 1]["mismatch"]
    t = {r["sheet"]: r.asDict() for r in result.tables.collect()}
    assert (t["скв1_гр1-8"]["n_rows"], t["скв1_подсчёт"]["n_rows"], t["скв2_контроль"]["n_rows"]) == (2, 5, 0) and t["скв1_подсчёт"]["mismatch"] and not t["скв1_гр1-8"]["mismatch"]
    d = {r["doc_id"]: r.asDict() for r in result.documents.collect()}
    assert d["d"]["n_boreholes"] == 2 and d["d"]["n_sheets"] == 6 and d["d"]["n_mismatch"] == 2 and d["e"]["n_cells"] == 0


def test_forms_and_meta(result, file):
    f = {(r["sheet"], r["key"]): (r["value"], r["needs_review"]) for r in result.fields.collect()}
    assert f["скв1_титул", "Отряд"] == ("5", True) and f["скв1_титул", specs.HINT_FIELD] == ("7", True) and f["скв1_титул", "Операция"] == ("", False)
    assert sum(k[0] == "скв1_акт" for k in f) == len(specs.ACT_FIELDS) and sum(k[0] == "скв1_титул" for k in f) == len(specs.JOURNAL_FIELDS) + 1
    meta = result.meta.collect()
    assert {r["text"] for r in meta if r["obj_type"] == "borehole_id" and r["doc_id"] == "d"} == {"pos_N=1", "pos_N=2"}
    assert all(json.loads(r["bbox"]) for r in meta if r["obj_type"] == "journal_left")
    pages, objects, words, replies = file
    raw = objects.sparkSession.createDataFrame([("d/0/R/form_journal", "строка")], "table_id string, text string")
    alone = boreholes.run(pages, objects, words, *boreholes.from_replies(boreholes.routed(objects), replies), engine="reader", raw=raw)
    got = {(r["sheet"], r["key"]): (r["value"], r["source"]) for r in alone.fields.collect()}
    assert got["скв1_титул", specs.RAW_FIELD] == ("строка", "reader") and got["скв1_акт", specs.RAW_FIELD] == ("", "reader") and got["скв1_титул", specs.HINT_FIELD][0] == "7"
    assert {r["source"] for r in alone.cells.collect()} == {"reader"}
    by_place = boreholes.run(pages, objects, words, *boreholes.from_replies(boreholes.routed(objects), replies), engine="layout", extract_forms=False)
    assert {(r["r"], r["c"], r["text"]) for r in by_place.cells.collect()} == {(0, 0, "1"), (0, 1, "2,5"), (0, 4, "Глина."), (1, 0, "2")} and by_place.fields.count() == 0


def test_numbers_by_list(spark):
    pages = spark.createDataFrame([("a", i) for i in range(4)] + [("b", 0)], "doc_id string, page int")
    lists = spark.createDataFrame([("a", [31, 32])], "doc_id string, numbers array<int>")
    got = {(r["doc_id"], r["page"]): r["hole"] for r in identity.spreads(pages, ["doc_id"], "page", lists).collect()}
    assert got == {("a", 0): 31, ("a", 1): 31, ("a", 2): 32, ("a", 3): 32, ("b", 0): 1}
    some = pages.where("page >= 2")
    assert identity.spreads(some, ["doc_id"], "page", [31, 32], subset=True).first()["hole"] == 32
    assert identity.spreads(some, ["doc_id"], "page", [31], subset=True).first()["hole"] == 2
    with pytest.raises(Exception, match="2 spreads but 3 numbers"):
        identity.spreads(pages.where("doc_id = 'a'"), ["doc_id"], "page", [1, 2, 3]).collect()


def test_rows_without_words_count(spark):
    """A row of which no word is in a column is a row; a row of header words is not; a footer ends the table."""
    at = [("1", 20, 0), ("x", 20, 60), ("far", 5000, 120), ("разрез", 400, 180), ("2", 20, 240), ("геолог", 400, 300), ("3", 20, 360)]
    words = spark.createDataFrame([("t", "journal_left", 1000.0, 1400.0, i, float(x), float(x), float(y), w, 0.5) for i, (w, x, y) in enumerate(at)], "table_id string, kind string, width double, height double, word_id long, x0 double, cx double, y double, text string, conf double")
    found = tables.place(words)
    assert [(r["r"], r["cy"]) for r in found.rows.orderBy("r").collect()] == [(0, 0.0), (1, 60.0), (2, 120.0), (3, 240.0)]
    assert {(r["r"], r["c"], r["y"]) for r in found.slots.collect()} == {(0, 0, "1"), (1, 0, "x"), (3, 0, "2")}


def test_second_readings(spark):
    own = spark.createDataFrame([("t", "sampling_right", 1000.0, 600.0, 0, 0)], "table_id string, kind string, width double, height double, x0 int, y0 int")
    words = spark.createDataFrame([("t", "sampling_right", 1000.0, 600.0, i, 10.0, 10.0, 100.0 * i, str(i), 0.5) for i in range(3)], "table_id string, kind string, width double, height double, word_id long, x0 double, cx double, y double, text string, conf double")
    grid = spark.createDataFrame([], "table_id string, r int, c int, q string")
    ink = spark.createDataFrame([("t", r, c) for r in range(3) for c in (0, 2, 7)], "table_id string, r int, c int")
    again = spark.createDataFrame([("t", 0, 2, " H3 ", 0.4), ("t", 1, 2, "-//-", None), ("t", 2, 7, "  ", 0.9), ("t", 0, 3, "no", 0.9), ("t", 1, 9, "no ink", 0.9)], "table_id string, r int, c int, text string, conf double")
    got = {(r["r"], r["c"]): (r["text"], r["source"], r["needs_review"]) for r in tables.recognise(words, own, grid, ink=ink, retries=again).where("c > 0").collect()}
    assert got == {(0, 2): ("нз", "reader_retry", False), (1, 2): ("-ll-", "reader_retry", True)}
    crops = spark.createDataFrame([("t", 0, 0, "9", 0.7), ("t", 1, 0, " ", 0.1)], "table_id string, r int, c int, text string, conf double")
    read = {r["r"]: (r["text"], r["conf"]) for r in tables.recognise(words, own, grid, ink=ink, crops=crops).where("c = 0").collect()}
    assert read == {0: ("9", 0.7), 1: ("1", 0.5), 2: ("2", 0.5)}


def test_whole_sheets(result):
    got = {(r["sheet"], r["r"], r["c"]): r for r in sheets.whole(result).where("doc_id = 'd'").collect()}
    p = lambda r, c: got["скв1_подсчёт", r, c]["text"]
    assert (p(0, 0), p(1, 0), p(2, 0), p(2, 1), p(2, 2), p(2, 3)) == (specs.TITLES["podschet"], "Наименование показателей", "Глубина выемки", "м", "4,5", "")
    assert got["скв1_подсчёт", 0, 4]["rs"] == 7 and ("скв1_подсчёт", 3, 4) not in got and got["скв1_подсчёт", 2, 0]["fill"] == "label"
    rows = {k[1] for k in got if k[0] == "скв1_гр1-8"}
    assert rows == set(range(7)) and got["скв1_гр1-8", 3, 4]["text"] == "Глина." and got["скв1_гр1-8", 6, 0]["text"] == ""  # two rows of header, numbers, two of data, two blank
    assert got["скв1_гр1-8", 4, 4]["fill"] == "yellow" and got["скв1_титул", 0, 0]["text"] == specs.FORM_TITLES["form_journal"]
    assert [got["скв1_титул", 2, c]["text"] for c in range(3)] == list(specs.FORM_HEADER) and got["скв1_титул", 3, 1]["fill"] == "review" and got["скв1_титул", 3, 2]["text"] == "layout"
    m = {(r["sheet"], r["item"]) for r in sheets.merges(sheets.whole(result)).collect()}
    assert {i for s, i in m if s == "скв1_подсчёт"} == {"B1:D1", "E1:E7"} and ("скв1_гр1-8", "B1:C1") in m and ("скв1_гр1-8", "A1:A2") in m
    meta = {(r["r"], r["c"]): r["text"] for r in sheets.meta_cells(result.meta).where("doc_id = 'd'").collect()}
    assert meta[0, 0] == "sheet" and len({r for r, _ in meta}) == result.meta.where("doc_id = 'd'").count() + 1


def test_sheets_of_an_unknown_kind(spark):
    cells = spark.createDataFrame([("s", "other", 0, 0, "a", 0.1), ("s", "other", 1, 2, "b", None)], "sheet string, kind string, r int, c int, text string, conf double")
    for every in (None, spark.createDataFrame([("s", "other", 2)], "sheet string, kind string, n_rows int")):
        assert {(r["r"], r["c"], r["text"], r["fill"]) for r in sheets.sheet_cells(cells, sheets.header_cells(spark), every).collect()} == {(0, 0, "a", None), (1, 2, "b", None)}


def test_files_and_score_commands(spark, file, tmp_path, capsys):
    for name, df in zip(("pages", "objects", "words", "replies"), file):
        df.write.parquet(str(tmp_path / name))
    out = str(tmp_path / "out")
    cli.main(["files", *[x for n in ("pages", "objects", "words", "replies") for x in (f"--{n}", str(tmp_path / n))], "--out", out])
    assert spark.read.parquet(f"{out}/cells").count() == 7 and "name" in spark.read.parquet(f"{out}/sheets").columns
    cell = lambda t, **k: {"text": t, **k}
    truth = {"borehole": "скв1", "objects": {
        "гр1-8": {"data": [[cell("1"), cell("2.5"), cell("", empty=True), cell("x", graphic=True), cell("глина.")], [cell("2"), cell("нет"), cell(" "), cell(" "), cell("-ll-", ditto=True)]], "merges": ["B1:C1", *[f"{c}1:{c}2" for c in "ADEFGH"]], "graph_numbers": [1, 2, 3, 4, 5, 6, 7, 8]},
        "подсчёт": {"rows": [[cell("Глубина выемки"), cell("м"), cell("4,5")]], "merges": ["B1:D1"], "graph_numbers": [1]}, "контроль": {"data": []}, "титул": {"data": []},
    }}
    (tmp_path / "truth.json").write_text(json.dumps(truth, ensure_ascii=False), encoding="utf-8")
    found = score.report(score.read_truth(spark, str(tmp_path / "truth.json")), spark.read.parquet(f"{out}/cells").withColumn("text", F.col("grid_text")), spark.read.parquet(f"{out}/tables"), sheets.merges(spark.read.parquet(f"{out}/sheets")))
    by = {(r["borehole"], r["kind"]): (r["total"], r["n_strict"], r["n_fuzzy"]) for r in found["accuracy"].collect()}
    assert by["скв1", "journal_left"] == (6, 3, 5) and by["скв1", "podschet"] == (3, 1, 1) and by[None, None] == (9, 4, 6)
    assert {r["fixed"]: (r["total"], r["n_fuzzy"]) for r in found["buckets"].collect() if r["fixed"] is not None} == {False: (6, 5), True: (3, 1)}
    assert {r["kind"]: (r["n_rows"], r["truth_rows"]) for r in found["rows"].collect()} == {"journal_left": (2, 2), "podschet": (5, 1), "kontrol": (0, 0), "титул": (0, 0)}
    assert {r["kind"]: r["same"] for r in found["merges"].collect()} == {"journal_left": True, "podschet": False, "kontrol": True, "титул": True}
    assert {r["kind"]: r["same"] for r in found["numbers"].collect()} == {"journal_left": True, "podschet": False}
    cli.main(["score", "--truth", str(tmp_path / "truth.json"), "--sheets", out, "--out", str(tmp_path / "score")])
    said = capsys.readouterr().out
    assert "text all: strict 4/9=44.4%, fuzzy 6/9=66.7%" in said and "merges: differ in podschet" in said and "rows: journal_left=2/2" in said


def test_prompts():
    assert all(k in process.form_prompt("form_act") for k in specs.ACT_FIELDS) and "low_conf" in process.form_prompt("form_act")


def rows(df):
    return sorted(map(str, (tuple(r[c] for c in sorted(df.columns)) for r in df.collect())))


def arrive(spark, at, spreads, n):
    spark.createDataFrame(spreads, "doc_id string, spread long").coalesce(1).write.mode("append").parquet(f"{at}/in")
    return [spark.readStream.schema("doc_id string, spread long").option("maxFilesPerTrigger", n).parquet(f"{at}/in")]


def test_boreholes_of_a_stopped_run(spark, file, result, tmp_path):
    """A run is stopped in its second batch and goes on; figures come while it runs."""
    pages, objects, *_ = file
    for spreads in ([("d", 0)], [("d", 1), ("d", 0)], [("e", 0)]):
        (stream,) = arrive(spark, tmp_path, spreads, 1)
    calls, told, during = [], [], []

    def stops(pages, objects):
        """The second batch fails once its cells are written."""
        calls.append(1)
        found = dataclasses.replace(result)
        if len(calls) == 2:
            found.meta = found.meta.withColumn("text", F.raise_error(F.lit("stopped here")))
        return found

    listener = arriving.Progress()
    spark.streams.addListener(listener)
    try:
        out, state = str(tmp_path / "out"), str(tmp_path / "state")
        query = arriving.follow(stream, pages, objects, stops, out, state, told.append)
        with pytest.raises(Exception, match="stopped here"):
            query.awaitTermination()
        assert [(f.done, f.total) for f in told] == [(1, 3)] and told[0].counts["cells"] > 0
        half = arriving.finished(spark, out)
        assert {(r["doc_id"], r["spread"]) for r in half.boreholes.collect()} == {("d", 0)}, "what a stopped batch has written doesn't count"
        before = {p: p.stat().st_mtime_ns for p in (tmp_path / "out").rglob("*.parquet") if "batch=0" in str(p)}

        query = arriving.follow(stream, pages, objects, lambda pages, objects: result, out, state, lambda f: (told.append(f), during.append(bool(spark.streams.active))), "arriving_boreholes")
        query.awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    finally:
        spark.streams.removeListener(listener)
    assert [f.done for f in told] == [1, 2, 3] and told[-1].batch == 2 and during == [True, True], "figures come before the run ends"
    assert all(set(f.counts) == {"cells", "tables", "fields", "meta", "boreholes", "review"} for f in told)
    assert listener.spreads["arriving_boreholes"] == 2
    after = arriving.finished(spark, out)
    for part in boreholes.PARTS:
        assert rows(getattr(after, part)) == rows(getattr(result, part)), part
    assert before and all(p.stat().st_mtime_ns == t for p, t in before.items()), "nothing is written twice"
