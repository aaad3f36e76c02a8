from __future__ import annotations

import io
import zipfile

import pytest

from gridloom.operators import cache
from gridloom.sinks import sheets
from gridloom.sources import pages, recognisers, settings


def test_sheet_cells(spark):
    rows = [("s", "kontrol", 0, 0, "12 мая", None), ("s", "kontrol", 1, 0, "1", 0.5), ("s", "kontrol", 1, 1, "-ll-", None), ("t", "journal_left", 0, 0, "1", 0.9)]
    df = spark.createDataFrame(rows, "sheet string, kind string, r int, c int, text string, conf double")
    got = {(r["sheet"], r["r"], r["c"]): (r["text"], r["fill"]) for r in sheets.sheet_cells(df, sheets.header_cells(spark)).collect()}
    assert got["s", 1, 0] == ("1", "orange") and got["s", 1, 1] == ("-ll-", "yellow")  # the row that looks like a header went
    assert got["s", 0, 0] == ("Дата контроля", None)
    assert got["t", 2, 0] == ("1", None) and got["t", 3, 0] == ("1", None)  # column numbers, then data


def test_workbook(spark):
    z = zipfile.ZipFile(io.BytesIO(sheets.workbook([("a&b", [(0, 0, 1, 2, "x < y", None), (1, 27, 1, 1, "z", "yellow")])])))
    body = z.read("xl/worksheets/sheet1.xml").decode()
    assert 'mergeCell ref="A1:B1"' in body and 'r="AB2" s="2"' in body and "x &lt; y" in body and "a&amp;b" in z.read("xl/workbook.xml").decode()
    z = zipfile.ZipFile(io.BytesIO(sheets.workbook([("n", [(0, 0, 2, 1, "up", None, True), (0, 1, 1, 1, "flat", None, False), (0, 2, 1, 1, "bad", "orange", True)])])))
    body, styles = z.read("xl/worksheets/sheet1.xml").decode(), z.read("xl/styles.xml").decode()
    assert f'r="A1" s="{len(sheets.FILLS) + 1}"' in body and 'r="B1" t=' in body and 'r="C1" s="1"' in body and styles.count("textRotation") == 1
    df = spark.createDataFrame([("d", "n", 0, 0, 1, 1, "t", None), ("e", "n", 0, 0, 1, 1, "t", None)], "doc_id string, name string, r int, c int, rs int, cs int, text string, fill string")
    assert sheets.workbooks(df).count() == 2


def test_names_used_twice_are_refused(spark):
    df = spark.createDataFrame([("d", "a/b"), ("d", "a:b")], "doc_id string, sheet string")
    with pytest.raises(Exception, match="used twice"):
        sheets.checked(df).collect()
    assert sheets.checked(df.where("sheet = 'a/b'")).first()["name"] == "a_b"


def test_pages_and_renderer(spark, tmp_path):
    for n in ("a.pdf", "b.PDF", "c.txt"):
        (tmp_path / n).write_bytes(n.encode() * 3)
    listed = pages.files(spark, str(tmp_path))
    from pyspark.sql import functions as F

    wanted = pages.pages(listed, F.lit(3), only=[0, 2])
    assert wanted.count() == 4
    got = pages.rendered(spark, listed, wanted, lambda content, page, dpi: (content[:1], page, dpi)).collect()
    assert sorted((bytes(r["image"]), r["height"], r["width"]) for r in got) == [(b"a", 0, 300), (b"a", 2, 300), (b"b", 0, 300), (b"b", 2, 300)]


def test_recogniser(spark):
    q = spark.createDataFrame([("a", b"1"), ("b", b"2"), ("b", b"2"), ("c", b"3")], "key string, image binary")
    known = spark.createDataFrame([("a", "old")], "key string, reply string")

    def call(image):
        if image == b"3":
            raise recognisers.Refused(400)
        return image.decode()

    found, fresh = recognisers.recognise(q, known, call)
    assert sorted((r["key"], r["reply"]) for r in found.collect()) == [("a", "old"), ("b", "2"), ("b", "2"), ("c", None)]
    assert [r["key"] for r in fresh.collect()] == ["b"] and cache.misses(q, known).count() == 2
    assert tuple(recognisers.counters(found, known).first()) == (4, 1, 3, 1)


def test_retries():
    calls, slept = [], []

    def call(image):
        calls.append(1)
        raise recognisers.Refused(503)

    assert recognisers.with_retries(call, 3, 2, 3, slept.append)(b"") is None
    assert len(calls) == 3 and slept == [1, 2, 3]


def test_settings(tmp_path, monkeypatch):
    (tmp_path / "s.yaml").write_text("a:\n  b: 1\n  p: x/y\n")
    s = settings.load(str(tmp_path / "s.yaml"))
    assert s.at("a.b") == 1 and s.at("a.z", 5) == 5 and str(s.path("a.p", "/r")) == "/r/x/y"
    with pytest.raises(KeyError):
        s.path("no")
    monkeypatch.setenv("KEY_TWO", "v")
    assert settings.secret("KEY_ONE", "KEY_TWO") == "v" and settings.secret("KEY_ONE") is None
