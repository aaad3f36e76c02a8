"""Page files as a source, workbooks as a sink, and calls in flight."""

from __future__ import annotations

import asyncio
import os
import re
import time
import zipfile
from io import BytesIO
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from gridloom.sinks import sheets, workbook_files
from gridloom.sources import pagefiles, pages, recognisers


def page_tree(n: int, inner: int = 0) -> bytes:
    tree = f"1 0 obj << /Type /Pages /Kids [] /Count {n} >> endobj " + (f"<< /Count {inner} /Type /Pages >>" if inner else "")
    return b"A%PDF-1.4 \xff\xfe " + tree.encode() + b" << /Type /Page >>"


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    for name, content in (("a.pdf", page_tree(3, 2)), ("deep/b.PDF", page_tree(2)), ("c.txt", page_tree(9)), ("d.pdf", page_tree(7))):
        (tmp_path / "in" / name).write_bytes(content)
    return str(tmp_path / "in")


def test_each_page_is_a_partition(spark, folder):
    df = pagefiles.read(spark, folder, renderer="tests.page_renderer:render")
    assert df.rdd.getNumPartitions() == 12
    got = {(Path(r["path"]).name, r["page"]): (bytes(r["image"]), r["height"], r["width"]) for r in df.collect()}
    assert set(got) == {("a.pdf", i) for i in range(3)} | {("b.PDF", i) for i in range(2)} | {("d.pdf", i) for i in range(7)}
    assert got["a.pdf", 2] == (b"A" * 6, 2, 3)


def test_filters_reach_the_listing(spark, folder):
    df = pagefiles.read(spark, folder, renderer="none")
    first = df.where("page < 2 and page >= 0")
    assert first.rdd.getNumPartitions() == 6 and {r["page"] for r in first.collect()} == {0, 1}
    one = df.where((F.col("path") == f"{folder}/d.pdf") & F.col("page").isin(1, 5, 99))
    assert one.rdd.getNumPartitions() == 2 and sorted(r["page"] for r in one.collect()) == [1, 5]
    odd = df.where("page % 2 = 1 and page > 3")  # Spark keeps what the source doesn't take
    assert sorted(r["page"] for r in odd.collect()) == [5]
    assert df.where("page = 50").collect() == []


def test_an_index_spares_the_driver_the_files(spark, folder, tmp_path, monkeypatch):
    pagefiles.write_index(spark, folder, str(tmp_path / "index"))
    df = pagefiles.read(spark, folder, renderer="tests.page_renderer:render", index=str(tmp_path / "index")).where("page < 1")
    assert sorted((Path(r["path"]).name, bytes(r["image"])) for r in df.collect()) == [(n, b"AA") for n in ("a.pdf", "b.PDF", "d.pdf")]
    reader = pagefiles.PageReader({"path": folder, "index": str(tmp_path / "index")})
    monkeypatch.setattr(pagefiles, "content_of", None)
    assert len(reader.partitions()) == 12


def test_files_without_a_count(spark, folder):
    Path(folder, "e.pdf").write_bytes(b"%PDF compressed")
    with pytest.raises(Exception, match=r"no page count in .*e\.pdf"):
        pagefiles.read(spark, folder, renderer="none").count()
    assert pagefiles.read(spark, folder, renderer="none", unknown="skip").count() == 12
    listed = pages.files(spark, folder)
    found = pages.pages(listed, pages.page_count(F.col("content")))
    assert found.where("page < 0").count() == 0 and found.where("endswith(path, 'e.pdf')").count() == 0
    listed = spark.createDataFrame([("x", 0), ("y", None), ("z", 2)], "path string, n int")
    assert [tuple(r) for r in pages.pages(listed, F.col("n")).collect()] == [("z", 0), ("z", 1)]


def test_rendering_by_a_program(spark, folder, tmp_path, monkeypatch):
    """A stand-in for pdftoppm and pdfinfo on the path: what they are asked, and what is made of their answers."""
    (tmp_path / "bin").mkdir()
    for name, body in (("pdftoppm", "cat > /dev/null; printf 'P5\\n2 3\\n255\\n'; printf \"$5$7$3$1$2$8\" | head -c 6"), ("pdfinfo", "cat > /dev/null; echo 'Title: x'; echo 'Pages:          4'")):
        (tmp_path / "bin" / name).write_text(f"#!/bin/sh\n{body}\n")
        (tmp_path / "bin" / name).chmod(0o755)
    monkeypatch.setenv("PATH", f"{tmp_path}/bin{os.pathsep}{os.environ['PATH']}")
    assert pagefiles.pages_of(b"%PDF compressed") == 4 and pagefiles.pages_of(page_tree(5, 9)) == 9
    image, height, width = pagefiles.poppler(b"%PDF", 6, 150)
    assert (height, width) == (3, 2) and image == b"77150-"


def books(spark, rows):
    return spark.createDataFrame(rows, "name string, content binary").repartition(3)


def test_two_runs_leave_two_files(spark, tmp_path):
    out = tmp_path / "out"
    made = sheets.workbooks(spark.createDataFrame([("d1", "s", 0, 0, 1, 1, "x", None), ("d2", "s", 0, 0, 1, 2, "y", None)], "doc_id string, name string, r int, c int, rs int, cs int, text string, fill string")).withColumnRenamed("doc_id", "name")
    workbook_files.write(made, str(out))
    first = {p.name: p.read_bytes() for p in out.iterdir()}
    assert set(first) == {"d1.xlsx", "d2.xlsx"} and "xl/workbook.xml" in zipfile.ZipFile(BytesIO(first["d1.xlsx"])).namelist()
    (out / "d1.xlsx").chmod(0o444)
    for _ in range(2):
        workbook_files.write(made, str(out))
    names = sorted(p.name for p in out.iterdir())
    assert len(names) == 6 and all(re.fullmatch(r"d[12](_\d{6}(_[0-9a-f]{6})?)?\.xlsx", n) for n in names)
    assert {n: (out / n).read_bytes() for n in first} == first


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    out = tmp_path / "out"
    bad = books(spark, [(f"n{i}", b"x") for i in range(20)]).withColumn("content", F.when(F.col("name") == "n13", F.raise_error(F.lit("no content")).cast("binary")).otherwise(F.col("content")))
    with pytest.raises(Exception, match="no content"):
        workbook_files.write(bad, str(out))
    assert not out.exists() or list(out.iterdir()) == []
    workbook_files.write(books(spark, [("a/b", b"1"), ("a:b", b"2"), (None, None), ("", b"")]), f"file://{out}")
    assert sum(p.stat().st_size for p in out.iterdir()) == 2 and len(list(out.iterdir())) == 4 and (out / "_.xlsx").exists()


class Service:
    """Counts the calls that are open."""

    def __init__(self, statuses=()):
        self.open = self.most = 0
        self.begun: list[float] = []
        self.statuses = list(statuses)

    async def __call__(self, image: bytes) -> str:
        self.open += 1
        self.most = max(self.most, self.open)
        self.begun.append(time.monotonic())
        try:
            await asyncio.sleep(0.02)
            if self.statuses:
                raise recognisers.Refused(self.statuses.pop(0))
            return image.decode().upper()
        finally:
            self.open -= 1


def test_calls_in_flight_are_bounded():
    s = Service()
    got = asyncio.run(recognisers.in_flight([b"x%d" % i for i in range(40)], s, 8, recognisers.Pace(None)))
    assert got == [f"X{i}" for i in range(40)] and s.most == 8
    paced = Service()
    asyncio.run(recognisers.in_flight([b"x"] * 12, paced, 8, recognisers.Pace(100)))
    gaps = [b - a for a, b in zip(paced.begun, paced.begun[1:])]
    assert paced.begun[-1] - paced.begun[0] >= 0.1 and min(gaps) > 0.005


def test_retries_by_status_in_flight():
    waited: list[float] = []

    async def sleep(t: float) -> None:
        waited.append(t)

    s = Service([429, 503, 400])
    assert asyncio.run(recognisers.in_flight([b"a"], s, 1, recognisers.Pace(None), sleep=sleep)) == [None]
    assert waited == [1.0, 2.0] and len(s.begun) == 3
    assert asyncio.run(recognisers.in_flight([b"a"], Service([500] * 9), 1, recognisers.Pace(None), tries=3, sleep=sleep)) == [None]


async def reply(image: bytes) -> str:
    if image == b"no":
        raise recognisers.Refused(404)
    await asyncio.sleep(0.2)
    return image.decode()[::-1]


def test_recognise_with_calls_in_flight(spark):
    requests = spark.createDataFrame([(f"k{i}", b"im%d" % i) for i in range(30)] + [("bad", b"no")], "key string, image binary").coalesce(1)
    known = spark.createDataFrame([("k0", "old")], "key string, reply string")
    began = time.time()
    results, fresh = recognisers.recognise(requests, known, reply, most=30)
    got = {r["key"]: r["reply"] for r in results.collect()}
    assert got["k0"] == "old" and got["k7"] == "7mi" and got["bad"] is None and fresh.count() == 29 and time.time() - began < 12
