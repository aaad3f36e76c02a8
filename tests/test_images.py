"""Image kernels on drawn pages, and the objects found on them."""

from __future__ import annotations

import base64
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import images, inventory, kernels
from gridloom.sources import pages


def ruled(height: int, width: int, x0: int, y0: int, x1: int, y1: int, rows: int, columns: int) -> np.ndarray:
    """A light page with a table of so many rows and columns ruled on it."""
    page = np.full((height, width), 225, dtype=np.uint8)
    for y in np.linspace(y0, y1 - 3, rows + 1).astype(int):
        page[y : y + 3, x0:x1] = 40
    for x in np.linspace(x0, x1 - 3, columns + 1).astype(int):
        page[y0:y1, x : x + 3] = 40
    return page


def spread() -> np.ndarray:
    left, right = ruled(900, 700, 40, 60, 660, 860, 12, 8), ruled(900, 700, 30, 80, 670, 850, 12, 10)
    return np.hstack([left, np.full((900, 8), 255, dtype=np.uint8), right])


def test_mean_and_morphology_against_loops():
    rng = np.random.default_rng(1)
    g = rng.integers(0, 256, (23, 31)).astype(np.uint8)
    p = np.pad(g.astype(int), 2, mode="edge")
    want = [[int(np.floor(p[y : y + 5, x : x + 5].mean() + 0.5)) for x in range(31)] for y in range(23)]
    assert (images.box_mean(g, 5) == want).all()
    m = rng.random((20, 30)) < 0.6
    for n in (1, 4, 5):
        grown = [[m[y, max(0, x - n // 2) : x - n // 2 + n].any() if x - n // 2 + n > 0 else False for x in range(30)] for y in range(20)]
        worn = [[m[y, max(0, x - n // 2) : x - n // 2 + n].all() for x in range(30)] for y in range(20)]
        assert (images.dilate(m, n, 1) == grown).all() and (images.erode(m, n, 1) == worn).all()
        assert (images.dilate(m.T, n, 0).T == grown).all()


def test_components_against_flood():
    rng = np.random.default_rng(2)
    for share in (0.1, 0.3, 0.5):
        m = rng.random((40, 50)) < share
        left, want = m.copy(), []
        for y, x in np.argwhere(m):
            if not left[y, x]:
                continue
            todo, seen = [(y, x)], []
            left[y, x] = False
            while todo:
                a, b = todo.pop()
                seen.append((a, b))
                for c in range(max(0, a - 1), min(40, a + 2)):
                    for d in range(max(0, b - 1), min(50, b + 2)):
                        if left[c, d]:
                            left[c, d] = False
                            todo.append((c, d))
            ys, xs = zip(*seen)
            want.append((min(xs), min(ys), max(xs) - min(xs) + 1, max(ys) - min(ys) + 1))
        assert sorted(map(tuple, images.components(m).tolist())) == sorted(map(tuple, np.array(want).tolist()))
    assert len(images.components(np.zeros((3, 3), dtype=bool))) == 0


def test_split_level_and_lines():
    page = spread()
    (a, left), (b, right) = images.split_spread(page)
    assert (a, b) == ("L", "R") and 698 <= left.shape[1] <= 708 and images.split_spread(page[:, :4])[0][0] == "full"
    assert abs(images.level(left)) <= 0.25
    assert abs(images.level(images.rotate(left, 2.0)) + 2.0) <= 0.5 and images.rotate(left, 0.0) is left
    mask, h_lines, v_lines = images.grid_mask(left)
    assert (h_lines, v_lines) == (13, 9) and mask.any()
    assert images.vertical_rules(left[60:860, 40:660]) == 9 and images.vertical_rules(left[:0]) == 0
    assert images.line_places(np.array([0, 5, 5, 0, 0, 0, 0, 0, 0, 5, 0]), 5) == [1, 9]
    clear = images.enhance(left)
    assert clear.shape == left.shape and clear[300, 300] > clear[60, 300]
    assert kernels.otsu(np.array([[10] * 50 + [200] * 50], dtype=np.uint8)) in range(10, 200)
    assert images.to_gray(np.dstack([left] * 3)).tolist() == left.tolist()


def test_encoding(monkeypatch):
    page = spread()
    body = images.png(page)
    at = body.index(b"IDAT") + 4
    rows = np.frombuffer(zlib.decompress(body[at : body.index(b"IEND") - 8]), dtype=np.uint8).reshape(900, -1)
    assert (rows[:, 1:] == page).all() and images.encoded(page) == body
    monkeypatch.setattr(images, "MOST_PIXELS", 100_000)
    monkeypatch.setattr(images, "LONG_EDGE", 300)
    size = lambda b: (int.from_bytes(b[16:20]), int.from_bytes(b[20:24]))
    w, h = size(images.encoded(page))
    assert w * h <= 100_000 and max(size(base64.b64decode(images.base64_png(page)))) <= 300
    assert abs(images.shrunk(page, 0.5).mean() - page.mean()) < 2


def test_inventory_of_images(spark):
    front = np.full((900, 1408), 225, dtype=np.uint8)
    front[:, 704] = 255
    front[100:260, 60:640] = ruled(160, 580, 0, 0, 580, 160, 4, 4)
    rows = [("a.pdf", 0, front.tobytes(), 900, 1408), ("a.pdf", 1, spread().tobytes(), 900, 1408)]
    halves = images.halves(spark.createDataFrame(rows, "path string, page int, image binary, height int, width int"))
    halves.cache()
    objects = inventory.of_halves(halves).collect()
    got = {(r["page"], r["side"], r["kind"]) for r in objects}
    assert got == {(0, "L", "samorodki"), (0, "L", "form_act"), (0, "R", "form_journal"), (0, "R", "podschet"), (1, "L", "journal_left"), (1, "R", "sampling_right"), (1, "R", "pokazateli"), (1, "R", "kontrol")}
    main = next(r for r in objects if r["kind"] == "journal_left")
    assert abs(main["x0"] - 40) < 25 and abs(main["y1"] - 860) <= 40 and main["conf"] == 0.9 and 11 <= main["ruled_rows"] <= 15
    lines = [r["line"] for r in inventory.report(inventory.of_halves(halves)).orderBy("n").collect()]
    assert lines[:5] == ["file: a.pdf", "pages: 2", "objects: 8", "", "by kind:"] and lines[5] == "  form_act         1" and len(lines) == 13
    m = {(r["page"], r["side"]): r for r in inventory.manifest(halves).collect()}
    assert len(m) == 4 and 11 <= m[2, "L"]["h_lines"] <= 15 and m[2, "L"]["enhanced"] == "p02_L_enhanced.png" and abs(m[2, "L"]["deskew_deg"]) <= 0.25
    box = F.struct(F.lit(38).alias("x0"), F.lit(58).alias("y0"), F.lit(80).alias("x1"), F.lit(90).alias("y1"))
    blank = F.struct(F.lit(60).alias("x0"), F.lit(70).alias("y0"), F.lit(90).alias("x1"), F.lit(100).alias("y1"))
    place = spark.createDataFrame([("a.pdf", 1, "L", "t", 0, 0), ("a.pdf", 1, "L", "t", 0, 1)], "path string, page int, side string, table_id string, r int, c int")
    place = place.withColumn("box", F.when(F.col("c") == 0, box).otherwise(blank))
    assert {(r["r"], r["c"]) for r in images.ink(halves, place).collect()} == {(0, 0)}
    halves.unpersist()


@pytest.mark.parametrize(("body", "n"), [(b"<< /Type /Pages /Kids [1 0 R] /Count 22 >> << /Type /Page >>", 22), (b"<< /Count 3 /Type /Pages >> << /Type /Pages /Count 2 >>", 3), (b"", 0)])
def test_page_count(spark, body, n):
    df = spark.createDataFrame([(body,)], "content binary")
    assert df.select(pages.page_count(F.col("content")).alias("n")).first()["n"] == n
