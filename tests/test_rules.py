"""Runs, rules and regions against the image kernels in numpy."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import images, rules

W, H = 150, 21


@pytest.fixture(scope="module")
def masks():
    rng = np.random.default_rng(3)
    out = [rng.random((H, W)) < share for share in (0.05, 0.3, 0.5, 0.75)] + [np.zeros((H, W), bool), np.ones((H, W), bool)]
    comb = np.zeros((H, W), bool)  # a snake: each line hangs together with the next at one end only
    comb[::2] = True
    comb[1::4, -1] = comb[3::4, 0] = True
    return [*out, comb]


@pytest.fixture(scope="module")
def tiles(spark, masks):
    rows = [(i, [int(not v) * 200 for v in m.ravel()]) for i, m in enumerate(masks)] + [(99, []), (98, None)]
    return spark.createDataFrame(rows, "image int, tile array<int>")


def found(tiles):
    return rules.runs(tiles, ["image"], F.col("tile"), W, lambda v: v < 100)


def painted(df, masks, turn=False):
    out = [np.zeros((W, H) if turn else (H, W), bool) for _ in masks]
    for r in df.collect():
        assert r["start"] < r["end"] and not out[r["image"]][r["line"], r["start"] : r["end"]].any()
        out[r["image"]][r["line"], r["start"] : r["end"]] = True
    return [m.T if turn else m for m in out]


def same(a, b):
    assert len(a) == len(b) and all((x == y).all() for x, y in zip(a, b))


def test_runs_and_turned(tiles, masks):
    same(painted(found(tiles), masks), masks)
    by_column = rules.runs(tiles, ["image"], rules.turned(F.col("tile"), H, W), H, lambda v: v < 100)
    same(painted(by_column.where("image < 98"), masks, True), masks)
    same(painted(rules.across(found(tiles), ["image"]), masks, True), masks)


@pytest.mark.parametrize("n", [1, 3, 7, 25])
def test_opened_closed_grown(tiles, masks, n):
    f = found(tiles)
    same(painted(rules.opened(f, n, W), masks), [images.opened(m, n, 1) for m in masks])
    same(painted(rules.closed(f, ["image"], n, W), masks), [images.closed(m, n, 1) for m in masks])
    same(painted(rules.grown(f, ["image"], n, W), masks), [images.dilate(m, n, 1) for m in masks])


@pytest.mark.parametrize("gap", [1, 2, 6])
def test_lines(tiles, masks, gap):
    got = rules.lines(found(tiles), ["image"], 0.5 * W, gap).orderBy("image", "i").collect()
    for i, m in enumerate(masks):
        assert [r["middle"] for r in got if r["image"] == i] == images.line_places(m.sum(axis=1), 0.5 * W, gap)
        assert [r["i"] for r in got if r["image"] == i] == list(range(sum(r["image"] == i for r in got)))


def test_regions_in_order(tiles, masks):
    got = rules.regions(found(tiles), ["image"]).orderBy("image", "i").collect()
    for i, m in enumerate(masks):
        mine = [(r["x"], r["y"], r["w"], r["h"]) for r in got if r["image"] == i]
        assert sorted(mine) == sorted(map(tuple, images.components(m).tolist()))
        assert [(y, x) for x, y, _, _ in mine] == sorted((y, x) for x, y, _, _ in mine)
        assert sum(r["pixels"] for r in got if r["image"] == i) == m.sum()
    assert [r["image"] for r in got if r["image"] == 6] == [6]


def test_no_images(spark):
    empty = spark.createDataFrame([], "image int, tile array<int>")
    assert rules.regions(found(empty), ["image"]).collect() == [] == rules.lines(found(empty), ["image"], 1, 6).collect()
