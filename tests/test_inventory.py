"""Regions and main tables whose sides are just the share that the rules ask for, and the queries made of them against their SQL."""

from __future__ import annotations

import duckdb
import pytest

from gridloom.operators import inventory
from gridloom.plans import catalog, catalog_more  # noqa: F401  (it adds to the first)

PAGES = [*range(1048, 1052), *range(4176, 4180)]  # of these, pages 1050 (left) and 4177 (right) have a table of 770 of 1400 lines


def test_sides_of_just_the_share(spark):
    sides = range(100, 3001, 100)
    rows = [(100 * s + i, 0, 0, w, h, s, s, 4) for s in sides for i, (w, h) in enumerate([(s * 2 // 5, s * 11 // 20), (s * 2 // 5, s * 11 // 20 - 1), (s * 2 // 5 - 1, s * 11 // 20)])]
    rows += [(100 * s + i, 0, 0, w, h, s, s, 0) for s in sides for i, (w, h) in enumerate([(s * 3 // 25, s), (s * 3 // 25 - 1, s), (s, s * 3 // 100), (s, s * 3 // 100 - 1), (s // 5, s * 3 // 40), (s // 5, s * 3 // 40 - 1)], 3)]
    boxes = spark.createDataFrame(rows, "id int, x int, y int, w int, h int, width int, height int, v_rules int")
    found = inventory.regions(boxes)
    exact = {100 * s + 7 for s in sides if s % 200 == 0}  # 3/40 of others is no whole number
    assert {r["id"] for r in found.where("id % 100 > 2").collect()} == {100 * s + i for s in sides for i in (3, 5)} | exact
    assert {r["id"] for r in inventory.main_table(found, ["id"]).collect()} == {100 * s for s in sides}


@pytest.mark.parametrize("name", ["region_filter_pick_main", "object_locator", "inventory_counts", "inventory_report", "sheet_name_unique"])
def test_query_of_just_the_share(spark, tmp_path, name):
    con = duckdb.connect()
    con.execute(f"COPY (SELECT unnest({PAGES})::BIGINT AS page_id, 'u' AS url, '' AS html) TO '{tmp_path}/pages.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet'")
    want = con.execute(catalog.SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(map(tuple, catalog.QUERIES[name](spark, str(tmp_path)).select(names).collect())) == sorted(want.fetchall())
