"""Every query of the catalog against its SQL, on the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from gridloom.plans import catalog, catalog_files, catalog_more  # noqa: F401  (they add to the first)

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    return None if isinstance(v, float) and math.isnan(v) else round(v, 9) if isinstance(v, float) else v


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    found = con.execute(catalog.SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    key = lambda row: tuple((v is not None, str(v)) for v in row)
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in found.fetchall()), key=key)
    got = sorted((tuple(map(plain, r)) for r in df.select(*cols).collect()), key=key)
    assert got == want and got
