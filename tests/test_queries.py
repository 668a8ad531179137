"""Every registered query of the table engine against its DuckDB equivalent."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from gridlark import catalog

DATA = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in sorted(os.listdir(DATA)):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables aren't here")
@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, db, name):
    df = catalog.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    found = sorted((tuple(map(plain, r)) for r in df.select(*[f"`{c}`" for c in columns]).collect()), key=repr)
    result = db.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    rows = result.fetchall()
    assert sorted(names) == columns
    place = [names.index(c) for c in columns]
    assert found == sorted((tuple(plain(r[i]) for i in place) for r in rows), key=repr)
    spark.catalog.clearCache()


def test_entry_registers_them():
    import __spark_entry__

    assert set(catalog.QUERIES) <= set(__spark_entry__.queries()) and set(catalog.ORACLE_SQL) <= set(__spark_entry__.oracle_sql())
