"""Every registered query against its SQL on the smallest driver tables."""

import os

import pytest

from weftline.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    show = lambda v: "null" if v is None else repr(round(float(v), 6)) if isinstance(v, int | float) and not isinstance(v, bool) else str(v)
    return sorted(tuple(show(v[i]) for i in order) for v in values)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    assert got
    if sql := registry.oracle_sql().get(name):
        found = duck.execute(sql)
        columns = [d[0] for d in found.description]
        assert sorted(columns) == sorted(df.columns)
        assert got == rows(columns, found.fetchall())
