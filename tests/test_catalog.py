"""Every query with a SQL counterpart agrees with it, on the smallest tables."""

import datetime
import decimal
import glob
import os

import pytest

from deltascope.plans import catalog

DATA = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def engine():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(table):
    """Sorted rows by the columns' own types: whole numbers alike, fractions to six places, nulls apart from texts."""

    def one(x):
        if isinstance(x, decimal.Decimal) and x == x.to_integral_value():
            x = int(x)
        if isinstance(x, (float, decimal.Decimal)):
            return f"{x:.6f}"
        return f"<{x}>" if x is None or isinstance(x, (bool, datetime.date)) else str(x)

    names = sorted(table.column_names)
    return sorted(tuple(one(row[x]) for x in names) for row in table.to_pylist())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_agrees_with_sql(spark, engine, name):
    got, want = catalog.QUERIES[name](spark, DATA).toArrow(), engine.execute(catalog.ORACLES[name]).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names)
    assert plain(got) == plain(want)
