"""Every registered query on sf0.001: runs, and equals its SQL cross-check.

The same comparison the driver makes at sf0.01: column names, row count and an
order-insensitive hash of the values.
"""

import os

import duckdb
import pytest

from conftest import SF001
import __spark_entry__ as E
from scripts.oracle_check import TABLES, digest

QUERIES = E.queries()
SQLS = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = f"{SF001}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["item_name", "order_count", "total_quantity", "total_revenue"]
    assert 0 < df.count() <= 5


def test_every_sql_has_a_query():
    assert set(SQLS) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF001)
    srows = [tuple(r) for r in df.collect()]
    if name not in SQLS:
        assert srows is not None
        return
    res = con.execute(SQLS[name])
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    assert digest(df.columns, srows)[0] == digest(dcols, drows)[0]
