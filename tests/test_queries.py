"""Every registered query against its SQL on the smallest tables."""

import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tools")]

import __spark_entry__ as entry  # noqa: E402
from check_oracle import TABLES, tidy  # noqa: E402

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{entry.SMALL}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, entry.SMALL).toPandas()
    if name not in ORACLES:
        return
    a, b = tidy(got), tidy(con.sql(ORACLES[name]).df())
    assert list(a.columns) == list(b.columns) and len(a) == len(b)
    assert [c for c in a.columns if not a[c].equals(b[c])] == []


def test_flagship(spark):
    got = entry.entry(spark).toPandas()
    assert (got["total_bars"].sum(), got["buy"].sum(), got["sell"].sum()) == (960, 124, 126)
