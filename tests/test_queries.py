"""Every query with SQL against DuckDB on the smallest tables, where they are."""

import glob
from pathlib import Path

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SMALL).exists(), reason="no test tables here")


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = df[c].map(lambda v: None if v is None or v is pd.NaT or (isinstance(v, float) and pd.isna(v)) else f"{v:.6g}" if isinstance(v, float) else str(v))
    return sorted(map(tuple, df.astype(object).where(df.notna(), "-").values.tolist()))


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{SMALL}/*.parquet"):
        c.execute(f"create view {Path(p).stem} as select * from read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_equal(spark, sql, name):
    a, b = entry.queries()[name](spark, SMALL).toPandas(), sql.execute(entry.oracle_sql()[name]).df()
    assert sorted(a.columns) == sorted(b.columns) and rows(a) == rows(b)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_runs(spark, name):
    entry.queries()[name](spark, SMALL).count()
