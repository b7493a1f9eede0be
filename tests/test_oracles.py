"""Every query that has oracle SQL gives the same rows in Spark and in DuckDB."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
ONLY = os.environ.get("ORACLE_ONLY", "").split(",") if os.environ.get("ORACLE_ONLY") else None


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f).removesuffix('.parquet')} AS SELECT * FROM read_parquet('{f}')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if hasattr(v, "as_tuple"):
        return round(float(v), 6)
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=str)


NAMES = sorted(n for n in entry.oracle_sql() if not ONLY or n in ONLY)


@pytest.mark.parametrize("name", NAMES)
def test_oracle(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    ran = duck.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in ran.description]
    assert sorted(df.columns) == sorted(columns)
    got, want = rows(df.columns, df.collect()), rows(columns, ran.fetchall())
    assert len(got) == len(want)
    assert got == want
    assert got
