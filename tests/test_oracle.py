"""Every query with a SQL equivalent gives the same rows in DuckDB over the same tables."""

import datetime
import decimal

import duckdb
import pytest

from tilewright import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_equal_to_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    names = sorted(got.columns)
    mine = sorted(([plain(r[c]) for c in names] for r in got.collect()), key=repr)
    cursor = duck.execute(registry.ORACLE_SQL[name])
    theirs = [d[0] for d in cursor.description]
    assert sorted(theirs) == names
    assert mine == sorted(([plain(r[theirs.index(c)]) for c in names] for r in cursor.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).columns


def test_registry_needs_no_session():
    import subprocess
    import sys

    subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert e.queries() and e.oracle_sql()"], check=True, cwd=__file__.rsplit("/", 2)[0])
