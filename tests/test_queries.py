"""Every query with SQL gives the SQL's rows on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as driver

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    return repr(float(value)) if isinstance(value, float) else str(value)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(n for n in driver.oracle_sql() if n.startswith("q")))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    got, want = driver.queries()[name](spark, SF).toPandas(), con.sql(driver.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda df: sorted(tuple(map(plain, r)) for r in df[columns].itertuples(index=False, name=None))
    assert rows(got) == rows(want)


def test_entry(spark):
    assert driver.entry(spark).count() > 0
