"""Every query with SQL against DuckDB on the same tables."""

import datetime
import decimal
import math

import duckdb
import pytest

from annomill.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 5) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    found = duck.execute(SQL[name])
    got = table(df.columns, df.collect())
    assert got == table([c[0] for c in found.description], found.fetchall())
    assert got[1]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_has_rows_and_is_stable(spark, name):
    df = QUERIES[name](spark, SF)
    one = table(df.columns, df.collect())
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        again = QUERIES[name](spark, SF)
        assert table(again.columns, again.collect()) == one
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert one[1]
