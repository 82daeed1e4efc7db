"""Registered queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
PLAIN = sorted(entry.REGISTERED)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(DIR):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{f}'")
    return c


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    show = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted("|".join(show(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", PLAIN)
def test_query(spark, con, name):
    df = entry.queries()[name](spark, DIR)
    got = [tuple(r) for r in df.collect()]
    sql = entry.oracle_sql().get(name)
    if sql:
        rel = con.sql(sql)
        assert sorted(rel.columns) == sorted(df.columns)
        assert rows(df.columns, got) == rows(rel.columns, rel.fetchall())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"] and not df.isEmpty()


def test_end_to_end_counts_findings(spark, tmp_path):
    """Customers whose masked names are 00 and digits: the scan finds them, and so does the SQL."""
    from pyspark.sql import functions as F

    for f in os.listdir(DIR):
        if f != "customer.parquet":
            os.symlink(f"{DIR}/{f}", tmp_path / f)
    name = F.expr("case c_custkey when 7 then 'Customer#000018283' when 8 then 'Customer#000038279' else c_name end")
    spark.read.parquet(f"{DIR}/customer.parquet").withColumn("c_name", name).write.parquet(str(tmp_path / "customer.parquet"))
    c = duckdb.connect()
    for f in os.listdir(tmp_path):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{tmp_path}/{f}{'/*.parquet' if f == 'customer.parquet' else ''}'")
    df = entry.queries()["slice_end_to_end"](spark, str(tmp_path))
    got, rel = [tuple(r) for r in df.collect()], c.sql(entry.oracle_sql()["slice_end_to_end"])
    assert rows(df.columns, got) == rows(rel.columns, rel.fetchall())
    assert {r.table_name: r.n_findings for r in df.collect()}["customer"] == 2
