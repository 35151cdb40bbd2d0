"""Every registered query against its SQL, and with another number of partitions."""

import duckdb
import pytest

import __spark_entry__ as entry
from check_queries import TABLES, ordered

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    result = con.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert ordered(df.columns, df.collect()) == ordered(columns, result.fetchall())


@pytest.mark.parametrize("name", ["heal_rows", "fill_forward", "stitch_tables", "surrogate_keys", "dedup_first"])
def test_result_does_not_depend_on_partitions(spark, name):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    shown = []
    try:
        for count in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", count)
            df = QUERIES[name](spark, FOLDER)
            shown.append(ordered(df.columns, df.collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert shown[0] == shown[1]


def test_entry(spark):
    assert entry.entry(spark).count() == 1
