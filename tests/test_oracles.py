"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from quirespark import queries as Q


@pytest.fixture(scope="module")
def duck(sf):
    connection = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        connection.sql(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    return connection


def plain(value):
    return round(float(value), 9) if isinstance(value, float) or type(value).__name__ == "Decimal" else value


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query_equals_sql(spark, sf, duck, name):
    df = Q.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    found = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    relation = duck.sql(Q.ORACLES[name])
    assert sorted(relation.columns) == columns
    at = [relation.columns.index(c) for c in columns]
    assert found and found == sorted((tuple(plain(r[i]) for i in at) for r in relation.fetchall()), key=repr)


@pytest.mark.parametrize("name", ["reading_order", "region_dedupe", "markdown_blocks_of_conversations"])
def test_partitioning_changes_nothing(spark, sf, name):
    was = spark.conf.get("spark.sql.shuffle.partitions")
    seen = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        seen.append(sorted(map(str, Q.QUERIES[name](spark, sf).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", was)
    assert seen[0] == seen[1]
