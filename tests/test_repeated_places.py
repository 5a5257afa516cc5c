"""Queries on tables in which several keys share a place, against their SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from airexposure.plans import catalog, extended, filesets  # noqa: F401  they register their queries

SMALL = "/root/testdata/sf0.001"
KEYS = {"lineitem": ["l_suppkey"], "customer": ["c_custkey"]}


@pytest.fixture(scope="module")
def repeated(spark, tmp_path_factory):
    """lineitem and customer twice, the keys shifted by the 4000 after which places repeat."""
    path = str(tmp_path_factory.mktemp("repeated"))
    for table, keys in KEYS.items():
        rows = spark.read.parquet(f"{SMALL}/{table}.parquet")
        again = rows.withColumns({k: F.col(k) + 4000 for k in keys})
        if table == "lineitem":  # other prices, so that a wrong partner shows
            again = again.withColumn("l_extendedprice", F.col("l_extendedprice") * (1 + F.col("l_quantity") % 3))
        rows.unionByName(again.select(*[F.col(c).cast(t).alias(c) for c, t in rows.dtypes])).write.parquet(f"{path}/{table}.parquet")
    spark.read.parquet(f"{SMALL}/nation.parquet").write.parquet(f"{path}/nation.parquet")
    return path


def of_sql(path, name, columns):
    con = duckdb.connect()
    for table in KEYS:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}/{table}.parquet/*.parquet'")
    return sorted(map(tuple, con.execute(f"SELECT {', '.join(columns)} FROM ({catalog.ORACLES[name]})").fetchall()))


@pytest.mark.parametrize("name", ["file_grid", "file_surfaces", "width_corr", "width_diff"])
def test_rows_meet_by_key_where_places_repeat(spark, repeated, name):
    got = catalog.QUERIES[name](spark, repeated)
    assert sorted(map(tuple, got.collect())) == of_sql(repeated, name, got.columns)
