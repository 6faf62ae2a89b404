"""Every registered key against its independent DuckDB SQL (exact equality),
plus the binding anchors of FIXTURES.md §3 and the driver smoke entry."""

import os

import duckdb
import pytest

from tillroll.plans.coverage import WITHOUT_SQL
from tillroll.plans.registry import ORACLE_SQL, QUERIES
from tillroll.sources.tables import DRIVER_TABLES

import tools_compare as cmp


@pytest.fixture(scope="module")
def con(sf_small):
    c = duckdb.connect()
    for t in DRIVER_TABLES:
        p = os.path.join(sf_small, f"{t}.parquet")
        if os.path.exists(p):
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("key", sorted(ORACLE_SQL))
def test_key_matches_oracle(spark, sf_small, con, key):
    got = QUERIES[key](spark, sf_small).toPandas()
    want = con.sql(ORACLE_SQL[key]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    assert cmp.sorted_rows(got) == cmp.sorted_rows(want)


def test_every_key_has_oracle():
    assert set(QUERIES) == set(ORACLE_SQL) | WITHOUT_SQL


def test_binding_anchors(spark, sf_small):
    from pyspark.sql import functions as F
    from tillroll.sources.binding import o_return, sales_line
    sl = sales_line(spark, sf_small)
    r = sl.agg(F.count("*").alias("n"), F.sum("sales").alias("s"), F.sum("profit").alias("p"),
               F.count_distinct("customer_id").alias("c")).collect()[0]
    assert (r["n"], str(r["s"]), str(r["p"]), r["c"]) == (6000, "317364757.31", "178846282.21", 150)
    assert o_return(spark, sf_small).count() == 1096


def test_entry_smoke(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.columns == ["monthly", "retention_count", "total_count", "retention_rate"]
    assert df.count() > 0


def test_describe_lists_columns(spark, sf_small):
    out = {r["col_name"]: r["data_type"] for r in QUERIES["describe_orders"](spark, sf_small).collect()}
    assert out["sales"] == "DECIMAL(18,2)" and out["order_date"] == "DATE" and len(out) == 24
