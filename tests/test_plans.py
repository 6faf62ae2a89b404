"""Plan-shape checks: the scale properties the README claims, asserted on the
physical / optimized plans (planned as for large inputs: no auto-broadcast)."""

import re

import pytest

from tillroll.plans.registry import QUERIES


@pytest.fixture(scope="module")
def big(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10240")   # only tiny dims broadcast
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_pruned_columns_and_joins(big, sf_small):
    plan = physical(QUERIES["region_sales_contribution"](big, sf_small))
    scans = re.findall(r"FileScan parquet \[([^\]]*)\][^\n]*lineitem", plan)
    read = {c.split("#")[0] for cols in scans for c in cols.split(",")}
    assert scans and read == {"l_orderkey", "l_extendedprice"}
    assert "part.parquet" not in plan                      # no part join when no part column is used


def test_top_k_is_limited_before_the_shuffle(big, sf_small):
    for key in ["top_ship_mode_by_state", "top_product_per_state", "top_subcat_per_region",
                "widest_ship_mode_by_state", "best_ship_mode_by_state", "top2_products_per_category"]:
        assert "WindowGroupLimit" in physical(QUERIES[key](big, sf_small)), key


def test_positions_use_no_global_row_number(big, sf_small):
    for key in ["nth_sales_value", "sales_value_index", "median_profit"]:
        plan = physical(QUERIES[key](big, sf_small))
        assert "row_number()" not in plan, key


def test_returns_semi_join_below_part_join(big, sf_small):
    plan = optimized(QUERIES["returned_order_details"](big, sf_small)).splitlines()

    def depth(pred):
        return min(len(line) - len(line.lstrip(" :+-")) for line in plan if pred(line))

    semi = depth(lambda line: "LeftSemi" in line)
    part = depth(lambda line: "Join Inner" in line and "p_partkey" in line)
    assert semi > part                                      # deeper = applied earlier


def test_order_grain_shuffles_aggregates_not_lines(big, sf_small):
    plan = optimized(QUERIES["retention_monthly"](big, sf_small))
    # lineitem is reduced to one row per order before it meets orders
    assert re.search(r"Aggregate \[l_orderkey", plan)


def test_part_grain_sums_lines_per_part_before_the_part_join(big, sf_small):
    plan = optimized(QUERIES["product_sales"](big, sf_small))
    assert re.search(r"Aggregate \[l_partkey", plan)


@pytest.mark.parametrize("key", ["segment_order_count", "region_sales_and_lines", "cities_per_region", "states_per_city",
                                 "city_repeated_in_region", "city_repeated_states", "covered_city_count", "priority_counts",
                                 "customers_by_value_bracket", "priority_by_region_state", "value_if_single", "category_frequency",
                                 "priority_by_customer"])
def test_order_level_groupings_run_on_order_rows(big, sf_small, key):
    assert re.search(r"Aggregate \[l_orderkey", optimized(QUERIES[key](big, sf_small)))


@pytest.mark.parametrize("key", ["product_avg_sales", "product_avg_prefix", "subcat_share_in_category"])
def test_part_level_groupings_run_on_part_rows(big, sf_small, key):
    assert re.search(r"Aggregate \[l_partkey", optimized(QUERIES[key](big, sf_small)))


def test_one_aggregate_feeds_all_drivers(big, sf_small):
    joins = lambda key: physical(QUERIES[key](big, sf_small)).count("SortMergeJoin")
    assert joins("clv_drivers") == joins("customer_lifetime_value")
    assert joins("retention_crosscheck") <= 1                # the order binding's own join, none between the counts


@pytest.mark.parametrize("key", ["unit_cost", "extended_cost", "full_cost", "make_vs_buy", "shipping_effectiveness"])
def test_lineitem_is_scanned_once(big, sf_small, key):
    assert len(re.findall(r"FileScan parquet[^\n]*lineitem", physical(QUERIES[key](big, sf_small)))) == 1
