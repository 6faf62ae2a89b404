"""What the order lines carry through a shuffle, and how many of them meet in one task."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from tests.test_plans import big, optimized, physical  # noqa: F401 - big is a fixture
from tillroll.operators import measures
from tillroll.plans.registry import QUERIES
from tillroll.sources import binding

WHOLE = ["scan_orders", "refined_order_priority", "relabel_subcategory", "describe_orders", "orders_with_returns", "null_profile"]
SHIPPING = ["shipping_effectiveness", "shipping_effectiveness_by_state"]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Own tables: repeated, missing and unmatched keys, NULL dates and amounts."""
    at = str(tmp_path_factory.mktemp("odd"))
    day = lambda n: dt.datetime(2015, 1, 1) + dt.timedelta(days=n)

    def write(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{at}/{name}.parquet")

    write("region", [(0, "NORTH"), (1, "SOUTH")], "r_regionkey int, r_name string")
    write("nation", [(0, "A", 0), (1, "B", 1)], "n_nationkey int, n_name string, n_regionkey int")
    write("customer", [(1, "C1", 0, 1.0, "S"), (2, "C2", 1, 1.0, "T"), (2, "C2", 0, 1.0, "T"), (3, None, 1, 1.0, None), (4, "C4", None, 1.0, "S")],
          "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string")
    write("part", [(1, "bolt", "Brand and", "BIG", 3, 10.5), (2, "nut", None, "BIG", None, 2.0), (2, "nut", "B2", None, 8, None), (3, None, "B3", "X", 9, 1.0)],
          "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double")
    write("orders", [(1, 1, "O", 1.0, day(0), "LOW"), (2, 2, "O", 1.0, day(1), None), (2, 1, "O", 1.0, day(3), "LOW"), (3, 3, "O", 1.0, None, "HIGH"),
                     (4, 4, "O", 1.0, day(2), "LOW"), (None, 1, "O", 1.0, day(2), "LOW"), (5, None, "O", 1.0, day(2), "LOW"), (1, 1, "O", 1.0, day(0), "LOW")],
          "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string")
    lines = [(o, p, s, n, float(q) if q else None, 10.25 * n, 0.05, 0.02 if n % 3 else None, "R" if n % 4 == 0 else "N", "O", day(n) if n % 5 else None)
             for n, (o, p, s, q) in enumerate([(o, p, s, q) for o in (1, 2, 3, 4, 5, None, 9) for p, s, q in
                                               ((1, 4, 2), (2, 5, 3), (3, 8, None), (None, 4, 1), (7, 4, 1), (1, None, 2), (1, 4, 2))], 1)]
    write("lineitem", lines + lines[:9], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
          "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz")
    return at


def told(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("key", WHOLE)
def test_whole_lines_meet_part_before_the_wide_orders(big, sf_small, key):  # noqa: F811
    plan = optimized(QUERIES[key](big, sf_small)).splitlines()

    def depth(key):
        return min(len(line) - len(line.lstrip(" :+-")) for line in plan if "Join Inner" in line and key in line)

    assert depth("p_partkey") > depth("o_orderkey")          # deeper = applied earlier
    assert "timestamp_ntz" not in "".join(line for line in plan if "Join" in line)


def test_part_first_gives_the_rows_of_order_first(spark, odd):
    both = [binding.sales_line(spark, odd, first=first) for first in ("order", "part")]
    assert both[0].schema == both[1].schema and both[0].count() > 10
    assert told(both[0]) == told(both[1])
    keep = (binding.o_return(spark, odd), "left", {"return_order_id": "order_id", "order_status": "order_status"})
    both = [binding.sales_line(spark, odd, order_join=keep, first=first) for first in ("order", "part")]
    assert both[0].schema == both[1].schema and told(both[0]) == told(both[1])
    with pytest.raises(ValueError):
        binding.sales_line(spark, odd, order_join=(keep[0], "left_semi", {}), first="part")


@pytest.mark.parametrize("key", SHIPPING)
def test_orders_are_counted_on_the_lines_own_partitions(big, sf_small, key, monkeypatch):  # noqa: F811
    plan = physical(QUERIES[key](big, sf_small))
    assert len(re.findall(r"hashpartitioning\(order_id#\d+L?, ", plan)) == 1     # the lines are shuffled on the order key once
    assert not re.search(r"Exchange hashpartitioning\([^)]*ship_mode[^)]*order_id", plan)
    assert not re.search(r"Aggregate\(keys=\[[^\]]*order_id", plan)              # nothing is kept per order
    assert not re.search(r"Sort \[l_partkey", plan)                              # lines are not sorted to meet part
    monkeypatch.setattr(binding, "LINES_PER_TASK", 250)
    lines = big.read.parquet(f"{sf_small}/lineitem.parquet").count()
    tasks = -(-lines // 250)
    assert re.search(rf"hashpartitioning\(order_id#\d+L?, {tasks}\)", physical(QUERIES[key](big, sf_small)))


def test_marked_orders_equal_counted_orders(spark, odd):
    for by in ([], ["state_province"]):
        lines = binding.sales_line(spark, odd, [*by, "ship_mode", "order_id", "shipping_cost", "profit", "sales", "ship_date", "order_date"])
        counted = {tuple(r[:-1]): r[-1] for r in lines.groupBy(*by, "ship_mode").agg(F.count_distinct("order_id")).collect()}
        marked = measures.shipping_effectiveness(binding.delivery_lines(spark, odd, by_state=bool(by)), by)
        assert {tuple(r[c] for c in [*by, "ship_mode"]): r["orders"] for r in marked.collect()} == counted and len(counted) > 2
        assert told(marked) == told(measures.shipping_effectiveness(lines, by))
