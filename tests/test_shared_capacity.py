"""The shared capacity against taking items one by one."""

import random

import pytest
from helpers import m

from tillroll.operators import cost


def one_by_one(items, capacity):
    made = {}
    for item, (volume, make, buy) in sorted(items.items(), key=lambda x: (x[1][1] - x[1][2], x[0])):
        made[item] = min(volume, capacity) if buy > make else 0
        capacity -= made[item]
    return made


@pytest.mark.parametrize("capacity", [0, 1, 37, 500, 10**6])
def test_capacity_goes_to_the_largest_savings(spark, capacity):
    rng = random.Random(capacity)
    items = {rng.choice([i, i << 20, i << 40]) + 1: (rng.randrange(0, 90), rng.randrange(100, 900), rng.randrange(100, 900)) for i in range(24)}
    items |= {10**12 + i: (10, 500, 620) for i in range(6)}                          # ties in the saving
    parts = spark.createDataFrame([(i, "x", m(make / 100)) for i, (_, make, _) in items.items()], "item long, component string, unit_cost decimal(18,2)")
    quotes = spark.createDataFrame([(i, s, m((buy + extra) / 100), m(0), v) for i, (v, _, buy) in items.items() for s, extra in (("A", 0), ("B", 70))],
                                   "item long, supplier string, unit_price decimal(18,2), nre decimal(18,2), volume long")
    got = {r.item: r for r in cost.shared_capacity(parts, quotes, capacity).collect()}
    assert {i: r.make_units for i, r in got.items()} == one_by_one(items, capacity)
    assert all(r.make_units + r.buy_units == r.volume for r in got.values())
    assert sum(r.saving for r in got.values()) == pytest.approx(sum(n * (items[i][2] - items[i][1]) / 100 for i, n in one_by_one(items, capacity).items()))


def test_no_items(spark):
    none = spark.createDataFrame([], "item long, component string, unit_cost decimal(18,2)")
    quotes = spark.createDataFrame([], "item long, supplier string, unit_price decimal(18,2), nre decimal(18,2), volume long")
    assert cost.shared_capacity(none, quotes, 5).collect() == []
