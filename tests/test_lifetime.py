"""The buying model recovers simulated parameters, and its formulas hold against simulation and SQL."""

import datetime as dt
import math

import duckdb
import numpy as np
import pytest
from helpers import lines

from tillroll.operators import lifetime as L

TRUE = L.BuyingModel(1.2, 6.0, 0.9, 3.0)


def simulated(rng, n, age, ahead):
    """(x, t_x, age, later) of n customers who follow TRUE, purchases at continuous times."""
    out = []
    for _ in range(n):
        rate, stop = rng.gamma(TRUE.r, 1 / TRUE.alpha), rng.beta(TRUE.a, TRUE.b)
        t, x, t_x, later, alive = 0.0, 0, 0.0, 0, True
        while alive:
            t += rng.exponential(1 / rate)
            if t > age + ahead:
                break
            if t <= age:
                x, t_x = x + 1, t
            else:
                later += 1
            alive = rng.random() >= stop
        out.append((x, t_x, age, later))
    return [np.array(c) for c in zip(*out)]


def test_parameters_and_forecast_of_simulated_customers():
    rng = np.random.default_rng(7)
    x, t_x, age, later = simulated(rng, 12_000, 30.0, 12.0)
    model = L.fit_cells(x, t_x, age, np.ones_like(x))
    assert L.log_likelihood(model, x, t_x, age, np.ones(len(x))) >= L.log_likelihood(TRUE, x, t_x, age, np.ones(len(x)))
    assert model.r / model.alpha == pytest.approx(TRUE.r / TRUE.alpha, rel=0.1)
    assert model.a / (model.a + model.b) == pytest.approx(TRUE.a / (TRUE.a + TRUE.b), rel=0.15)
    got = L.expected_purchases(model, x, t_x, age, 12.0)
    for part in (x == 0, (x > 0) & (x < 4), x >= 4):
        assert got[part].sum() == pytest.approx(later[part].sum(), rel=0.12)
    assert ((L.chance_active(model, x, t_x, age) <= 1) & (got >= 0)).all()


def test_likelihood_and_activity_in_sql():
    rows = [(0, 0.0, 20.0, 5), (1, 3.0, 20.0, 2), (4, 18.0, 20.0, 1), (7, 7.5, 30.0, 3)]
    x, t_x, age, n = (np.array(c) for c in zip(*rows))
    m = TRUE
    sql = f"""
      WITH c(x, t, g, n) AS (VALUES {', '.join(str(tuple(float(v) for v in r)) for r in rows)}), m AS (SELECT {m.r} AS r, {m.alpha} AS al, {m.a} AS a, {m.b} AS b)
      SELECT sum(n * (lgamma(r + x) - lgamma(r) + r * ln(al) + lgamma(a + b) + lgamma(b + x) - lgamma(b) - lgamma(a + b + x)
             + ln(pow(al + g, -(r + x)) + CASE WHEN x > 0 THEN a / (b + x - 1) * pow(al + t, -(r + x)) ELSE 0 END))),
             list(1 / (1 + CASE WHEN x > 0 THEN a / (b + x - 1) * pow((al + g) / (al + t), r + x) ELSE 0 END) ORDER BY x) FROM c, m"""
    total, active = duckdb.connect().execute(sql).fetchone()
    assert L.log_likelihood(m, x, t_x, age, n) == pytest.approx(total)
    assert L.chance_active(m, x, t_x, age).tolist() == pytest.approx(active)


def test_a_customer_who_came_every_month_is_expected_again(spark):
    def on(month):
        return str(dt.date(2018 + month // 12, month % 12 + 1, 5))

    rows = [{"customer_id": 1, "order_date": on(m), "sales": 10} for m in range(24)] + [{"customer_id": 1, "order_date": on(3), "sales": 14}]
    rows += [{"customer_id": 2, "order_date": on(m), "sales": 10} for m in range(5)] + [{"customer_id": 3, "order_date": on(20), "sales": 7}]
    rows += [{"customer_id": None, "order_date": on(1), "sales": 1}, {"customer_id": 4, "order_date": None, "sales": 1}]
    got = {r.customer_id: r for r in L.customer_lifetime_forecast(lines(spark, rows), 12, L.BuyingModel(2.0, 3.0, 1.5, 9.0)).collect()}
    assert {k: (r.x, r.t_x, r.age) for k, r in got.items()} == {1: (23, 23, 23), 2: (4, 4, 23), 3: (0, 0, 3)}
    assert got[1].active > 0.9 > 0.3 > got[2].active and got[3].active == 1.0
    assert got[1].expected_months > 4 > got[2].expected_months
    assert got[1].expected_value == pytest.approx(got[1].expected_months * 254 / 24)
    assert L.customer_lifetime_forecast(lines(spark, rows).limit(0)).collect() == []
    assert math.isfinite(got[3].expected_value)
