"""Customer lifetime value from buying rates that die out: the BG/NBD model.

While active a customer buys at a rate of their own (gamma distributed over customers: r,
alpha) and after each purchase stops for good with a probability of their own (beta
distributed: a, b). What is known of a customer is (x, t_x, T): repeat purchases, age at
the last one, and age now, all in months.

Customers are counted by (x, t_x, T), of which there are no more than the calendar's months
allow (some hundred thousand for seven years), whatever the number of customers. The
likelihood of the four parameters is a sum over those cells, maximised on the driver
(Nelder-Mead, a bounded number of steps); the expected purchases are computed once per cell
and joined back to the customers.

References: P. Fader, B. Hardie, K. Lee, "Counting your customers the easy way", Marketing
Science 24 (2005).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.functions.columns import month_start

#: cells that may be collected: every x <= t_x <= T of 20 years' months has fewer
MOST_CELLS = 2_500_000


@dataclass(frozen=True)
class BuyingModel:
    """Rate ~ gamma(r, alpha), stopping ~ beta(a, b)."""

    r: float
    alpha: float
    a: float
    b: float


def purchase_history(lines: DataFrame) -> DataFrame:
    """customer_id, x (months with orders after the first), t_x, age, spent: one row per customer.

    Months are the model's time steps: several orders of one month count once.
    """
    last = lines.agg(F.max(month_start("order_date"))).scalar()
    months = lines.where("customer_id IS NOT NULL AND order_date IS NOT NULL").groupBy("customer_id", month_start("order_date").alias("m")).agg(F.sum("sales").alias("s"))
    per = months.groupBy("customer_id").agg(F.min("m").alias("first"), F.max("m").alias("latest"), (F.count(F.lit(1)) - 1).cast("int").alias("x"), F.sum("s").alias("spent"))
    apart = lambda a, b: F.round(F.months_between(a, b)).cast("int")
    return per.select("customer_id", "x", apart("latest", "first").alias("t_x"), apart(last, F.col("first")).alias("age"), "spent")


def log_likelihood(model: BuyingModel, x: np.ndarray, t_x: np.ndarray, age: np.ndarray, n: np.ndarray) -> float:
    """Log likelihood of cells (x, t_x, age) with n customers each."""
    r, alpha, a, b = model.r, model.alpha, model.a, model.b
    top = int(x.max())
    ks = np.arange(top + 1)
    gamma = np.array([math.lgamma(r + k) - math.lgamma(r) + r * math.log(alpha) for k in ks])
    stays = np.array([math.lgamma(a + b) + math.lgamma(b + k) - math.lgamma(b) - math.lgamma(a + b + k) for k in ks])
    active = -(r + x) * np.log(alpha + age)
    gone = np.where(x > 0, math.log(a) - np.log(b + np.maximum(x, 1) - 1) - (r + x) * np.log(alpha + t_x), -np.inf)
    return float((n * (gamma[x] + stays[x] + np.logaddexp(active, gone))).sum())


def nelder_mead(loss, start: np.ndarray, steps: int = 600, spread: float = 0.5, close: float = 1e-7) -> np.ndarray:
    """The point of least ``loss`` near ``start``: a simplex that reflects, stretches and shrinks, ``steps`` moves at most."""
    points = [start] + [start + spread * np.eye(len(start))[i] for i in range(len(start))]
    values = [loss(p) for p in points]
    for _ in range(steps):
        order = np.argsort(values, kind="stable")
        points, values = [points[i] for i in order], [values[i] for i in order]
        if abs(values[-1] - values[0]) <= close * (abs(values[0]) + close):
            break
        middle = np.mean(points[:-1], axis=0)

        def tried(scale, middle=middle):
            p = middle + scale * (points[-1] - middle)
            return p, loss(p)

        p, v = tried(-1.0)
        if v < values[0]:
            far, w = tried(-2.0)
            p, v = (far, w) if w < v else (p, v)
        elif v >= values[-2]:
            near, w = tried(0.5 if v >= values[-1] else -0.5)
            if w < min(v, values[-1]):
                p, v = near, w
            else:
                points = [points[0]] + [points[0] + 0.5 * (q - points[0]) for q in points[1:]]
                values = [values[0]] + [loss(q) for q in points[1:]]
                continue
        points[-1], values[-1] = p, v
    return points[int(np.argmin(values))]


def fit_cells(x, t_x, age, n) -> BuyingModel:
    """The most likely model of counted cells; parameters stay between e-7 and e7."""
    x, t_x, age, n = (np.asarray(v) for v in (x, t_x, age, n))

    def model(p):
        return BuyingModel(*np.exp(np.clip(p, -7, 7)).tolist())

    total = max(float(n.sum()), 1.0)
    best = nelder_mead(lambda p: -log_likelihood(model(p), x.astype(int), t_x.astype(float), age.astype(float), n) / total, np.zeros(4))
    return model(best)


def expected_purchases(model: BuyingModel, x: np.ndarray, t_x: np.ndarray, age: np.ndarray, ahead: float, terms: int = 2000) -> np.ndarray:
    """Expected purchases of the next ``ahead`` months given the history of each cell."""
    r, alpha, a, b = model.r, model.alpha, model.a, model.b
    if abs(a - 1) < 1e-6:
        a = 1 + 1e-6
    x, t_x, age = x.astype(float), t_x.astype(float), age.astype(float)
    z = ahead / (alpha + age + ahead)
    series, term = np.ones_like(z), np.ones_like(z)           # Gauss's hypergeometric series; 0 <= z < 1
    for k in range(terms):
        term = term * (r + x + k) * (b + x + k) / ((a + b + x - 1 + k) * (k + 1)) * z
        series = series + term
        if float(np.max(np.abs(term) / np.abs(series))) < 1e-12:
            break
    shrink = ((alpha + age) / (alpha + age + ahead)) ** (r + x)
    alive = 1 + np.where(x > 0, a / (b + np.maximum(x, 1) - 1) * ((alpha + age) / (alpha + t_x)) ** (r + x), 0.0)
    return (a + b + x - 1) / (a - 1) * (1 - shrink * series) / alive


def chance_active(model: BuyingModel, x: np.ndarray, t_x: np.ndarray, age: np.ndarray) -> np.ndarray:
    """Probability that a customer of each cell is still active."""
    r, alpha, a, b = model.r, model.alpha, model.a, model.b
    x = x.astype(float)
    return 1 / (1 + np.where(x > 0, a / (b + np.maximum(x, 1) - 1) * ((alpha + age) / (alpha + t_x)) ** (r + x), 0.0))


def customer_lifetime_forecast(lines: DataFrame, ahead: int = 12, model: BuyingModel | None = None) -> DataFrame:
    """customer_id, x, t_x, age, active (probability), expected_months (with orders, of the next ``ahead``),
    and expected_value: those months at the customer's own mean value of a month with orders.

    An empty table gives an empty result.
    """
    spark = lines.sparkSession
    history = purchase_history(lines)
    cells = history.groupBy("x", "t_x", "age").agg(F.count(F.lit(1)).alias("n")).limit(MOST_CELLS + 1).collect()
    if len(cells) > MOST_CELLS:
        raise ValueError(f"more than {MOST_CELLS} cells: use a coarser time step")
    schema = "x int, t_x int, age int, active double, expected_months double"
    if not cells:
        answers = spark.createDataFrame([], schema)
    else:
        x, t_x, age, n = (np.array(c) for c in zip(*sorted(tuple(r) for r in cells)))
        model = model or fit_cells(x, t_x, age, n)
        columns = [v.tolist() for v in (x, t_x, age, chance_active(model, x, t_x, age), expected_purchases(model, x, t_x, age, ahead))]
        answers = spark.createDataFrame(list(zip(*columns)), schema)
    value = (F.col("spent") / (F.col("x") + 1)).cast("double")
    return (history.join(answers, ["x", "t_x", "age"])
            .select("customer_id", "x", "t_x", "age", "active", "expected_months", (F.col("expected_months") * value).alias("expected_value")))
