"""Hand-computed fixtures for described analyses (definitions in the operators' docstrings)."""

from decimal import Decimal

from pyspark.sql import functions as F

from helpers import d, lines, rows
from tillroll.operators import hr, measures, quality
from tillroll.operators import time as tm


def test_d01_ytd_restarts_each_year(spark):
    df = lines(spark, [{"order_date": day, "sales": s, "region": "R"} for day, s in
                       [("2014-11-05", 10), ("2014-12-01", 5), ("2015-01-02", 7), ("2015-02-03", 1)]])
    out = rows(measures.total_ytd(df, "order_date", "sales", ["region"]), "month", "value", "ytd")
    assert out == [(d("2014-11-01"), 10.0, 10.0), (d("2014-12-01"), 5.0, 15.0),
                   (d("2015-01-01"), 7.0, 7.0), (d("2015-02-01"), 1.0, 8.0)]


def test_d02_same_period_last_year_with_gap(spark):
    df = lines(spark, [{"order_date": day, "sales": s} for day, s in
                       [("2014-01-10", 100), ("2015-01-10", 150), ("2015-02-10", 80)]])
    out = rows(measures.same_period_last_year(df, "order_date", "sales"), "month", "prior", "yoy_pct")
    # 2015-02 has no 2014-02: prior NULL (a lag of 12 rows would have picked a wrong month)
    assert out == [(d("2014-01-01"), None, None), (d("2015-01-01"), 100.0, 50.0), (d("2015-02-01"), None, None)]


def test_d05_bands_and_d06_single_value(spark):
    df = lines(spark, [{"customer_id": i, "sales": s} for i, s in [(1, 500000), (2, 2500000), (3, 9000000)]])
    banded = measures.categorize(df.select("customer_id", "sales"), "sales",
                                 [(1_000_000, "Low"), (3_000_000, "Medium"), (None, "High")])
    assert rows(banded, "customer_id", "band") == [(1, "Low"), (2, "Medium"), (3, "High")]
    g = lines(spark, [{"city": "a", "state_province": "S1"}, {"city": "a", "state_province": "S1"},
                      {"city": "b", "state_province": "S1"}, {"city": "b", "state_province": "S2"}])
    assert rows(measures.value_if_single(g, ["city"], "state_province"), "city", "n_values", "value") == \
        [("a", 1, "S1"), ("b", 2, None)]


def test_d08_rls_and_d09_bidirectional(spark):
    df = lines(spark, [{"region": r, "customer_id": c, "product_category": k} for r, c, k in
                       [("EAST", 1, "PROMO"), ("WEST", 2, "STD"), ("EAST", 3, "STD")]])
    users = spark.createDataFrame([("EAST", "Chris"), ("WEST", "Erin")], "region string, manager string")
    assert rows(measures.row_level_security(df, users, "Chris"), "customer_id") == [(1,), (3,)]
    dim = spark.createDataFrame([(1, "a"), (2, "b"), (4, "d")], "customer_id long, name string")
    out = measures.bidirectional_filter(dim, df, "customer_id", "customer_id", F.col("product_category") == "PROMO")
    assert rows(out, "customer_id", "name") == [(1, "a")]


def test_d18_dedupe_keeps_first_in_order(spark):
    df = spark.createDataFrame([(1, "r2", 5), (1, "r1", 7), (2, "r9", 1)], "k int, row_id string, v int")
    assert rows(quality.deduplicate(df, ["k"], ["row_id"]), "k", "row_id", "v") == [(1, "r1", 7), (2, "r9", 1)]
    s = quality.duplicate_summary(df, ["k"]).collect()[0]
    assert (s["rows"], s["distinct_keys"], s["duplicate_rows"], s["duplicated_keys"]) == (3, 2, 1, 1)


def _employees(spark):
    rows_ = [(1, "Sales", "F", 19, "Yes", None), (2, "Sales", "M", 20, "No", d("2015-03-01")),
             (3, "Tech", "F", 29, "Yes", None), (4, "Tech", "F", 35, "No", d("2016-05-01"))]
    return spark.createDataFrame(rows_, "employee_id long, department string, gender string, age int, "
                                        "overtime string, exit_date date").withColumn(
        "attrition", F.when(F.col("exit_date").isNotNull(), "Yes").otherwise("No"))


def test_d24_d26_d30_workforce(spark):
    emp = _employees(spark)
    assert rows(hr.age_brackets(emp), "bracket", "n") == [("20-29", 2), ("30-39", 1), ("<20", 1)]
    assert rows(hr.gender_by_bracket(emp), "bracket", "F", "M") == [("20-29", 1, 1), ("30-39", 1, 0), ("<20", 1, 0)]
    rates = rows(hr.rate_by_factor(emp, factors=("overtime", "department")), "factor", "value", "n", "leavers", "rate")
    assert rates == [("department", "Sales", 2, 1, 50.0), ("department", "Tech", 2, 1, 50.0),
                     ("overtime", "No", 2, 2, 100.0), ("overtime", "Yes", 2, 0, 0.0)]


def test_d33_moving_average_and_d34_seasonality(spark):
    df = lines(spark, [{"order_date": day, "sales": s} for day, s in
                       [("2015-01-05", 10), ("2015-01-12", 20), ("2015-01-19", 30), ("2015-01-26", 40),
                        ("2015-02-02", 50)]])
    weekly = rows(tm.period_trend(df, "week", window=4), "period", "moving_avg")
    assert [m for _, m in weekly] == [10.0, 15.0, 20.0, 25.0, 35.0]
    seas = {r["month_of_year"]: r["index"] for r in tm.seasonality_index(df).collect()}
    # months: Jan 100, Feb 50; mean month 75 -> Jan 100/75, Feb 50/75
    assert seas == {1: 100 * 2 / (1 * 150), 2: 50 * 2 / (1 * 150)}


def test_d36_kpi_and_d44_weekday(spark):
    df = lines(spark, [{"order_id": o, "customer_id": c, "sales": s, "profit": p, "order_date": day}
                       for o, c, s, p, day in [(1, 1, "10.00", "2.00", "2015-06-01"), (1, 1, "5.00", "1.00", "2015-06-01"),
                                               (2, 2, "20.01", "-1.00", "2015-06-02")]])
    k = measures.kpi_summary(df).collect()[0]
    assert (k["sales"], k["profit"], k["orders"], k["customers"], k["aov"]) == (35.01, 2.0, 2, 2, 17.51)
    assert k["margin_pct"] == 2.0 / 35.01 * 100
    wd = rows(measures.sales_by_weekday(df), "weekday", "day_name", "sales")
    assert wd == [(0, "Monday", 15.0), (1, "Tuesday", 20.01)]


def test_d10_d11_d14_d15_profiles(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), ("a", 3), ("b", 10), ("b", 20)], "g string, v int")
    prof = {r["column"]: (r["nulls"], r["pct"]) for r in quality.null_profile(df).collect()}
    assert prof == {"g": (0, 0.0), "v": (1, 20.0)}
    imp = rows(quality.impute_median(df, ["v"], ["g"]), "g", "v")
    assert imp == [("a", 1), ("a", 1), ("a", 3), ("b", 10), ("b", 20)]      # lower median of {1, 3} is 1
    five = spark.createDataFrame([("k", v) for v in [5, 1, 4, 2, 3]], "g string, v int")
    b = quality.box_stats(five, "v", ["g"]).collect()[0]
    assert (b["n"], b["min"], b["q1"], b["median"], b["q3"], b["max"]) == (5, 1, 2, 3, 4, 5)
    freq = rows(quality.category_frequency(df, "g"), "value", "count", "pct")
    assert freq == [("a", 3, 60.0), ("b", 2, 40.0)]


def test_d16_d17_d20_numeric(spark):
    df = spark.createDataFrame([(Decimal(x), Decimal(2 * x), Decimal(-x)) for x in [1, 2, 3, 4]],
                               "x decimal(18,2), y decimal(18,2), z decimal(18,2)")
    corr = {(r["col_a"], r["col_b"]): r["corr"] for r in quality.correlation_matrix(df, ["x", "y", "z"]).collect()}
    assert corr == {("x", "y"): 1.0, ("x", "z"): -1.0, ("y", "z"): -1.0}
    bins = rows(quality.binned_pairs(df, "x", "z", 2, 2), "x_bin", "y_bin", "n")
    assert bins == [(0, -1, 1), (1, -2, 1), (1, -1, 1), (2, -2, 1)]
    norm = rows(quality.normalize(df, ["x"]), "x", "x_norm")
    assert [n for _, n in norm] == [0.0, 1 / 3, 2 / 3, 1.0]


def test_d21_d29_d31_workforce_years(spark):
    emp = spark.createDataFrame(
        [(1, "Sales", d("2013-02-01"), d("2014-06-01")), (2, "Sales", d("2013-05-01"), None),
         (3, "Sales", d("2014-01-01"), d("2015-03-01")), (4, "HR", d("2014-07-01"), None)],
        "employee_id long, department string, hire_date date, exit_date date")
    assert rows(hr.attrition_by_year_top(emp, 3), "year", "leavers", "rank") == [(2014, 1, 1), (2015, 1, 1)]
    assert rows(hr.hiring_trend(emp), "year", "hires", "cumulative") == [(2013, 2, 2), (2014, 2, 4)]
    by_year = rows(hr.rate_by_year(emp, d("2015-12-31")), "department", "year", "headcount", "leavers")
    assert by_year == [("HR", 2014, 1, 0), ("HR", 2015, 1, 0), ("Sales", 2013, 2, 0), ("Sales", 2014, 3, 1),
                       ("Sales", 2015, 2, 1)]


def test_d35_d37_time(spark):
    df = lines(spark, [{"order_date": day, "sales": s, "profit": 1} for day, s in
                       [("2015-01-03", 100), ("2015-02-03", 110), ("2015-04-03", 121)]])
    anomalies = rows(tm.sales_anomalies(df), "month", "periods", "z")
    assert [(p, z) for _, p, z in anomalies] == [(0, None), (1, None), (2, None)]   # fewer than 3 prior months
    mom = rows(measures.mom_change(df), "month", "sales_mom_pct")
    assert mom == [(d("2015-01-01"), None), (d("2015-02-01"), 10.0), (d("2015-04-01"), None)]  # March missing


def test_d41_d42_d43_d45_tooltips(spark):
    df = lines(spark, [{"region": r, "state_province": s, "sales": v, "profit": p, "order_id": o,
                        "product_category": k, "ship_mode": m, "order_date": od, "ship_date": sd,
                        "customer_id": c}
                       for r, s, v, p, o, k, m, od, sd, c in [
                           ("R", "A", 10, 1, 1, "K1", "M", "2015-01-01", "2015-01-03", 1),
                           ("R", "B", 30, 3, 2, "K1", "M", "2015-01-01", "2015-01-05", 2),
                           ("R", "B", 20, 2, 2, "K2", "M", "2015-01-01", "2015-01-11", 2)]])
    geo = rows(measures.geo_performance(df), "state_province", "sales", "gap_to_region_mean")
    assert geo == [("A", 10.0, -20.0), ("B", 50.0, 20.0)]               # region mean 30
    assert rows(measures.orders_by_category(df), "product_category", "orders") == [("K1", 2), ("K2", 1)]
    ship = measures.shipping_effectiveness(df.withColumn("shipping_cost", F.lit(1).cast("decimal(18,2)"))).collect()[0]
    assert (ship["orders"], ship["avg_days"], ship["p50_days"], ship["p90_days"]) == (2, 5.33, 4, 10)


def test_d22_d23_d25_d32_workforce_groups(spark):
    emp = spark.createDataFrame(
        [(1, "Sales", "Exec", "W", Decimal("100.00"), d("2010-01-01"), d("2011-06-01")),
         (2, "Sales", "Exec", "W", Decimal("200.01"), d("2010-01-01"), None),
         (3, "Sales", "Rep", "B", Decimal("50.00"), d("2014-01-01"), d("2014-12-01")),
         (4, "HR", "Partner", "B", Decimal("80.00"), d("2012-01-01"), None)],
        "employee_id long, department string, job_role string, ethnicity string, salary decimal(18,2), "
        "hire_date date, exit_date date")
    assert rows(hr.top_roles_per_department(emp, 1), "department", "job_role", "n") == [("HR", "Partner", 1),
                                                                                          ("Sales", "Exec", 2)]
    assert rows(hr.top_groups(emp, "ethnicity", 1), "group", "n", "rank") == [("B", 2, 1)]   # tie -> by name
    assert rows(hr.avg_by_group(emp), "group", "avg") == [("B", 65.0), ("W", 150.01)]       # 150.005 half-up
    tenure = rows(hr.rate_by_tenure(emp, d("2015-12-31")), "department", "tenure_years", "n", "leavers", "above")
    # tenure days / 365, floored: 1460 -> 4, 334 -> 0, 516 -> 1, 2190 -> 6
    assert tenure == [("HR", 4, 1, 0, False), ("Sales", 0, 1, 1, True), ("Sales", 1, 1, 1, True),
                      ("Sales", 6, 1, 0, False)]


def test_d28_review_history(spark):
    df = lines(spark, [{"customer_id": 1, "order_id": o, "order_date": day, "sales": s} for o, day, s in
                       [(1, "2014-03-01", "10.00"), (2, "2014-04-01", "20.01"), (3, "2015-02-01", "5.00")]])
    out = rows(hr.review_history(df), "employee_id", "year", "rating", "satisfaction", "change")
    assert out == [(1, 2014, 15.01, 2, None), (1, 2015, 5.0, 1, -10.01)]


def test_d38_d40_customer_value(spark):
    from tillroll.operators import customer as cust
    df = lines(spark, [{"customer_id": c, "order_id": o, "order_date": day, "sales": s, "profit": p}
                       for c, o, day, s, p in [(1, 1, "2015-01-01", "10.00", "1.00"), (1, 2, "2015-01-31", "30.00", "3.00"),
                                               (2, 3, "2015-02-01", "5.00", "-1.00")]])
    clv = {r["customer_id"]: r for r in cust.customer_lifetime_value(df).collect()}
    assert (clv[1]["orders"], float(clv[1]["aov"]), clv[1]["span_days"], float(clv[1]["clv"])) == (2, 20.0, 30, 4.0)
    drivers = {r["driver"]: r["corr"] for r in cust.clv_drivers(df).collect()}
    assert drivers["orders"] == 1.0                          # two customers: orders and profit move together
    f1 = lines(spark, [{"customer_id": c, "order_date": day} for c, day in
                       [(1, "2015-01-05"), (2, "2015-01-06"), (1, "2015-02-05"), (1, "2015-03-05"), (3, "2015-03-06")]])
    corr = cust.churn_retention_corr(f1).collect()[0]
    # retention 2015-02: 1/1 = 1.00, 2015-03: 1/2 = 0.50; churn 2015-02: 1/2 = 0.50, 2015-03: 0/1 = 0.00
    assert corr["n"] == 2 and corr["corr"] == 1.0


def test_d42_segment_rank(spark):
    df = lines(spark, [{"customer_id": i, "sales": s, "profit": p} for i, s, p in [(1, 100, 10), (2, 100, 30)]])
    df = df.withColumn("customer_segment", F.when(F.col("customer_id") == 1, "A").otherwise("B"))
    out = rows(measures.segment_performance(df), "customer_segment", "margin_pct", "profit_rank")
    assert out == [("A", 10.0, 2), ("B", 30.0, 1)]
