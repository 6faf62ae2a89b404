"""Hand-worked life tables and factor rankings."""

import math

import pytest
from helpers import d

from tillroll.operators import hr

EMP = "employee_id int, department string, hire_date date, exit_date date"


def test_life_table_counts_the_censored_as_at_risk(spark):
    # tenures at 2020-01-01: HR leavers after 0, 1, 1 years; still there after 1 and 3 years. IT: one leaver after 2 years.
    emp = spark.createDataFrame([
        (1, "HR", d("2019-01-01"), d("2019-06-01")), (2, "HR", d("2017-01-01"), d("2018-06-01")), (3, "HR", d("2017-01-01"), d("2018-07-01")),
        (4, "HR", d("2018-06-01"), None), (5, "HR", d("2016-06-01"), None), (6, "IT", d("2015-01-01"), d("2017-06-01")),
        (7, None, d("2019-06-01"), None), (8, "IT", None, None)], EMP)
    rows = {(r.department, r.tenure_years): r for r in hr.survival_by_tenure(emp, d("2020-01-01")).collect()}
    assert sorted((str(k[0]), k[1]) for k in rows) == [("HR", 0), ("HR", 1), ("HR", 2), ("HR", 3), ("IT", 0), ("IT", 1), ("IT", 2), ("None", 0)]
    got = [(r.at_risk, r.leavers, r.censored, r.hazard) for k, r in sorted(rows.items(), key=lambda x: (x[0][0] or "", x[0][1])) if k[0] == "HR"]
    assert got == [(5, 1, 0, 0.2), (4, 2, 1, 0.5), (1, 0, 0, 0.0), (1, 0, 1, 0.0)]
    assert [rows["HR", y].survival for y in range(4)] == pytest.approx([0.8, 0.4, 0.4, 0.4])
    se = 0.4 * math.sqrt(1 / (5 * 4) + 2 / (4 * 2))
    assert rows["HR", 1].lower == pytest.approx(max(0, 0.4 - 1.96 * se)) and rows["HR", 1].upper == pytest.approx(min(1, 0.4 + 1.96 * se))
    assert (rows["IT", 2].survival, rows["IT", 2].lower, rows["IT", 2].upper) == (0.0, 0.0, 0.0)
    median = {r.department: (r.employees, r.leavers, r.median_years) for r in hr.median_tenure(emp, d("2020-01-01")).collect()}
    assert median == {"HR": (5, 3, 1), "IT": (1, 1, 2), None: (1, 0, None)}
    assert hr.survival_by_tenure(emp.limit(0), d("2020-01-01")).collect() == []


def test_factors_are_ranked_by_what_they_tell(spark):
    # a decides the outcome, b is independent of it, c and e decide it only together
    rows = [(a, b, c, str(int(a) ^ int(c)), "Yes" if a == "1" else "No") for a in "01" for b in "xy" for c in "01" for _ in range(3)]
    df = spark.createDataFrame(rows + [("9", "9", "9", "9", None)], "a string, b string, c string, e string, left string")
    got = {r.factor: r for r in hr.factor_importance(df, "left", "Yes", ("a", "b", "c", "e")).collect()}
    assert len(got) == 10 and got["a"].gain == 1.0 and got["b"].gain == got["c"].gain == got["e"].gain == 0.0
    assert got["c x e"].gain == 1.0 and got["b x c"].gain == 0.0
    assert (got["a"].chi2, got["a"].df, got["a"].cramers_v) == (24.0, 1, 1.0) and (got["b"].chi2, got["c x e"].df) == (0.0, 3)
    assert [r.factor for r in sorted(got.values(), key=lambda r: r.rank)][:5] == ["a", "a x b", "a x c", "a x e", "c x e"]


def test_a_missing_value_is_a_cell_and_one_outcome_tells_nothing(spark):
    df = spark.createDataFrame([(None, "u", "Yes"), (None, "u", "Yes"), ("k", "u", "No"), ("k", None, "No")], "a string, b string, f string")
    got = {r.factor: (r.cells, r.gain, r.df) for r in hr.factor_importance(df, "f", "Yes", ("a", "b")).collect()}
    assert got["a"] == (2, 1.0, 1) and got["b"][0] == 2 and got["a x b"] == (3, 1.0, 2)
    one = hr.factor_importance(df.where("f = 'Yes'"), "f", "Yes", ("a",)).collect()
    assert [(r.gain, r.chi2, r.df) for r in one] == [(0.0, 0.0, 0)]
    assert hr.factor_importance(df.limit(0), "f", "Yes", ("a", "b")).collect() == []


def test_the_cube_is_one_scan(spark, sf_small):
    from tillroll.plans.described import attrition_factors
    plan = attrition_factors(spark, sf_small)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Expand") == 1
