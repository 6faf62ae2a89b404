"""Workforce analytics: attrition, demographics, hiring and reviews.

Input is an employee table (sources/binding.employees): employee_id,
department, job_role, ethnicity, gender, age, salary, overtime,
business_travel, hire_date, exit_date, attrition. Windows run on per-group
aggregates (years, departments, roles), never on raw employees.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions.columns import exact_avg, half_up_round, pct
from tillroll.operators.rank import top_k_per_group


def _d(c):
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def attrition_by_year_top(emp: DataFrame, k: int = 3) -> DataFrame:
    """Years with the most leavers: year, leavers, rank (ties kept, rank <= k)."""
    per = (emp.where(F.col("exit_date").isNotNull())
           .groupBy(F.year("exit_date").alias("year")).agg(F.count(F.lit(1)).alias("leavers")))
    ranked = per.withColumn("rank", F.rank().over(Window.orderBy(F.desc("leavers"))))
    return ranked.where(F.col("rank") <= k)


def top_roles_per_department(emp: DataFrame, k: int = 3) -> DataFrame:
    """The k most staffed job roles in each department (ties kept)."""
    per = emp.groupBy("department", "job_role").agg(F.count(F.lit(1)).alias("n"))
    return top_k_per_group(per, ["department"], [F.desc("n")], k, "rank", name="rank")


def top_groups(emp: DataFrame, column: str = "ethnicity", k: int = 3) -> DataFrame:
    """The k most frequent values of ``column`` (ties broken by value): group, n, rank."""
    per = emp.groupBy(F.col(column).alias("group")).agg(F.count(F.lit(1)).alias("n"))
    ranked = per.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "group")))
    return ranked.where(F.col("rank") <= k)


def age_bracket(age_col: str = "age"):
    """'<20', '20-29', '30-39', ... from an integer age."""
    lo = (F.floor(F.col(age_col) / 10) * 10).cast("int")
    return F.when(F.col(age_col) < 20, F.lit("<20")).otherwise(
        F.concat(lo.cast("string"), F.lit("-"), (lo + 9).cast("string")))


def age_brackets(emp: DataFrame) -> DataFrame:
    return emp.groupBy(age_bracket().alias("bracket")).agg(F.count(F.lit(1)).alias("n"))


def avg_by_group(emp: DataFrame, group: str = "ethnicity", measure: str = "salary") -> DataFrame:
    """Average ``measure`` per group, half-up to 2 dp (exact decimal)."""
    return emp.groupBy(F.col(group).alias("group")).agg(
        _d(half_up_round(exact_avg(measure), 2)).alias("avg"), F.count(F.lit(1)).alias("n"))


def gender_by_bracket(emp: DataFrame, with_group: bool = False, group: str = "ethnicity") -> DataFrame:
    """Employees per age bracket (x group) split into F and M columns (pivot
    with the values listed, so no extra pass to discover them)."""
    keys = [age_bracket().alias("bracket")] + ([F.col(group).alias("group")] if with_group else [])
    p = emp.groupBy(*keys).pivot("gender", ["F", "M"]).agg(F.count(F.lit(1)))
    return p.select(*[c for c in p.columns if c not in ("F", "M")],
                    F.coalesce("F", F.lit(0)).cast("bigint").alias("F"),
                    F.coalesce("M", F.lit(0)).cast("bigint").alias("M"))


def review_history(sl: DataFrame) -> DataFrame:
    """Yearly review per employee (employee := customer): rating = average line
    value that year (half-up 2 dp), satisfaction = orders that year, change =
    rating minus the previous review year's rating."""
    per = sl.groupBy(F.col("customer_id").alias("employee_id"), F.year("order_date").alias("year")).agg(
        half_up_round(exact_avg("sales"), 2).alias("_r"), F.count_distinct("order_id").alias("satisfaction"))
    prev = F.lag("_r").over(Window.partitionBy("employee_id").orderBy("year"))
    return per.select("employee_id", "year", _d("_r").alias("rating"), "satisfaction",
                      _d(F.col("_r") - prev).alias("change"))


def hiring_trend(emp: DataFrame) -> DataFrame:
    """Hires per year and the running total (window over one row per year)."""
    per = emp.groupBy(F.year("hire_date").alias("year")).agg(F.count(F.lit(1)).alias("hires"))
    run = F.sum("hires").over(Window.orderBy("year").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return per.select("year", "hires", run.alias("cumulative"))


def rate_by_factor(emp: DataFrame, flag: str = "attrition", factors: tuple = ("overtime", "business_travel",
                                                                              "department", "job_role"),
                   yes: str = "Yes") -> DataFrame:
    """Attrition rate per value of each factor: factor, value, n, leavers, rate %.

    The factors are unpivoted once (``stack``) and grouped together, so the
    employees are read and shuffled once for all factors.
    """
    parts = ", ".join(f"'{f}', CAST(`{f}` AS STRING)" for f in factors)
    long = emp.selectExpr(f"stack({len(factors)}, {parts}) AS (factor, value)", f"`{flag}` AS _flag")
    a = long.groupBy("factor", "value").agg(F.count(F.lit(1)).alias("n"),
                                            F.count_if(F.col("_flag") == yes).alias("leavers"))
    return a.select("factor", "value", "n", "leavers", pct("leavers", "n").alias("rate"))


def rate_within(emp: DataFrame, factor: str = "overtime", group: str = "department", flag: str = "attrition",
                yes: str = "Yes") -> DataFrame:
    """Attrition rate per value of ``factor`` inside each ``group``: group, value, n, leavers, rate %."""
    a = emp.groupBy(F.col(group).alias("group"), F.col(factor).alias("value")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(flag) == yes).alias("leavers"))
    return a.select("group", "value", "n", "leavers", pct("leavers", "n").alias("rate")).orderBy("group", "value")


def risky_tenure(emp: DataFrame, as_of, threshold: float = 25.0) -> DataFrame:
    """Per department, up to which tenure its rate stays above ``threshold`` percent without a
    break from its shortest tenure on: department, max_tenure (NULL when it never is)."""
    rates = rate_by_tenure(emp, as_of, threshold)
    upto = Window.partitionBy("department").orderBy("tenure_years")
    unbroken = rates.withColumn("_ok", F.min(F.col("above").cast("int")).over(upto))
    return (unbroken.groupBy("department").agg(F.max(F.when(F.col("_ok") == 1, F.col("tenure_years"))).alias("max_tenure"))
            .orderBy("department"))


def _active_years(emp: DataFrame, as_of) -> DataFrame:
    """One row per employee and calendar year employed (hire year .. exit year,
    or the year of ``as_of``); at most one row per year of tenure."""
    end = F.coalesce(F.year("exit_date"), F.year(F.lit(as_of) if not isinstance(as_of, F.Column) else as_of))
    return emp.select("employee_id", "department", "exit_date",
                      F.explode(F.sequence(F.year("hire_date"), end)).alias("year"))


def rate_by_year(emp: DataFrame, as_of) -> DataFrame:
    """Department attrition rate per year = leavers that year / employed that
    year (%), its change over the previous year, and whether it is the
    department's peak. ``as_of`` is the data's last date (a date or Column)."""
    years = _active_years(emp, as_of)
    a = years.groupBy("department", "year").agg(
        F.count(F.lit(1)).alias("headcount"),
        F.count_if(F.year("exit_date") == F.col("year")).alias("leavers"))
    w = Window.partitionBy("department")
    out = a.select("department", "year", "headcount", "leavers", pct("leavers", "headcount").alias("rate"))
    return (out.withColumn("change", F.col("rate") - F.lag("rate").over(w.orderBy("year")))
            .withColumn("is_peak", F.col("rate") == F.max("rate").over(w)))


def rate_by_tenure(emp: DataFrame, as_of, threshold: float = 25.0) -> DataFrame:
    """Attrition rate per department x completed tenure years (to exit, or to
    ``as_of``), and whether it is above ``threshold`` percent."""
    tenure = F.floor(F.datediff(F.coalesce("exit_date", F.lit(as_of) if not isinstance(as_of, F.Column) else as_of),
                                "hire_date") / 365).cast("int")
    a = emp.groupBy("department", tenure.alias("tenure_years")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("exit_date").isNotNull()).alias("leavers"))
    rate = pct("leavers", "n")
    return a.select("department", "tenure_years", "n", "leavers", rate.alias("rate"),
                    (rate > threshold).alias("above"))


# --- survival (D32) ----------------------------------------------------------

def survival_by_tenure(emp: DataFrame, as_of, by: str = "department", z: float = 1.96) -> DataFrame:
    """Kaplan-Meier life table per group and completed tenure year.

    An employee is at risk in every year up to the one of exit, or up to the one reached at
    ``as_of`` when still employed (censored: at risk in that year too, but no leaver). hazard
    = leavers / at risk, survival = the product of 1 - hazard up to the year, and the bounds
    are survival -/+ z standard errors after Greenwood, inside 0..1. Years without an event
    have a row. When nobody survives a year the standard error is 0.

    The employees are counted once per (group, year); a group's years, some dozens, are one
    array, over which the table is computed in order, so results do not depend on partitioning.
    """
    end = F.coalesce("exit_date", as_of if isinstance(as_of, F.Column) else F.lit(as_of))
    tenure = F.floor(F.datediff(end, "hire_date") / 365).cast("int")
    counts = (emp.where(F.col("hire_date").isNotNull()).groupBy(F.col(by).alias("group"), tenure.alias("year"))
              .agg(F.count(F.lit(1)).alias("n"), F.count("exit_date").alias("leavers"))
              .where("year >= 0"))
    group = (counts.groupBy("group").agg(F.max("year").alias("last"), F.sum("n").cast("long").alias("total"),
                                         F.map_from_entries(F.collect_list(F.struct("year", F.struct("n", "leavers")))).alias("at")))
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("leavers"))
    start = F.struct(F.col("total").alias("left"), F.lit(1.0).alias("survival"), F.lit(0.0).alias("sum"),
                     F.expr("CAST(array() AS array<struct<year:int,at_risk:bigint,leavers:bigint,censored:bigint,hazard:double,survival:double,se:double>>)").alias("rows"))

    def step(acc, year):
        here = F.coalesce(F.try_element_at("at", year), none)
        hazard = here["leavers"].cast("double") / acc["left"].cast("double")
        alive = acc["left"] - here["leavers"]
        survival = acc["survival"] * (F.lit(1.0) - hazard)
        total = acc["sum"] + F.when(alive > 0, here["leavers"].cast("double") / (acc["left"].cast("double") * alive.cast("double"))).otherwise(0.0)
        row = F.struct(year.alias("year"), acc["left"].alias("at_risk"), here["leavers"].alias("leavers"),
                       (here["n"] - here["leavers"]).alias("censored"), hazard.alias("hazard"), survival.alias("survival"),
                       (survival * F.sqrt(total)).alias("se"))
        return F.struct((acc["left"] - here["n"]).alias("left"), survival.alias("survival"), total.alias("sum"),
                        F.concat(acc["rows"], F.array(row)).alias("rows"))

    table = group.select("group", F.explode(F.aggregate(F.sequence(F.lit(0), "last"), start, step)["rows"]).alias("r"))
    s, se = F.col("r.survival"), F.col("r.se")
    return (table.select(F.col("group").alias(by), F.col("r.year").alias("tenure_years"), "r.at_risk", "r.leavers", "r.censored", "r.hazard",
                         "r.survival", F.greatest(s - z * se, F.lit(0.0)).alias("lower"), F.least(s + z * se, F.lit(1.0)).alias("upper"))
            .orderBy(by, "tenure_years"))


def median_tenure(emp: DataFrame, as_of, by: str = "department") -> DataFrame:
    """Per group: employees, leavers, the first tenure year by whose end at most half survive (NULL when
    more than half do at the end), and the survival at the end of the table."""
    life = survival_by_tenure(emp, as_of, by)
    return (life.groupBy(by).agg(F.max("at_risk").alias("employees"), F.sum("leavers").alias("leavers"),
                                 F.min(F.when(F.col("survival") <= 0.5, F.col("tenure_years"))).alias("median_years"),
                                 F.min("survival").alias("survival_at_end")).orderBy(by))


# --- key factors (D30) --------------------------------------------------------

def factor_importance(df: DataFrame, flag: str, yes: str, factors: tuple, pairs: bool = True) -> DataFrame:
    """Which factors, and pairs of factors, tell most about a yes/no outcome.

    One contingency cube holds the counts of every factor and every pair (GROUPING SETS: one
    scan, combined before one shuffle). Per factor or pair: number of cells, information gain
    in bits, chi-square against independence with its degrees of freedom, Cramer's V, and the
    rank by gain. A NULL value is a cell of its own. Sums run over the cells in order of their
    counts, so results do not depend on partitioning; gains are rounded to 9 decimals.
    """
    names = list(factors)
    sets = [(f,) for f in names] + ([(a, b) for i, a in enumerate(names) for b in names[i + 1:]] if pairs else [])
    label = F.lit(None).cast("string")
    for group in sets:
        mask = sum(1 << (len(names) - 1 - i) for i, f in enumerate(names) if f not in group)
        label = F.when(F.col("_id") == mask, F.lit(" x ".join(group))).otherwise(label)
    known = df.where(F.col(flag).isNotNull()).select(*names, (F.col(flag) == yes).alias("_yes"))
    cube = (known.groupingSets([[F.col(f) for f in group] for group in sets], *[F.col(f) for f in names])
            .agg(F.grouping_id().alias("_id"), F.count(F.lit(1)).alias("n"), F.count_if("_yes").alias("y")))
    cells = F.array_sort(F.collect_list(F.struct("n", "y")))
    per = (cube.withColumn("factor", label).groupBy("factor")
           .agg(F.sum("n").cast("double").alias("_n"), F.sum("y").cast("double").alias("_y"), cells.alias("cells")))

    def entropy(y, n):
        part = lambda k: F.when(k > 0, -(k / n) * F.log2(k / n)).otherwise(0.0)
        return part(y) + part(n - y)

    def over_cells(term):
        return F.aggregate("cells", F.lit(0.0), lambda a, c: a + term(c["n"].cast("double"), c["y"].cast("double")))

    n, y = F.col("_n"), F.col("_y")
    gain = F.round(entropy(y, n) - over_cells(lambda m, k: (m / n) * entropy(k, m)), 9)
    spread = over_cells(lambda m, k: (k - m * y / n) * (k - m * y / n) / m)
    mixed = (y > 0) & (y < n)
    chi2 = F.when(mixed, spread * n * n / (y * (n - y))).otherwise(0.0)
    out = per.select("factor", F.size("cells").alias("cells"), gain.alias("gain"), F.round(chi2, 6).alias("chi2"),
                     F.when(mixed, F.size("cells") - 1).otherwise(0).alias("df"), F.round(F.sqrt(chi2 / n), 9).alias("cramers_v"))
    # one row per factor and pair
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("gain"), "factor"))).orderBy("rank")
