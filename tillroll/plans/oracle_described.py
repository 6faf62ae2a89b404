"""Independent DuckDB SQL for the described analyses (see plans/oracle.py for
the exactness rules). Discrete quantiles are written with ROW_NUMBER and the
position ceil(p * n); correlations and z-scores from integer moments.
"""

from __future__ import annotations

from tillroll.plans.oracle import BASE, MSTART, cents, hu


def dbl(x: str) -> str:
    """Exact number -> correctly rounded DOUBLE (via its decimal text)."""
    return f"CAST(CAST(({x}) AS VARCHAR) AS DOUBLE)"


def _q(body: str) -> str:
    return BASE + body


def _pick(p: str) -> str:
    return f"GREATEST(CEIL(n * {p}), 1)"


def _corr(n, sx, sy, sxx, syy, sxy) -> str:
    vx = dbl(f"{n} * {sxx} - {sx} * {sx}")
    vy = dbl(f"{n} * {syy} - {sy} * {sy}")
    return (f"CASE WHEN {vx} > 0 AND {vy} > 0 THEN {dbl(f'{n} * {sxy} - {sx} * {sy}')} / sqrt({vx} * {vy}) END")


def _moments(x: str, y: str) -> str:
    """n, sx, sy, sxx, syy, sxy over integer columns x, y (rows where both are set)."""
    both = f"({x}) IS NOT NULL AND ({y}) IS NOT NULL"
    xv, yv = f"CAST(CASE WHEN {both} THEN {x} END AS HUGEINT)", f"CAST(CASE WHEN {both} THEN {y} END AS HUGEINT)"
    return (f"COUNT({xv}) AS n, SUM({xv}) AS sx, SUM({yv}) AS sy, SUM({xv} * {xv}) AS sxx, "
            f"SUM({yv} * {yv}) AS syy, SUM({xv} * {yv}) AS sxy")


_EMP = """
, per AS (SELECT o_custkey, MIN(CAST(o_orderdate AS DATE)) AS hire_date, MAX(CAST(o_orderdate AS DATE)) AS last_order
          FROM orders GROUP BY 1),
dend AS (SELECT MAX(CAST(o_orderdate AS DATE)) AS d FROM orders),
emp0 AS (
  SELECT c.c_custkey AS employee_id, c.c_mktsegment AS department,
         'ROLE_' || CAST(c.c_custkey % 12 AS VARCHAR) AS job_role, r.r_name AS ethnicity,
         CASE WHEN c.c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender,
         CAST(18 + c.c_custkey % 45 AS INTEGER) AS age, CAST(c.c_acctbal AS DECIMAL(18,2)) AS salary,
         CASE WHEN c.c_custkey % 3 = 0 THEN 'Yes' ELSE 'No' END AS overtime,
         CASE c.c_custkey % 4 WHEN 0 THEN 'Non-Travel' WHEN 1 THEN 'Travel_Rarely'
              WHEN 2 THEN 'Travel_Frequently' ELSE 'Travel_Rarely' END AS business_travel,
         per.hire_date,
         CASE WHEN per.last_order < CAST(dend.d - INTERVAL 180 DAY AS DATE) THEN per.last_order END AS exit_date
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
  JOIN per ON per.o_custkey = c.c_custkey CROSS JOIN dend),
emp AS (SELECT *, CASE WHEN exit_date IS NOT NULL THEN 'Yes' ELSE 'No' END AS attrition FROM emp0)
"""

_BRACKET = ("CASE WHEN age < 20 THEN '<20' ELSE CAST(CAST(floor(age / 10) * 10 AS INTEGER) AS VARCHAR) || '-' || "
            "CAST(CAST(floor(age / 10) * 10 + 9 AS INTEGER) AS VARCHAR) END")

# life table: one row per department and tenure year; running products and sums over the years as lists
_LIFE_TABLE = _EMP + """
, ten AS (SELECT department, CAST(floor(datediff('day', hire_date, COALESCE(exit_date, (SELECT d FROM dend))) / 365) AS INTEGER) AS t, exit_date FROM emp),
yrs AS (SELECT department, unnest(range(max(t) + 1)) AS y FROM ten GROUP BY department),
risk AS (SELECT yrs.department, y, count(*) FILTER (t >= y) AS r, count(*) FILTER (t = y AND exit_date IS NOT NULL) AS d,
                count(*) FILTER (t = y AND exit_date IS NULL) AS c FROM yrs JOIN ten USING (department) GROUP BY ALL),
ran AS (SELECT *, list(CAST(1 AS DOUBLE) - CAST(d AS DOUBLE) / CAST(r AS DOUBLE)) OVER w AS keeps,
               list(CASE WHEN r > d THEN CAST(d AS DOUBLE) / (CAST(r AS DOUBLE) * CAST(r - d AS DOUBLE)) ELSE 0 END) OVER w AS terms
        FROM risk WINDOW w AS (PARTITION BY department ORDER BY y)),
life AS (SELECT department, CAST(y AS INTEGER) AS tenure_years, r, d, c, CAST(d AS DOUBLE) / CAST(r AS DOUBLE) AS h,
                list_reduce(keeps, lambda a, b: a * b) AS s,
                list_reduce(keeps, lambda a, b: a * b) * sqrt(list_reduce(terms, lambda a, b: a + b)) AS se FROM ran)
"""


# every month of every state and sub-category, from its first sale to the last month of the data
_CALENDAR = (f", held AS (SELECT state_province, product_sub_category, {MSTART} AS month, SUM(sales) AS v FROM sales_line GROUP BY ALL), "
             "spine AS (SELECT state_province, product_sub_category, CAST(unnest(generate_series(min(month), (SELECT max(month) FROM held), INTERVAL 1 MONTH)) AS DATE) "
             "AS month FROM held GROUP BY state_province, product_sub_category), "
             "cal AS (SELECT spine.*, coalesce(v, 0) AS v, v IS NOT NULL AS present FROM spine LEFT JOIN held USING (state_province, product_sub_category, month)) ")
_CAL_KEYS = "state_province, product_sub_category, month, CAST(v AS DOUBLE) AS value"


def _factor_sql(facts: str, factors: tuple) -> str:
    """Gain and chi-square of each factor and pair, from facts (the factors, yes)."""
    sets = [(f,) for f in factors] + [(a, b) for i, a in enumerate(factors) for b in factors[i + 1:]]
    counts = " UNION ALL ".join(
        f"SELECT '{' x '.join(g)}' AS factor, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (yes) AS DOUBLE) AS y FROM facts GROUP BY {', '.join(g)}"
        for g in sets)
    bits = "(CASE WHEN {0} > 0 THEN -({0} / {1}) * log2({0} / {1}) ELSE 0 END)"

    def entropy(y, n):
        return f"({bits.format(y, n)} + {bits.format(f'({n} - {y})', n)})"

    return (facts + ", cells AS (" + counts + "), whole AS (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (yes) AS DOUBLE) AS y FROM facts), "
            "terms AS (SELECT factor, c.n, c.y, w.n AS wn, w.y AS wy, c.n / w.n * " + entropy("c.y", "c.n") + " AS h, "
            "(c.y - c.n * w.y / w.n) * (c.y - c.n * w.y / w.n) / c.n AS q FROM cells c, whole w), "
            "sums AS (SELECT factor, any_value(wn) AS wn, any_value(wy) AS wy, count(*) AS k, "
            "list_reduce(list_prepend(CAST(0 AS DOUBLE), list(h ORDER BY n, y)), lambda a, b: a + b) AS h, "
            "list_reduce(list_prepend(CAST(0 AS DOUBLE), list(q ORDER BY n, y)), lambda a, b: a + b) AS q FROM terms GROUP BY factor), "
            "told AS (SELECT factor, CAST(k AS INTEGER) AS cells, round(" + entropy("wy", "wn") + " - h, 9) AS gain, "
            "round(q * wn * wn / (wy * (wn - wy)), 6) AS chi2, CAST(k - 1 AS INTEGER) AS df, round(sqrt(q * wn * wn / (wy * (wn - wy)) / wn), 9) AS cramers_v FROM sums) "
            "SELECT *, CAST(row_number() OVER (ORDER BY gain DESC, factor) AS INTEGER) AS rank FROM told")


_COST = """
, demand AS (SELECT l_partkey AS item, CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS volume
             FROM lineitem GROUP BY 1),
quotes AS (SELECT l_partkey AS item, 'SUPPLIER_' || CAST(l_suppkey AS VARCHAR) AS supplier,
                  """ + hu("SUM(" + cents("CAST(l_extendedprice AS DECIMAL(18,2))") + ")",
                           "SUM(CAST(l_quantity AS BIGINT))") + """ AS price_c,
                  CAST(100000 * (l_suppkey % 3) AS HUGEINT) AS nre_c
           FROM lineitem GROUP BY l_partkey, l_suppkey),
pc AS (SELECT p_partkey AS item, """ + cents("CAST(p_retailprice AS DECIMAL(18,2))") + """ AS price_c FROM part),
comp AS (SELECT item, 'raw_material' AS component, """ + hu("price_c * 50", "100") + """ AS cost_c FROM pc
         UNION ALL SELECT item, 'labour', """ + hu("price_c * 30", "100") + """ FROM pc
         UNION ALL SELECT item, 'energy', """ + hu("price_c * 10", "100") + """ FROM pc),
units AS (SELECT item, 'MAKE' AS source, SUM(cost_c) AS unit_c FROM comp GROUP BY 1
          UNION ALL SELECT item, supplier, price_c FROM quotes),
nre AS (SELECT item, 'MAKE' AS source, CAST(200000 AS HUGEINT) AS nre_c FROM demand
        UNION ALL SELECT item, supplier, nre_c FROM quotes),
cap AS (SELECT item, volume, GREATEST(volume - 600, 0) AS units_short,
               CAST(CEIL(GREATEST(volume - 600, 0) / 600) AS BIGINT) AS machines FROM demand)
"""


def _quantile_sql(group: str, value: str, source: str, probs: dict) -> str:
    """CTE body: per group, exact discrete quantiles + n/min/max."""
    gsel = f"{group}, " if group else ""
    part = f"PARTITION BY {group} " if group else ""
    picks = ", ".join(f"MAX(CASE WHEN rn = {_pick(p)} THEN {value} END) AS {name}" for name, p in probs.items())
    grp = f"GROUP BY {group}" if group else ""
    return (f"SELECT {gsel}MAX(n) AS n, MAX(CASE WHEN rn = 1 THEN {value} END) AS min, "
            f"MAX(CASE WHEN rn = n THEN {value} END) AS max, {picks} FROM ("
            f"SELECT {gsel}{value}, ROW_NUMBER() OVER ({part}ORDER BY {value}) AS rn, "
            f"COUNT(*) OVER ({part.strip()}) AS n FROM {source} WHERE {value} IS NOT NULL) z {grp}")


_LINE_COLS = ["row_id", "order_priority", "customer_id", "customer_name", "ship_mode", "customer_segment",
              "product_category", "product_sub_category", "product_container", "product_name",
              "product_base_margin", "country", "region", "state_province", "city", "order_date", "ship_date",
              "discount", "unit_price", "shipping_cost", "profit", "quantity_ordered_new", "sales", "order_id",
              "return_order_id", "order_status"]

_CORR_COLS = ["sales", "profit", "quantity_ordered_new", "unit_price"]


def _corr_matrix() -> str:
    pairs = [(a, b) for i, a in enumerate(_CORR_COLS) for b in _CORR_COLS[i + 1:]]
    parts = []
    for a, b in pairs:
        parts.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, CAST(n AS BIGINT) AS n, "
                     f"{_corr('n', 'sx', 'sy', 'sxx', 'syy', 'sxy')} AS corr FROM "
                     f"(SELECT {_moments(cents(a), cents(b))} FROM sales_line) m")
    return " UNION ALL ".join(parts)


def _null_profile() -> str:
    parts = [f"SELECT '{c}' AS column, COUNT(*) - COUNT({c}) AS nulls, "
             f"CAST(COUNT(*) - COUNT({c}) AS DOUBLE) / CAST(COUNT(*) AS DOUBLE) * 100 AS pct FROM w"
             for c in _LINE_COLS]
    return (", w AS (SELECT sld.*, r.order_id AS return_order_id, r.order_status FROM sld "
            "LEFT JOIN o_return r ON sld.order_id = r.order_id) " + " UNION ALL ".join(parts))


def _ship_eff(keys: str) -> str:
    k = keys + ", " if keys else ""
    on = " AND ".join(f"a.{c.strip()} = qq.{c.strip()}" for c in (keys.split(",") if keys else []) + ["ship_mode"])
    return (f", l AS (SELECT {k}ship_mode, order_id, shipping_cost, profit, sales, "
            "CAST(datediff('day', order_date, ship_date) AS INTEGER) AS days FROM sales_line), "
            f"q AS (SELECT {k}ship_mode, days, ROW_NUMBER() OVER (PARTITION BY {k}ship_mode ORDER BY days) AS rn, "
            f"COUNT(*) OVER (PARTITION BY {k}ship_mode) AS n FROM l), "
            f"qq AS (SELECT {k}ship_mode, MAX(CASE WHEN rn = {_pick('0.5')} THEN days END) AS p50_days, "
            f"MAX(CASE WHEN rn = {_pick('0.9')} THEN days END) AS p90_days FROM q GROUP BY {k}ship_mode), "
            f"a AS (SELECT {k}ship_mode, COUNT(DISTINCT order_id) AS orders, SUM(days) AS dsum, COUNT(days) AS dn, "
            f"SUM(shipping_cost) AS c, SUM(profit) AS p, SUM(sales) AS s FROM l GROUP BY {k}ship_mode) "
            f"SELECT {', '.join('a.' + c.strip() for c in keys.split(','))  + ', ' if keys else ''}a.ship_mode, "
            "orders, CAST(" + hu("dsum * 100", "dn") + " AS DOUBLE) / 100 AS avg_days, p50_days, p90_days, "
            "CAST(c AS DOUBLE) AS shipping_cost, CAST(p AS DOUBLE) / CAST(s AS DOUBLE) * 100 AS margin_pct "
            f"FROM a JOIN qq ON {on}")


def _trend(period: str) -> str:
    fr = "OVER (ORDER BY period ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)"
    return (f", w AS (SELECT CAST(date_trunc('{period}', order_date) AS DATE) AS period, SUM(sales) AS s "
            "FROM sales_line GROUP BY 1) "
            "SELECT period, CAST(s AS DOUBLE) AS sales, CAST("
            + hu(f"SUM({cents('s')}) {fr}", f"COUNT(s) {fr}") + " AS DOUBLE) / 100 AS moving_avg FROM w")


_RATES = (", cm AS (SELECT DISTINCT customer_id, " + MSTART + " AS month FROM sales_line), "
          "act AS (SELECT month, COUNT(*) AS active FROM cm GROUP BY 1), "
          "kept AS (SELECT c.month, COUNT(*) AS kept FROM cm c JOIN cm p ON p.customer_id = c.customer_id "
          "AND p.month = CAST(c.month - INTERVAL 1 MONTH AS DATE) GROUP BY 1), "
          "pr AS (SELECT CAST(month + INTERVAL 1 MONTH AS DATE) AS month, active AS prior_customers FROM act "
          "WHERE month < (SELECT MAX(month) FROM act)), "
          "churn AS (SELECT pr.month, prior_customers, prior_customers - COALESCE(kept, 0) AS lost FROM pr "
          "LEFT JOIN kept ON pr.month = kept.month), "
          "ret AS (SELECT act.month, " + hu("COALESCE(kept, 0) * 100", "active") + " AS r_u FROM act "
          "LEFT JOIN kept ON act.month = kept.month) ")

_CLV = (", clv AS (SELECT customer_id, COUNT(DISTINCT order_id) AS orders, SUM(sales) AS s, "
        + hu("SUM(" + cents("sales") + ")", "COUNT(DISTINCT order_id)") + " AS aov_c, "
        "MIN(order_date) AS first_order, MAX(order_date) AS last_order, "
        "CAST(datediff('day', MIN(order_date), MAX(order_date)) AS INTEGER) AS span_days, "
        "SUM(profit) AS p, SUM(" + cents("profit") + ") AS p_c FROM sales_line GROUP BY customer_id) ")

ORACLE_DESCRIBED = {
    "total_ytd": _q(
        f", m AS (SELECT region, {MSTART} AS month, SUM(sales) AS v FROM sales_line GROUP BY 1, 2) "
        "SELECT region, month, CAST(v AS DOUBLE) AS value, CAST(SUM(v) OVER (PARTITION BY region, year(month) "
        "ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS ytd FROM m"),
    "total_ytd_calendar": _q(
        _CALENDAR + f"SELECT {_CAL_KEYS}, CAST(SUM(v) OVER (PARTITION BY state_province, product_sub_category, year(month) ORDER BY month) AS DOUBLE) AS ytd, "
        "present FROM cal"),
    "same_period_calendar": _q(
        _CALENDAR + f"SELECT {_CAL_KEYS}, CAST(p AS DOUBLE) AS prior, CAST(v - p AS DOUBLE) / nullif(CAST(p AS DOUBLE), 0) * 100 AS yoy_pct "
        "FROM (SELECT a.*, b.v AS p FROM cal a LEFT JOIN cal b ON a.state_province = b.state_province "
        "AND a.product_sub_category = b.product_sub_category AND b.month = a.month - INTERVAL 1 YEAR)"),
    "moving_average_calendar": _q(
        _CALENDAR + ", near AS (SELECT *, SUM(" + cents("v") + ") OVER w AS c, COUNT(*) OVER w AS n FROM cal WINDOW w AS "
        "(PARTITION BY state_province, product_sub_category ORDER BY month RANGE BETWEEN INTERVAL 3 MONTH PRECEDING AND CURRENT ROW)) "
        f"SELECT {_CAL_KEYS}, CAST({hu('c', 'n')} AS DOUBLE) / 100 AS moving_avg FROM near"),
    "mom_change_calendar": _q(
        _CALENDAR + f"SELECT {_CAL_KEYS}, CAST(v - p AS DOUBLE) / nullif(CAST(p AS DOUBLE), 0) * 100 AS mom_pct "
        "FROM (SELECT *, LAG(v) OVER (PARTITION BY state_province, product_sub_category ORDER BY month) AS p FROM cal)"),
    "rolling_customers": _q(
        f", seen AS (SELECT DISTINCT region, {MSTART} AS m, customer_id FROM sales_line), ends AS (SELECT DISTINCT region, "
        "CAST(m + to_months(CAST(k AS INTEGER)) AS DATE) AS month FROM seen, range(12) t(k) WHERE m + to_months(CAST(k AS INTEGER)) <= (SELECT max(m) FROM seen)) "
        "SELECT ends.region, month, COUNT(DISTINCT customer_id) AS customers FROM ends JOIN seen ON ends.region = seen.region "
        "AND m BETWEEN month - INTERVAL 11 MONTH AND month GROUP BY ALL"),
    "same_period_last_year": _q(
        f", m AS (SELECT {MSTART} AS month, SUM(sales) AS v FROM sales_line GROUP BY 1) "
        "SELECT a.month, CAST(a.v AS DOUBLE) AS value, CAST(b.v AS DOUBLE) AS prior, "
        "CAST(a.v - b.v AS DOUBLE) / CAST(b.v AS DOUBLE) * 100 AS yoy_pct "
        "FROM m a LEFT JOIN m b ON b.month = CAST(a.month - INTERVAL 12 MONTH AS DATE)"),
    "summarize": _q(
        "SELECT region, customer_segment, CAST(SUM(sales) AS DOUBLE) AS sales, CAST(SUM(profit) AS DOUBLE) AS profit, "
        "COUNT(*) AS lines FROM sales_line GROUP BY 1, 2"),
    "add_columns": _q(
        "SELECT region, customer_segment, CAST(SUM(sales) AS DOUBLE) AS sales, CAST(SUM(profit) AS DOUBLE) AS profit, "
        "COUNT(*) AS lines, CAST(SUM(profit) AS DOUBLE) / CAST(SUM(sales) AS DOUBLE) * 100 AS margin_pct "
        "FROM sales_line GROUP BY 1, 2"),
    "categorize": _q(
        "SELECT customer_id, CAST(t AS DOUBLE) AS t_sales, CASE WHEN t < 1000000 THEN 'Low' "
        "WHEN t < 3000000 THEN 'Medium' ELSE 'High' END AS band "
        "FROM (SELECT customer_id, SUM(sales) AS t FROM sales_line GROUP BY 1) x"),
    "value_if_single": _q(
        "SELECT city, COUNT(DISTINCT state_province) AS n_values, "
        "CASE WHEN COUNT(DISTINCT state_province) = 1 THEN MAX(state_province) END AS state_province "
        "FROM sales_line GROUP BY city"),
    "lookup_related": _q(
        "SELECT s.row_id, s.region, CAST(s.sales AS DOUBLE) AS sales, u.manager "
        "FROM sales_line s LEFT JOIN users u ON s.region = u.region"),
    "row_level_security": _q(
        "SELECT * FROM sld WHERE region IN (SELECT region FROM users WHERE manager = 'Chris')"),
    "bidirectional_filter": _q(
        "SELECT c_custkey AS customer_id, c_name, c_mktsegment FROM customer "
        "WHERE c_custkey IN (SELECT customer_id FROM sales_line WHERE product_category = 'PROMO')"),
    "kpi_summary": _q(
        "SELECT CAST(SUM(sales) AS DOUBLE) AS sales, CAST(SUM(profit) AS DOUBLE) AS profit, "
        "CAST(SUM(profit) AS DOUBLE) / CAST(SUM(sales) AS DOUBLE) * 100 AS margin_pct, "
        "COUNT(DISTINCT order_id) AS orders, COUNT(DISTINCT customer_id) AS customers, "
        "CAST(" + hu("SUM(" + cents("sales") + ")", "COUNT(DISTINCT order_id)") + " AS DOUBLE) / 100 AS aov "
        "FROM sales_line"),
    "geo_performance": _q(
        ", a AS (SELECT region, state_province, SUM(sales) AS s, SUM(profit) AS p FROM sales_line GROUP BY 1, 2), "
        "b AS (SELECT *, " + hu(f"SUM({cents('s')}) OVER (PARTITION BY region)", "COUNT(*) OVER (PARTITION BY region)")
        + " AS mean_c FROM a) "
        "SELECT region, state_province, CAST(s AS DOUBLE) AS sales, CAST(p AS DOUBLE) AS profit, "
        f"CAST({cents('s')} - mean_c AS DOUBLE) / 100 AS gap_to_region_mean FROM b"),
    "segment_performance": _q(
        "SELECT customer_segment, CAST(s AS DOUBLE) AS sales, CAST(p AS DOUBLE) AS profit, "
        "CAST(p AS DOUBLE) / CAST(s AS DOUBLE) * 100 AS margin_pct, "
        "CAST(RANK() OVER (ORDER BY p DESC) AS INTEGER) AS profit_rank "
        "FROM (SELECT customer_segment, SUM(sales) AS s, SUM(profit) AS p FROM sales_line GROUP BY 1) x"),
    "orders_by_category": _q(
        "SELECT product_category, COUNT(DISTINCT order_id) AS orders FROM sales_line GROUP BY 1"),
    "sales_by_weekday": _q(
        "SELECT CAST(isodow(order_date) - 1 AS INTEGER) AS weekday, dayname(order_date) AS day_name, "
        "CAST(SUM(sales) AS DOUBLE) AS sales FROM sales_line GROUP BY 1, 2"),
    "shipping_effectiveness": _q(_ship_eff("")),
    "shipping_effectiveness_by_state": _q(_ship_eff("state_province")),
    "region_sales_net_of_returns": _q(
        ", j AS (SELECT s.region, s.sales, CASE WHEN r.order_id IS NOT NULL THEN s.sales END AS rs "
        "FROM sales_line s LEFT JOIN o_return r ON s.order_id = r.order_id) "
        "SELECT region, CAST(SUM(sales) AS DOUBLE) AS gross, CAST(COALESCE(SUM(rs), 0) AS DOUBLE) AS returned, "
        "CAST(SUM(sales) - COALESCE(SUM(rs), 0) AS DOUBLE) AS net FROM j GROUP BY region"),
    "state_revenue": _q("SELECT state_province, CAST(SUM(sales) AS DOUBLE) AS revenue FROM sales_line GROUP BY 1"),
    "priority_by_customer": _q(
        "SELECT customer_id, order_priority, COUNT(*) AS lines FROM sales_line GROUP BY 1, 2"),
    "mom_change": _q(
        f", m AS (SELECT {MSTART} AS month, SUM(sales) AS s, SUM(profit) AS p FROM sales_line GROUP BY 1), "
        "x AS (SELECT month, s, p, "
        "CASE WHEN LAG(month) OVER (ORDER BY month) = CAST(month - INTERVAL 1 MONTH AS DATE) "
        "THEN LAG(s) OVER (ORDER BY month) END AS ps, "
        "CASE WHEN LAG(month) OVER (ORDER BY month) = CAST(month - INTERVAL 1 MONTH AS DATE) "
        "THEN LAG(p) OVER (ORDER BY month) END AS pp FROM m) "
        "SELECT month, CAST(s AS DOUBLE) AS sales, CAST(s - ps AS DOUBLE) / CAST(ps AS DOUBLE) * 100 AS sales_mom_pct, "
        "CAST(p AS DOUBLE) AS profit, CAST(p - pp AS DOUBLE) / CAST(pp AS DOUBLE) * 100 AS profit_mom_pct FROM x"),
    "weekly_trend": _q(_trend("week")),
    "monthly_trend": _q(_trend("month")),
    "seasonality_index": _q(
        f", mo AS (SELECT {MSTART} AS m, SUM(sales) AS s FROM sales_line GROUP BY 1), "
        "moy AS (SELECT CAST(month(m) AS INTEGER) AS month_of_year, SUM(s) AS sm, COUNT(*) AS cm FROM mo GROUP BY 1), "
        "t AS (SELECT SUM(sm) AS total, CAST(SUM(cm) AS BIGINT) AS cnt FROM moy) "
        f"SELECT month_of_year, cm AS months, {dbl('sm * cnt')} / {dbl('cm * total')} AS index FROM moy, t"),
    "sales_anomalies": _q(
        f", mo AS (SELECT {MSTART} AS month, SUM(sales) AS s FROM sales_line GROUP BY 1), "
        f"x AS (SELECT month, s, {cents('s')} AS xc, "
        "COUNT(s) OVER (ORDER BY month ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS n, "
        f"SUM({cents('s')}) OVER (ORDER BY month ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS sx, "
        f"SUM({cents('s')} * {cents('s')}) OVER (ORDER BY month ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS sxx "
        "FROM mo), "
        f"zz AS (SELECT month, s, n, {dbl('n * xc - sx')} AS a, {dbl('n * sxx - sx * sx')} AS b FROM x), "
        "z2 AS (SELECT month, s, n, CASE WHEN n >= 3 AND b > 0 THEN a / sqrt(b * n / (n - 1)) END AS z FROM zz) "
        "SELECT month, CAST(s AS DOUBLE) AS sales, n AS periods, z, abs(z) > 2 AS is_anomaly FROM z2"),
    "true_churn": _q(
        _RATES + "SELECT month, prior_customers, lost, CAST(" + hu("lost * 100", "prior_customers")
        + " AS DOUBLE) / 100 AS churn_rate FROM churn"),
    "churn_retention_corr": _q(
        _RATES + ", j AS (SELECT ret.r_u, " + hu("churn.lost * 100", "churn.prior_customers") + " AS c_u "
        "FROM ret JOIN churn ON ret.month = churn.month), "
        f"m AS (SELECT {_moments('r_u', 'c_u')} FROM j) "
        f"SELECT {_corr('n', 'sx', 'sy', 'sxx', 'syy', 'sxy')} AS corr, CAST(n AS BIGINT) AS n FROM m"),
    "customer_lifetime_value": _q(
        _CLV + "SELECT customer_id, orders, CAST(s AS DOUBLE) AS sales, CAST(aov_c AS DOUBLE) / 100 AS aov, "
        "first_order, last_order, span_days, CAST(p AS DOUBLE) AS profit, CAST(p AS DOUBLE) AS clv FROM clv"),
    "clv_drivers": _q(
        _CLV + " ".join([]) +
        " UNION ALL ".join(
            f"SELECT '{name}' AS driver, {_corr('n', 'sx', 'sy', 'sxx', 'syy', 'sxy')} AS corr, "
            f"CAST(n AS BIGINT) AS n FROM (SELECT {_moments(x, 'p_c')} FROM clv) m"
            for name, x in [("orders", "orders"), ("aov", "aov_c"), ("span_days", "span_days")])),
    "null_profile": _q(_null_profile()),
    "impute_median": _q(
        ", d AS (SELECT row_id, ship_mode, CASE WHEN datediff('day', order_date, ship_date) >= 0 "
        "THEN CAST(datediff('day', order_date, ship_date) AS INTEGER) END AS delivery_days FROM sales_line), "
        f"med AS ({_quantile_sql('ship_mode', 'delivery_days', 'd', {'m': '0.5'})}) "
        "SELECT d.row_id, d.ship_mode, COALESCE(d.delivery_days, med.m) AS delivery_days "
        "FROM d LEFT JOIN med ON d.ship_mode = med.ship_mode"),
    "iqr_outliers": _q(
        f", f AS ({_quantile_sql('product_category', 'sales', 'sales_line', {'q1': '0.25', 'q3': '0.75'})}) "
        "SELECT s.row_id, s.product_category, CAST(s.sales AS DOUBLE) AS sales, "
        "CAST(q1 - 1.5 * (q3 - q1) AS DOUBLE) AS lo, CAST(q3 + 1.5 * (q3 - q1) AS DOUBLE) AS hi, "
        "(s.sales < q1 - 1.5 * (q3 - q1)) OR (s.sales > q3 + 1.5 * (q3 - q1)) AS is_outlier "
        "FROM sales_line s LEFT JOIN f ON s.product_category = f.product_category"),
    "winsorize": _q(
        f", b AS ({_quantile_sql('', 'profit', 'sales_line', {'lo': '0.05', 'hi': '0.95'})}) "
        "SELECT row_id, CAST(profit AS DOUBLE) AS profit, CAST(LEAST(GREATEST(profit, lo), hi) AS DOUBLE) AS profit_w "
        "FROM sales_line CROSS JOIN b"),
    "box_stats": _q(
        f", b AS ({_quantile_sql('product_category', 'sales', 'sales_line', {'q1': '0.25', 'median': '0.5', 'q3': '0.75'})}) "
        "SELECT product_category, n, CAST(min AS DOUBLE) AS min, CAST(q1 AS DOUBLE) AS q1, "
        "CAST(median AS DOUBLE) AS median, CAST(q3 AS DOUBLE) AS q3, CAST(max AS DOUBLE) AS max FROM b"),
    "category_frequency": _q(
        "SELECT customer_segment AS value, COUNT(*) AS count, CAST(COUNT(*) AS DOUBLE) / "
        "CAST(SUM(COUNT(*)) OVER () AS DOUBLE) * 100 AS pct FROM sales_line GROUP BY 1"),
    "correlation_matrix": _q(_corr_matrix()),
    "binned_pairs": _q(
        "SELECT CAST(floor(sales / 10000) AS BIGINT) AS x_bin, CAST(floor(profit / 10000) AS BIGINT) AS y_bin, "
        "COUNT(*) AS n FROM sales_line GROUP BY 1, 2"),
    "deduplicate": _q(
        "SELECT order_id, row_id, customer_id, CAST(sales AS DOUBLE) AS sales FROM (SELECT *, "
        "ROW_NUMBER() OVER (PARTITION BY order_id ORDER BY row_id) AS rn FROM sales_line) x WHERE rn = 1"),
    "duplicate_summary": _q(
        "SELECT CAST(SUM(c) AS BIGINT) AS rows, COUNT(*) AS distinct_keys, CAST(SUM(c - 1) AS BIGINT) AS duplicate_rows, "
        "COUNT(*) FILTER (WHERE c > 1) AS duplicated_keys "
        "FROM (SELECT l_orderkey, l_linenumber, COUNT(*) AS c FROM lineitem GROUP BY 1, 2) x"),
    "inconsistent_names": (
        "WITH RECURSIVE names AS (SELECT p_name AS value, count(*) AS n, trim(regexp_replace(lower(p_name), '\\s+', ' ', 'g')) AS t FROM part "
        "WHERE p_name IS NOT NULL GROUP BY ALL), "
        "near AS (SELECT a.value AS a, b.value AS b FROM names a JOIN names b ON damerau_levenshtein(a.t, b.t) <= 2), "
        "reach AS (SELECT value AS a, value AS b FROM names UNION SELECT reach.a, near.b FROM reach JOIN near ON reach.b = near.a), "
        "grp AS (SELECT a AS value, min(b) AS g, count(*) AS spellings FROM reach GROUP BY a), "
        "best AS (SELECT g, arg_min(value, (-n, value)) AS canonical FROM grp JOIN names USING (value) GROUP BY g) "
        "SELECT v.value, v.n AS rows, canonical, spellings, CAST(damerau_levenshtein(v.t, c.t) AS INTEGER) AS distance "
        "FROM grp JOIN best USING (g) JOIN names v USING (value) JOIN names c ON c.value = canonical WHERE spellings > 1"),
    "validate": (
        "SELECT 'order_id_not_null' AS rule, COUNT(*) FILTER (WHERE l_orderkey IS NULL) AS violations FROM lineitem "
        "UNION ALL SELECT 'negative_sales', COUNT(*) FILTER (WHERE l_extendedprice < 0) FROM lineitem "
        "UNION ALL SELECT 'discount_out_of_range', COUNT(*) FILTER (WHERE l_discount NOT BETWEEN 0 AND 1) FROM lineitem "
        "UNION ALL SELECT 'customer_id_not_null', COUNT(*) FILTER (WHERE o_custkey IS NULL) FROM orders "
        "UNION ALL SELECT 'ship_before_order', COUNT(*) FROM lineitem, orders WHERE l_orderkey = o_orderkey "
        "AND CAST(l_shipdate AS DATE) < CAST(o_orderdate AS DATE) "
        "UNION ALL SELECT 'line_unique', COUNT(*) - COUNT(DISTINCT (l_orderkey, l_linenumber)) FROM lineitem "
        "UNION ALL SELECT 'order_unique', COUNT(*) - COUNT(DISTINCT o_orderkey) FROM orders "
        "UNION ALL SELECT 'region_unique', COUNT(*) - COUNT(DISTINCT r_name) FROM region "
        "UNION ALL SELECT 'lineitem_order_fk', COUNT(*) FROM lineitem ANTI JOIN orders ON l_orderkey = o_orderkey "
        "UNION ALL SELECT 'lineitem_part_fk', COUNT(*) FROM lineitem ANTI JOIN part ON l_partkey = p_partkey "
        "UNION ALL SELECT 'order_customer_fk', COUNT(*) FROM orders ANTI JOIN customer ON o_custkey = c_custkey"),
    "normalize": _q(
        ", b AS (SELECT MIN(sales) AS smin, MAX(sales) AS smax, MIN(profit) AS pmin, MAX(profit) AS pmax FROM sales_line) "
        "SELECT row_id, customer_segment, CAST(sales AS DOUBLE) AS sales, CAST(profit AS DOUBLE) AS profit, "
        "upper(trim(customer_segment)) AS customer_segment_norm, "
        "CAST(sales - smin AS DOUBLE) / CAST(smax - smin AS DOUBLE) AS sales_norm, "
        "CAST(profit - pmin AS DOUBLE) / CAST(pmax - pmin AS DOUBLE) AS profit_norm FROM sales_line CROSS JOIN b"),
    "attrition_by_year_top": _q(
        _EMP + "SELECT * FROM (SELECT CAST(year(exit_date) AS INTEGER) AS year, COUNT(*) AS leavers, "
        "CAST(RANK() OVER (ORDER BY COUNT(*) DESC) AS INTEGER) AS rank FROM emp WHERE exit_date IS NOT NULL "
        "GROUP BY 1) x WHERE rank <= 3"),
    "top_roles_per_department": _q(
        _EMP + "SELECT * FROM (SELECT department, job_role, COUNT(*) AS n, "
        "CAST(RANK() OVER (PARTITION BY department ORDER BY COUNT(*) DESC) AS INTEGER) AS rank "
        "FROM emp GROUP BY 1, 2) x WHERE rank <= 3"),
    "top_groups": _q(
        _EMP + "SELECT * FROM (SELECT ethnicity AS \"group\", COUNT(*) AS n, "
        "CAST(ROW_NUMBER() OVER (ORDER BY COUNT(*) DESC, ethnicity) AS INTEGER) AS rank FROM emp GROUP BY 1) x "
        "WHERE rank <= 3"),
    "age_brackets": _q(_EMP + f"SELECT {_BRACKET} AS bracket, COUNT(*) AS n FROM emp GROUP BY 1"),
    "avg_by_group": _q(
        _EMP + "SELECT ethnicity AS \"group\", CAST(" + hu("SUM(" + cents("salary") + ")", "COUNT(salary)")
        + " AS DOUBLE) / 100 AS avg, COUNT(*) AS n FROM emp GROUP BY 1"),
    "gender_by_bracket": _q(
        _EMP + f"SELECT {_BRACKET} AS bracket, COUNT(*) FILTER (WHERE gender = 'F') AS \"F\", "
        "COUNT(*) FILTER (WHERE gender = 'M') AS \"M\" FROM emp GROUP BY 1"),
    "gender_by_bracket_group": _q(
        _EMP + f"SELECT {_BRACKET} AS bracket, ethnicity AS \"group\", COUNT(*) FILTER (WHERE gender = 'F') AS \"F\", "
        "COUNT(*) FILTER (WHERE gender = 'M') AS \"M\" FROM emp GROUP BY 1, 2"),
    "snowflake_join": _q(
        "SELECT o.o_orderkey, CAST(o.o_orderdate AS DATE) AS order_date, c.c_name, n.n_name, r.r_name "
        "FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey "
        "JOIN region r ON n.n_regionkey = r.r_regionkey"),
    "review_history": _q(
        ", rv AS (SELECT customer_id AS employee_id, CAST(year(order_date) AS INTEGER) AS year, "
        + hu("SUM(" + cents("sales") + ")", "COUNT(sales)") + " AS r_c, COUNT(DISTINCT order_id) AS satisfaction "
        "FROM sales_line GROUP BY 1, 2) "
        "SELECT employee_id, year, CAST(r_c AS DOUBLE) / 100 AS rating, satisfaction, "
        "CAST(r_c - LAG(r_c) OVER (PARTITION BY employee_id ORDER BY year) AS DOUBLE) / 100 AS change FROM rv"),
    "hiring_trend": _q(
        _EMP + ", h AS (SELECT CAST(year(hire_date) AS INTEGER) AS year, COUNT(*) AS hires FROM emp GROUP BY 1) "
        "SELECT year, hires, CAST(SUM(hires) OVER (ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) "
        "AS BIGINT) AS cumulative FROM h"),
    "rate_by_factor": _q(
        _EMP + ", lg AS (SELECT 'overtime' AS factor, overtime AS value, attrition FROM emp "
        "UNION ALL SELECT 'business_travel', business_travel, attrition FROM emp "
        "UNION ALL SELECT 'department', department, attrition FROM emp "
        "UNION ALL SELECT 'job_role', job_role, attrition FROM emp) "
        "SELECT factor, value, COUNT(*) AS n, COUNT(*) FILTER (WHERE attrition = 'Yes') AS leavers, "
        "CAST(COUNT(*) FILTER (WHERE attrition = 'Yes') AS DOUBLE) / CAST(COUNT(*) AS DOUBLE) * 100 AS rate "
        "FROM lg GROUP BY 1, 2"),
    "rate_by_year": _q(
        _EMP + ", yrs AS (SELECT department, exit_date, UNNEST(range(year(hire_date), "
        "COALESCE(year(exit_date), (SELECT year(d) FROM dend)) + 1)) AS year FROM emp), "
        "a AS (SELECT department, CAST(year AS INTEGER) AS year, COUNT(*) AS headcount, "
        "COUNT(*) FILTER (WHERE year(exit_date) = year) AS leavers FROM yrs GROUP BY 1, 2), "
        "b AS (SELECT department, year, headcount, leavers, "
        "CAST(leavers AS DOUBLE) / CAST(headcount AS DOUBLE) * 100 AS rate FROM a) "
        "SELECT *, rate - LAG(rate) OVER (PARTITION BY department ORDER BY year) AS change, "
        "rate = MAX(rate) OVER (PARTITION BY department) AS is_peak FROM b"),
    "rate_by_tenure": _q(
        _EMP + ", t AS (SELECT department, CAST(floor(datediff('day', hire_date, "
        "COALESCE(exit_date, (SELECT d FROM dend))) / 365) AS INTEGER) AS tenure_years, exit_date FROM emp), "
        "a AS (SELECT department, tenure_years, COUNT(*) AS n, COUNT(*) FILTER (WHERE exit_date IS NOT NULL) AS leavers "
        "FROM t GROUP BY 1, 2) "
        "SELECT department, tenure_years, n, leavers, CAST(leavers AS DOUBLE) / CAST(n AS DOUBLE) * 100 AS rate, "
        "CAST(leavers AS DOUBLE) / CAST(n AS DOUBLE) * 100 > 25 AS above FROM a"),
    "rate_within_department": _q(
        _EMP + "SELECT department AS \"group\", overtime AS value, COUNT(*) AS n, COUNT(exit_date) AS leavers, "
        "CAST(COUNT(exit_date) AS DOUBLE) / CAST(COUNT(*) AS DOUBLE) * 100 AS rate FROM emp GROUP BY ALL"),
    "risky_tenure": _q(
        _EMP + ", t AS (SELECT department, CAST(floor(datediff('day', hire_date, COALESCE(exit_date, (SELECT d FROM dend))) / 365) AS INTEGER) "
        "AS y, COUNT(*) AS n, COUNT(exit_date) AS k FROM emp GROUP BY ALL), "
        "stop AS (SELECT department, MIN(y) AS y FROM t WHERE NOT CAST(k AS DOUBLE) / CAST(n AS DOUBLE) * 100 > 25 GROUP BY 1) "
        "SELECT t.department, MAX(t.y) FILTER (WHERE stop.y IS NULL OR t.y < stop.y) AS max_tenure "
        "FROM t LEFT JOIN stop ON t.department = stop.department GROUP BY 1"),
    "survival_by_tenure": _q(
        _LIFE_TABLE + "SELECT department, tenure_years, r AS at_risk, d AS leavers, c AS censored, h AS hazard, s AS survival, "
        "greatest(s - 1.96 * se, 0) AS lower, least(s + 1.96 * se, 1) AS upper FROM life"),
    "median_tenure": _q(
        _LIFE_TABLE + "SELECT department, max(r) AS employees, CAST(sum(d) AS BIGINT) AS leavers, min(tenure_years) FILTER (s <= 0.5) AS median_years, "
        "min(s) AS survival_at_end FROM life GROUP BY department"),
    "attrition_factors": _q(_factor_sql(
        _EMP + ", facts AS (SELECT *, " + _BRACKET + " AS age_bracket, exit_date IS NOT NULL AS yes FROM emp)",
        ("overtime", "business_travel", "department", "job_role", "gender", "ethnicity", "age_bracket"))),
    "return_factors": _q(_factor_sql(
        ", facts AS (SELECT *, order_id IN (SELECT order_id FROM o_return) AS yes FROM sales_line)",
        ("ship_mode", "product_category", "product_container", "order_priority", "customer_segment"))),
    "unit_cost": _q(_COST + "SELECT item, source, CAST(unit_c AS DOUBLE) / 100 AS unit_cost FROM units"),
    "extended_cost": _q(
        _COST + "SELECT u.item, source, volume, CAST(unit_c AS DOUBLE) / 100 AS unit_cost, "
        "CAST(unit_c * volume AS DOUBLE) / 100 AS extended_cost FROM units u JOIN demand d ON u.item = d.item"),
    "full_cost": _q(
        _COST + ", e AS (SELECT u.item, u.source, volume, unit_c, unit_c * volume AS ext_c, "
        "COALESCE(nre.nre_c, 0) AS nre_c FROM units u JOIN demand d ON u.item = d.item "
        "LEFT JOIN nre ON nre.item = u.item AND nre.source = u.source) "
        "SELECT item, source, volume, CAST(unit_c AS DOUBLE) / 100 AS unit_cost, CAST(ext_c AS DOUBLE) / 100 "
        "AS extended_cost, CAST(nre_c AS DOUBLE) / 100 AS nre, CAST(ext_c + nre_c AS DOUBLE) / 100 AS full_cost, "
        "CAST(" + hu("ext_c + nre_c", "volume") + " AS DOUBLE) / 100 AS full_unit_cost FROM e"),
    "incremental_capacity": _q(
        _COST + "SELECT item, volume, CAST(units_short AS BIGINT) AS units_short, machines, "
        "CAST(machines * 5000 AS DOUBLE) AS incremental_cost FROM cap"),
    "make_cost_breakdown": _q(
        _COST + "SELECT item, component, CAST(cost_c AS DOUBLE) / 100 AS unit_cost, "
        "(CAST(cost_c AS DOUBLE) / 100) / (CAST(SUM(cost_c) OVER (PARTITION BY item) AS DOUBLE) / 100) * 100 "
        "AS share FROM comp"),
    "shared_capacity": _q(
        _COST + ", it AS (SELECT item, volume, unit_c AS make_c, (SELECT min(price_c) FROM quotes WHERE quotes.item = demand.item) AS buy_c "
        "FROM demand JOIN units USING (item) WHERE source = 'MAKE'), "
        "queue AS (SELECT *, buy_c > make_c AND volume > 0 AS worth, coalesce(SUM(volume) FILTER (buy_c > make_c) OVER (ORDER BY buy_c - make_c DESC, item "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM it), "
        "made AS (SELECT *, CAST(if(worth, greatest(0, least(volume, 100000 - before)), 0) AS BIGINT) AS m FROM queue) "
        "SELECT item, volume, CAST(make_c AS DOUBLE) / 100 AS make_unit, CAST(buy_c AS DOUBLE) / 100 AS buy_unit, m AS make_units, "
        "volume - m AS buy_units, CAST(m * (buy_c - make_c) AS DOUBLE) / 100 AS saving FROM made"),
    "make_vs_buy": _q(
        _COST + ", mk AS (SELECT m.item, cap.volume, m.unit_c * cap.volume + 200000 + cap.machines * 500000 "
        "AS make_c FROM (SELECT item, unit_c FROM units WHERE source = 'MAKE') m JOIN cap ON m.item = cap.item), "
        "bq AS (SELECT q.item, supplier, q.price_c * d.volume + q.nre_c AS buy_c, "
        "ROW_NUMBER() OVER (PARTITION BY q.item ORDER BY q.price_c * d.volume + q.nre_c, supplier) AS rn "
        "FROM quotes q JOIN demand d ON q.item = d.item) "
        "SELECT mk.item, volume, CAST(make_c AS DOUBLE) / 100 AS make_full, supplier AS best_supplier, "
        "CAST(buy_c AS DOUBLE) / 100 AS buy_full, CASE WHEN buy_c IS NULL OR make_c <= buy_c THEN 'MAKE' ELSE 'BUY' END "
        "AS decision, CAST(abs(make_c - buy_c) AS DOUBLE) / 100 AS saving "
        "FROM mk LEFT JOIN (SELECT * FROM bq WHERE rn = 1) b ON mk.item = b.item"),
}
