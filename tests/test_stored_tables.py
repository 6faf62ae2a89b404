"""Stored lines and sketches: partition rewrites, pruned reads, merged sketches, rejected rows."""

import os

import pytest
from helpers import d, lines, rows
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.operators import calendar, quality
from tillroll.operators import text as tx
from tillroll.sources import materialize, sketches
from tillroll.sources.binding import sales_line, users
from tillroll.sources.tables import read_csv_with_rejects, reject_rules


def files(path):
    return {os.path.relpath(os.path.join(f, n), path): os.stat(os.path.join(f, n)).st_mtime_ns
            for f, _, names in os.walk(path) for n in names if n.endswith(".parquet")}


@pytest.fixture()
def stored(spark, sf_small, tmp_path):
    path = str(tmp_path / "lines")
    materialize.materialize_sales_line(spark, sf_small, path)
    return path


def test_update_rewrites_only_the_months_of_matching_rows(spark, sf_small, stored):
    before, old = files(stored), materialize.read_materialized(spark, stored).checkpoint()
    one = (F.col("product_name") == "red bolt 7") | (F.col("order_date") == d("1995-03-05"))
    months = materialize.relabel_materialized(spark, stored, one, {"product_sub_category": F.concat(F.lit("new "), "product_sub_category"), "discount": F.lit(0)})
    want = {r[0] for r in old.where(one).select(F.date_format("order_date", "yyyy-MM")).collect()}
    assert set(months) == want and 0 < len(want) < 80
    after = files(stored)
    kept = {f for f in before if f.split("=")[1].split("/")[0] not in want}
    assert kept and all(after[f] == before[f] for f in kept)
    assert not any(f.startswith("_rewrite") for f in os.listdir(stored))
    plain = old.withColumn("product_sub_category", F.when(one, F.concat(F.lit("new "), "product_sub_category")).otherwise(F.col("product_sub_category"))) \
        .withColumn("discount", F.when(one, F.lit(0)).otherwise(F.col("discount")).cast("decimal(18,2)"))
    new = materialize.read_materialized(spark, stored)
    assert new.exceptAll(plain).count() == 0 and plain.exceptAll(new).count() == 0
    assert materialize.relabel_materialized(spark, stored, F.col("sales") < -1, {"discount": F.lit(1)}) == [] and files(stored) == after


@pytest.mark.parametrize("stop", [0, 1, 2, 5])
def test_a_crash_is_finished_or_undone(spark, stored, monkeypatch, stop):
    """The process ends after ``stop`` renames; the next rewrite finds the table as it was or finishes the swaps."""
    change = {"discount": F.lit(0.5)}
    cond = F.col("order_id") % 40 == 3
    plain = materialize.read_materialized(spark, stored).withColumn("discount", F.when(cond, F.lit(0.5)).otherwise(F.col("discount")).cast("decimal(18,2)")).checkpoint()
    real, done = materialize._fs, [0]

    def limited(s, path):
        fs, hadoop = real(s, path)

        class Fs:
            def __getattr__(self, name):
                return getattr(fs, name)

            def rename(self, a, b):
                if done[0] == stop:
                    raise OSError("killed")
                done[0] += 1
                return fs.rename(a, b)
        return Fs(), hadoop

    old = rows(materialize.read_materialized(spark, stored, ["row_id", "discount"]), "row_id", "discount")
    monkeypatch.setattr(materialize, "_fs", limited)
    with pytest.raises(OSError):
        materialize.relabel_materialized(spark, stored, cond, change)
    monkeypatch.setattr(materialize, "_fs", real)
    if stop == 0:                                            # never committed
        assert rows(materialize.read_materialized(spark, stored, ["row_id", "discount"]), "row_id", "discount") == old
        materialize.relabel_materialized(spark, stored, cond, change)
    else:
        materialize.finish_rewrite(spark, stored)
    new = materialize.read_materialized(spark, stored)
    assert new.exceptAll(plain).count() == 0 and plain.exceptAll(new).count() == 0
    assert not any(f.startswith("_rewrite") for f in os.listdir(stored))


def test_update_equals_the_projection(spark, sf_small, stored):
    from tillroll.plans.named import DRIVER_PARAMS as P  # noqa: F401
    rules = [("PROMO", "PRO & MO")]
    projected = materialize.read_materialized(spark, stored, ["row_id", "product_category"]).withColumn(
        "product_category", F.replace("product_category", F.lit(rules[0][0]), F.lit(rules[0][1]))).checkpoint()
    materialize.relabel_materialized(spark, stored, F.contains("product_category", F.lit("PROMO")),
                                     {"product_category": F.replace("product_category", F.lit(rules[0][0]), F.lit(rules[0][1]))})
    assert rows(materialize.read_materialized(spark, stored, ["row_id", "product_category"]), "row_id", "product_category") == rows(projected, "row_id", "product_category")
    assert callable(tx.relabel)


def test_a_manager_reads_the_folders_of_the_own_regions(spark, sf_small, tmp_path):
    path = str(tmp_path / "by_region")
    materialize.materialize_sales_line(spark, sf_small, path, by_region=True)
    mine = materialize.read_for_manager(spark, path, users(spark, sf_small), "Chris", ["row_id", "sales"])
    assert "dynamicpruning" in mine._jdf.queryExecution().executedPlan().toString().lower()
    want = sales_line(spark, sf_small, ["row_id", "sales", "region"]).join(users(spark, sf_small).where("manager = 'Chris'"), "region")
    assert rows(mine, "row_id", "sales") == rows(want, "row_id", "sales")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        mine = materialize.read_for_manager(spark, path, users(spark, sf_small), "Chris", ["row_id", "sales"])
        assert mine.count() == want.count()
        counted = mine.groupBy().agg(F.sum("sales"))
        counted.collect()
        leaves = counted._jdf.queryExecution().executedPlan().collectLeaves()
        scans = [leaves.apply(i) for i in range(leaves.size())]
        read = {s.relation().location().rootPaths().apply(0).getName(): s.metrics().apply("numFiles").value() for s in scans if "FileScan" in s.toString()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert read["by_region"] == sum("region=AMERICA" in f for f in files(path)) < len(files(path))


def test_sketches_of_a_span_are_merged_without_the_lines(spark, sf_small, tmp_path):
    path = str(tmp_path / "sketches")
    sl = sales_line(spark, sf_small, ["order_date", "region", "product_category", "customer_id", "order_id", "sales"])
    sketches.store_sketches(sl, path)
    year = sketches.read_sketches(spark, path, "1996-01", "1996-12")
    got = sketches.merged(year, ["region"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "lineitem" not in plan and "PartitionFilters: [isnotnull(order_month" in plan
    lines_of = sl.where(F.year("order_date") == 1996)
    want = {r.region: r for r in lines_of.groupBy("region").agg(F.count_distinct("customer_id").alias("c"), F.count_distinct("order_id").alias("o"),
                                                              F.sum("sales").cast("double").alias("s"), F.count(F.lit(1)).alias("n")).collect()}
    sales = {r: sorted(float(x.sales) for x in lines_of.where(F.col("region") == r).select("sales").collect()) for r in want}
    for r in got.collect():
        w = want[r.region]
        assert (r.customers, r.orders, r.sales, r.lines) == (w.c, w.o, w.s, w.n)
        for p, value in ((0.5, r.median_sales), (0.9, r.p90_sales)):
            rank = sum(x <= value for x in sales[r.region]) / w.n
            assert abs(rank - p) < 0.03
    before = files(path)
    sketches.store_sketches(sl, path, months=["1996-05"])
    after = files(path)
    assert {f for f in before if f in after} == {f for f in before if "1996-05" not in f} and len(after) == len(before)


def test_large_counts_are_within_the_stated_error(spark):
    many = spark.range(200_000).select((F.col("id") % 60_000).alias("customer_id"), F.col("id").alias("order_id"), F.lit("r").alias("region"), F.lit("c").alias("product_category"),
                                       F.expr("date_add(DATE '2020-01-01', CAST(id % 700 AS INT))").alias("order_date"), F.col("id").cast("decimal(18,2)").alias("sales"))
    r = sketches.merged(sketches.build_sketches(many), ["region"]).first()
    assert abs(r.customers / 60_000 - 1) < 0.05 and abs(r.orders / 200_000 - 1) < 0.05
    assert abs(r.median_sales / 100_000 - 1) < 0.05


def test_rejected_records_are_told_from_missing_values(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,day,amount,note\n1,2020-01-02,3.50,fine\n2,,,\n x,2020-13-45,abc,bad all\n4,2020-02-03,1.00\n,2020-02-03,1.00,no id\n")
    (tmp_path / "b.csv").write_text("id,day,amount,note\n7,2020-03-04, 9 ,ok\n8,2020-03-04,1e999x,\"quoted, comma\"\n")
    schema = T.StructType([T.StructField("id", T.LongType(), False), T.StructField("day", T.DateType()), T.StructField("amount", T.DecimalType(18, 2)), T.StructField("note", T.StringType())])
    good, bad = read_csv_with_rejects(spark, str(tmp_path), schema)
    assert [(r.id, str(r.day), r.amount and float(r.amount), r.note) for r in good.orderBy("id").collect()] == [
        (1, "2020-01-02", 3.5, "fine"), (2, "None", None, None), (7, "2020-03-04", 9.0, "ok")]
    assert good.schema.simpleString() == "struct<id:bigint,day:date,amount:decimal(18,2),note:string>"
    got = {(os.path.basename(r.source_file), tuple(sorted((p.column or "", p.reason) for p in r.problems))): r.record for r in bad.collect()}
    assert got == {
        ("a.csv", (("amount", "not a decimal(18,2)"), ("day", "not a date"), ("id", "not a bigint"))): got[("a.csv", (("amount", "not a decimal(18,2)"), ("day", "not a date"), ("id", "not a bigint")))],
        ("a.csv", (("", "wrong number of fields"),)): "4,2020-02-03,1.00",
        ("a.csv", (("id", "missing"),)): ",2020-02-03,1.00,no id",
        ("b.csv", (("amount", "not a decimal(18,2)"),)): '8,2020-03-04,1e999x,"quoted, comma"'}
    rules = {r.rule: r.violations for r in quality.validate({"rejects": reject_rules(bad)}).collect()}
    assert rules == {"ingest: amount: not a decimal(18,2)": 2, "ingest: day: not a date": 1, "ingest: id: not a bigint": 1, "ingest: id: missing": 1,
                     "ingest: wrong number of fields": 1}


def test_months_without_sales_have_rows(spark):
    df = lines(spark, [{"region": "N", "order_date": "2019-11-05", "sales": 10}, {"region": "N", "order_date": "2020-02-01", "sales": 6},
                       {"region": "N", "order_date": "2020-02-09", "sales": 2}, {"region": "S", "order_date": "2020-04-30", "sales": 5},
                       {"region": None, "order_date": "2020-03-01", "sales": 1}, {"region": "S", "order_date": None, "sales": 99}])
    ytd = {(r.region, str(r.month)[:7]): (r.value, r.ytd, r.present) for r in calendar.total_ytd_calendar(df, ["region"]).collect()}
    assert ytd == {("N", "2019-11"): (10, 10, True), ("N", "2019-12"): (0, 10, False), ("N", "2020-01"): (0, 0, False), ("N", "2020-02"): (8, 8, True),
                   ("N", "2020-03"): (0, 8, False), ("N", "2020-04"): (0, 8, False), ("S", "2020-04"): (5, 5, True),
                   (None, "2020-03"): (1, 1, True), (None, "2020-04"): (0, 1, False)}
    avg = {str(r.month)[:7]: r.moving_avg for r in calendar.moving_average_calendar(df, ["region"]).where("region = 'N'").collect()}
    assert avg == {"2019-11": 10, "2019-12": 5, "2020-01": 3.33, "2020-02": 4.5, "2020-03": 2, "2020-04": 2}
    mom = {str(r.month)[:7]: r.mom_pct for r in calendar.mom_change_calendar(df, ["region"]).where("region = 'N'").collect()}
    assert mom == {"2019-11": None, "2019-12": -100, "2020-01": None, "2020-02": None, "2020-03": -100, "2020-04": None}
    prior = calendar.same_period_calendar(df, ["region"]).where("prior IS NOT NULL").collect()
    assert prior == []
    assert calendar.total_ytd_calendar(df.limit(0), ["region"]).collect() == []


def test_bucketed_customer_months_need_no_shuffle_by_customer(spark, sf_small, tmp_path):
    from tillroll.operators import customer as cust
    materialize.materialize_customer_months(spark, sf_small, "test_customer_months", str(tmp_path / "cm"), buckets=8)
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.sources.bucketing.autoBucketedScan.enabled")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        cm = materialize.read_customer_months(spark, "test_customer_months")
        sl = sales_line(spark, sf_small, ["customer_id", "customer_name", "order_date", "sales"], grain="order")
        for op, key in ((cust.retention_monthly, "monthly"), (cust.churn_monthly, "months"), (cust.true_churn, None), (cust.customer_month_retained_flag, None),
                        (cust.customer_first_order, None), (cust.customer_lifespan, None), (cust.coupon_eligibility, None)):
            got = op(cm)
            plan = got._jdf.queryExecution().executedPlan().toString()
            assert "hashpartitioning(customer_id" not in plan, op.__name__
            assert rows(got, *got.columns) == rows(op(sl), *got.columns), op.__name__
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
        spark.sql("DROP TABLE test_customer_months")
