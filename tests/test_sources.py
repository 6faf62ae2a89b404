"""Sources and sinks: declared-schema CSV (malformed values become NULL and are
counted, not fatal), Parquet export round trip, DESCRIBE."""

import os
import tempfile

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.operators import quality
from tillroll.sources.binding import sales_line
from tillroll.sources.tables import describe, export_parquet, read_csv_declared


def test_csv_declared_schema_and_export(spark, sf_small):
    root = tempfile.mkdtemp()
    lines = sales_line(spark, sf_small, ["row_id", "customer_id", "order_date", "sales"])
    csv_dir = os.path.join(root, "csv")
    lines.write.option("header", "true").csv(csv_dir)
    # one malformed line appended as its own file
    with open(os.path.join(csv_dir, "part-bad.csv"), "w") as fh:
        fh.write("row_id,customer_id,order_date,sales\nbad-row,not-a-number,2001-13-45,abc\n")
    schema = T.StructType([T.StructField("row_id", T.StringType()), T.StructField("customer_id", T.LongType()),
                           T.StructField("order_date", T.DateType()), T.StructField("sales", T.DecimalType(18, 2))])
    back = read_csv_declared(spark, csv_dir, schema)
    assert back.count() == lines.count() + 1
    checks = quality.row_rules(back, {"customer_id_not_null": F.col("customer_id").isNull(),
                                      "sales_not_null": F.col("sales").isNull()})
    assert {r["rule"]: r["violations"] for r in checks.collect()} == {"customer_id_not_null": 1, "sales_not_null": 1}
    out = os.path.join(root, "parquet")
    export_parquet(back.where(F.col("customer_id").isNotNull()), out, partition_by=["customer_id"])
    again = spark.read.parquet(out)
    assert again.count() == lines.count()
    assert again.agg(F.sum("sales")).collect()[0][0] == lines.agg(F.sum("sales")).collect()[0][0]
    assert {r["col_name"] for r in describe(back).collect()} == {"row_id", "customer_id", "order_date", "sales"}


def test_materialized_order_lines_answer_the_same(spark, sf_small):
    from tillroll.operators import aggregate as agg
    from tillroll.sources.materialize import materialize_sales_line, read_materialized
    path = os.path.join(tempfile.mkdtemp(), "sales_line")
    materialize_sales_line(spark, sf_small, path)
    mat = read_materialized(spark, path, ["region", "sales"])
    a = sorted(agg.region_sales_contribution(mat).collect())
    b = sorted(agg.region_sales_contribution(sales_line(spark, sf_small, ["region", "sales"])).collect())
    assert a == b
    one = read_materialized(spark, path, ["order_date"], months=["1995-01"])
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(order_month" in plan and one.count() > 0


def test_files_added_later_are_read(spark, tmp_path):
    from tillroll.sources.tables import read_table
    path = str(tmp_path / "nation.parquet")
    spark.range(10).write.parquet(path)
    assert read_table(spark, str(tmp_path), "nation").count() == 10
    spark.range(5).write.mode("append").parquet(path)
    assert read_table(spark, str(tmp_path), "nation").count() == 15
