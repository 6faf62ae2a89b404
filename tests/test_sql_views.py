"""Reference-style SQL over the registered views gives the operators' answers."""

from helpers import rows
from pyspark.sql import functions as F

from tillroll.sources.binding import register_analytic_views, sales_line


def test_sql_views_match_operators(spark, sf_small):
    register_analytic_views(spark, sf_small)
    dear = spark.sql("SELECT product_category, ship_mode, COUNT_IF(sales > 10 * unit_price) AS lines FROM orders "
                     "GROUP BY GROUPING SETS ((product_category), (ship_mode))")
    sl = sales_line(spark, sf_small, ["product_category", "ship_mode", "sales", "unit_price"]).withColumn("dear", F.col("sales") > 10 * F.col("unit_price"))
    per = [sl.groupBy(c).agg(F.count_if("dear").alias("lines")) for c in ("product_category", "ship_mode")]
    want = per[0].unionByName(per[1], allowMissingColumns=True)
    assert rows(dear, "product_category", "ship_mode", "lines") == rows(want, "product_category", "ship_mode", "lines")

    late = spark.sql("SELECT manager, COUNT(DISTINCT city) AS cities FROM orders NATURAL JOIN users "
                     "WHERE ship_date > order_date + INTERVAL 90 DAY GROUP BY manager")
    sl = sales_line(spark, sf_small, ["region", "city", "ship_date", "order_date"])
    want = (sl.where(F.datediff("ship_date", "order_date") > 90).join(spark.table("users"), "region")
            .groupBy("manager").agg(F.countDistinct("city").alias("cities")))
    assert rows(late, "manager", "cities") == rows(want, "manager", "cities")

    semi = spark.sql("SELECT COUNT(*) AS n FROM orders WHERE order_id IN (SELECT order_id FROM o_return)")
    assert semi.collect()[0]["n"] == sales_line(spark, sf_small, ["order_id"]).join(
        spark.table("o_return"), "order_id", "left_semi").count()
