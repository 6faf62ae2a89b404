import datetime as dt
from decimal import Decimal

from pyspark.sql import types as T

LINE_SCHEMA = T.StructType([
    T.StructField("row_id", T.StringType()),
    T.StructField("customer_id", T.LongType()),
    T.StructField("customer_name", T.StringType()),
    T.StructField("region", T.StringType()),
    T.StructField("state_province", T.StringType()),
    T.StructField("city", T.StringType()),
    T.StructField("ship_mode", T.StringType()),
    T.StructField("product_category", T.StringType()),
    T.StructField("product_sub_category", T.StringType()),
    T.StructField("product_name", T.StringType()),
    T.StructField("order_date", T.DateType()),
    T.StructField("ship_date", T.DateType()),
    T.StructField("sales", T.DecimalType(18, 2)),
    T.StructField("profit", T.DecimalType(18, 2)),
    T.StructField("order_id", T.LongType()),
])


def d(s):
    return dt.date.fromisoformat(s)


def m(x):
    return None if x is None else Decimal(str(x))


def lines(spark, rows):
    """Order lines from dicts; unspecified columns are NULL (row_id is generated)."""
    out = []
    for i, r in enumerate(rows):
        rec = {f.name: None for f in LINE_SCHEMA.fields}
        rec["row_id"] = f"r{i:05d}"
        for k, v in r.items():
            if k in ("order_date", "ship_date") and isinstance(v, str):
                v = d(v)
            if k in ("sales", "profit") and v is not None:
                v = m(v)
            rec[k] = v
        out.append(tuple(rec[f.name] for f in LINE_SCHEMA.fields))
    return spark.createDataFrame(out, LINE_SCHEMA)


def _key(t):
    return tuple((x is None, x if x is not None else 0) for x in t)


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=_key)
