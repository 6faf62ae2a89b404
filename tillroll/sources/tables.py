"""Reading stored tables.

Parquet is the default: Catalyst pushes filters into the scan and prunes
columns, so callers never select columns by hand before filtering.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DRIVER_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table as a DataFrame (lazy), with the files that are there now."""
    return spark.read.parquet(table_path(sf_dir, name))


def register_views(spark: SparkSession, sf_dir: str, names=DRIVER_TABLES) -> None:
    """Register driver tables as temp views for ``spark.sql``."""
    for name in names:
        if os.path.exists(table_path(sf_dir, name)):
            read_table(spark, sf_dir, name).createOrReplaceTempView(name)


def read_csv_declared(spark: SparkSession, path: str, schema: T.StructType, **options) -> DataFrame:
    """CSV with a declared schema (no inference pass over the data).

    ``mode=PERMISSIVE`` keeps malformed rows as NULLs so the validation operator
    can count them instead of the job failing on the first bad line.
    """
    reader = spark.read.schema(schema).option("header", "true").option("mode", "PERMISSIVE")
    for key, value in options.items():
        reader = reader.option(key, value)
    return reader.csv(path)


def read_csv_with_rejects(spark: SparkSession, path: str, schema: T.StructType, formats: dict[str, str] | None = None,
                          **options) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of CSV files with a declared schema: no bad value becomes a silent NULL.

    Every field is read as text and converted to its declared type. A record goes to the
    rejects when a field does not convert, a non-nullable field is empty, or the number of
    fields is wrong; the others are rows of the declared schema. ``rejects`` has the
    source_file, the record as CSV text, and ``problems``, one (column, value, reason) per
    fault. ``formats`` gives date or timestamp patterns by column.
    """
    raw = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields] + [T.StructField("_malformed", T.StringType())])
    reader = spark.read.schema(raw).option("header", "true").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_malformed")
    for key, value in options.items():
        reader = reader.option(key, value)
    texts = reader.csv(path).withColumn("_file", F.col("_metadata.file_path"))
    typed, problems = {}, []
    for field in schema.fields:
        text = F.col(f"`{field.name}`")
        pattern = (formats or {}).get(field.name)
        value = (F.try_to_timestamp(text, F.lit(pattern)) if pattern else F.trim(text)).try_cast(field.dataType) \
            if not isinstance(field.dataType, T.StringType) else text
        typed[field.name] = value
        wrong = F.when(text.isNotNull() & value.isNull(), F.lit(f"not a {field.dataType.simpleString()}"))
        if not field.nullable:
            wrong = F.when(text.isNull(), F.lit("missing")).otherwise(wrong)
        problems.append(F.when(wrong.isNotNull(), F.struct(F.lit(field.name).alias("column"), text.alias("value"), wrong.alias("reason"))))
    problems.append(F.when(F.col("_malformed").isNotNull(), F.struct(F.lit(None).cast("string").alias("column"), F.col("_malformed").alias("value"),
                                                                     F.lit("wrong number of fields").alias("reason"))))
    judged = texts.withColumn("problems", F.array_compact(F.array(*problems)))
    record = F.coalesce("_malformed", F.to_csv(F.struct(*[F.col(f"`{f.name}`") for f in schema.fields])))
    rows = judged.where(F.size("problems") == 0).select(*[typed[f.name].alias(f.name) for f in schema.fields])
    rejects = judged.where(F.size("problems") > 0).select(F.col("_file").alias("source_file"), record.alias("record"), "problems")
    return rows, rejects


def reject_rules(rejects: DataFrame) -> DataFrame:
    """rule, violations: rejected values by column and reason, to stand beside the rules of ``validate``."""
    each = rejects.select(F.explode("problems").alias("p"))
    rule = F.concat_ws(": ", F.lit("ingest"), "p.column", "p.reason")
    return each.groupBy(rule.alias("rule")).agg(F.count(F.lit(1)).alias("violations"))


def read_jdbc(spark: SparkSession, url: str, query_or_table: str, partition_column: str | None = None,
              lower_bound: int | None = None, upper_bound: int | None = None,
              num_partitions: int = 64, **options) -> DataFrame:
    """Database extraction through Spark's JDBC source, split into parallel range reads.

    No database runs in this repository, so this is exercised only in the docs;
    the partitioned form is what a cluster needs (one connection per partition).
    """
    reader = spark.read.format("jdbc").option("url", url)
    if query_or_table.lstrip().lower().startswith("select"):
        # a parenthesised subquery as table: ``query`` does not go with partitionColumn
        reader = reader.option("dbtable", f"({query_or_table.strip().rstrip(';')}) AS extracted")
    else:
        reader = reader.option("dbtable", query_or_table)
    if partition_column is not None:
        reader = (reader.option("partitionColumn", partition_column)
                  .option("lowerBound", str(lower_bound)).option("upperBound", str(upper_bound))
                  .option("numPartitions", str(num_partitions)))
    for key, value in options.items():
        reader = reader.option(key, value)
    return reader.load()


def export_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None,
                   mode: str = "overwrite") -> None:
    """Write a result for a BI tool (the reference's temp-table export)."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


# Spark type -> SQL-standard type name, as a SQL DESCRIBE prints it.
SQL_TYPE_NAMES = {
    "string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "smallint": "SMALLINT",
    "tinyint": "TINYINT", "double": "DOUBLE", "float": "FLOAT", "boolean": "BOOLEAN",
    "date": "DATE", "timestamp": "TIMESTAMP WITH TIME ZONE", "timestamp_ntz": "TIMESTAMP",
    "binary": "BLOB",
}


def sql_type_name(dtype: T.DataType) -> str:
    if isinstance(dtype, T.DecimalType):
        return f"DECIMAL({dtype.precision},{dtype.scale})"
    simple = dtype.simpleString()
    return SQL_TYPE_NAMES.get(simple, simple.upper())


def describe(df: DataFrame) -> DataFrame:
    """Column names, SQL type names and the number of non-NULL values, a row per column:
    one aggregate of the table, unpivoted."""
    row = df.agg(*[F.count(f.name).alias(f.name) for f in df.schema.fields])
    entries = [F.struct(F.lit(f.name).alias("col_name"), F.lit(sql_type_name(f.dataType)).alias("data_type"),
                        F.col(f.name).alias("non_null")) for f in df.schema.fields]
    return row.select(F.explode(F.array(*entries)).alias("c")).select("c.*")
