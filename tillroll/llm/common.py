"""Shared pieces of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillroll.session import ensure_checkpoint_dir

#: A word: a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: The six ASCII white-space characters themselves.
BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the given folder, listed anew for each call."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settled(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder, with the lineage cut.

    The copy survives lost executors and goes away when nothing refers to it any
    more. Columns are renamed in place so that the result can be joined to itself.
    """
    ensure_checkpoint_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    return out.select(*[F.col(f"`{c}`").alias(c) for c in out.columns])


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the shared store."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def word_count(text) -> F.Column:
    """Number of words of a text column; null counts as an empty text."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def let(value, body) -> F.Column:
    """``body(value)`` with ``value`` evaluated once, whatever the body does with it."""
    return F.transform(F.array(value), body)[0]


def most_frequent(counts: DataFrame, word: str, limit: int) -> list:
    """The values of ``word`` with the largest counts ``n``, sorted: at most ``limit`` of them.

    A histogram of the counts, by steps of a sixteenth of a doubling, says from which count on
    the values fit, so no more than ``limit`` leave the executors. Values of one step are in
    or out together.
    """
    counts = settled(counts.withColumn("__step", F.floor(16 * F.log2("n")).cast("int")))
    least, room = None, limit
    for step, n in sorted(counts.groupBy("__step").count().collect(), reverse=True):
        room -= n
        if room < 0:
            break
        least = step
    return [] if least is None else sorted(r[0] for r in counts.where(F.col("__step") >= least).select(word).collect())


def numbered(df: DataFrame, group: list[str], order: list[str], out: str) -> DataFrame:
    """Adds ``out``, the 1-based place of each row in its group by ``order``.

    No group meets in one task: rows are range-partitioned on (group, order), numbered
    inside each (partition, group) cell, and shifted by the rows of the earlier cells of
    the group, of which there are at most one per partition. The range-partitioned rows
    are settled first, because their partition number is part of the key. Adaptive
    execution merges neighbouring ranges, so that they take as many files as their size asks.
    """
    keys = [*group, "__part"]
    ranged = settled(df.repartitionByRange(*group, *order)
                     .withColumn("__part", F.spark_partition_id()))
    cells = (ranged.groupBy(*keys).agg(F.count("*").alias("__n"))
             .withColumn("__before", F.coalesce(F.sum("__n").over(
                 Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
             .select(*[F.col(k).alias(f"__c_{k}") for k in keys], "__before"))
    placed = ranged.withColumn("__row", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    same = [F.col(k).eqNullSafe(F.col(f"__c_{k}")) for k in keys]
    return (placed.join(cells, same, "left")
            .withColumn(out, F.col("__before") + F.col("__row"))
            .drop("__part", "__row", "__before", *[f"__c_{k}" for k in keys]))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for undirected ``edges`` (a, b); component is the smallest node reachable.

    Alternates two star contractions until nothing changes. Each round is a grouped
    minimum (combined before the shuffle), settled, and a join of two plain exchanges, which
    adaptive execution may split: neither a chain nor a star with a huge centre gathers in
    one task.
    """
    def mins(pairs):
        return pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).select("u", "m")

    links = settled(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                    .where("u != v").distinct())
    before = None
    for _ in range(max_rounds):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (both.join(settled(mins(both)), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u != v").distinct())
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        links = settled(large.join(small, "u").select(F.explode(F.array(
            F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
            F.struct(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")))).alias("e"))
            .select("e.u", "e.v").where("u != v").distinct())
        state = links.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")),
                          F.count_distinct("u")).first()
        state = tuple(state)
        if state == before and state[0] == state[2]:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    nodes = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def rate_sums(groups: DataFrame, n: str = "n", y: str = "y") -> tuple:
    """Number of groups, sum n, sum y, sum n*n and sum y*y/n: five numbers, whatever the number of groups."""
    total, hits = F.col(n).cast("double"), F.col(y).cast("double")
    return tuple(groups.agg(F.count("*"), F.sum(n), F.sum(y), F.sum(total * total), F.sum(hits * hits / total)).first())


def beta_prior(k, total, hits, squares, rates, weakest: float = 2.0, strongest: float = 1e6) -> tuple[float, float]:
    """Beta(a, b) by moments from k groups: sum n, sum y, sum n*n, sum y*y/n.

    With too few groups, or no spread to measure, the prior is the flattest allowed one
    around the overall rate (itself pulled half an outcome inside 0..1).
    """
    k, total, hits = k or 0, total or 0, hits or 0
    p = (hits + 0.5) / (total + 1.0)
    noise, spare = p * (1 - p), (total - squares / total - (k - 1)) if total else 0.0
    strength = weakest
    if k > 1 and spare > 0:
        over = (rates - 2 * p * hits + p * p * total - noise * (k - 1)) / (noise * spare)
        strength = strongest if over <= 0 else min(strongest, max(weakest, 1.0 / over - 1.0))
    return p * strength, (1 - p) * strength
