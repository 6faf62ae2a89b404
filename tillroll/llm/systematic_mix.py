"""Mixing sources to target weights by systematic sampling.

Native: DataFrame and SQL expressions only. Sources share the corpus's words by weight
(5, 2, 1 repeating over the sources by code point, null last); a target stops at
``most`` times its source and the excess goes to the others by weight. Inside a source
every document expects target / size copies. Documents are put in order of size, the
expected copies are prefix-summed, one random offset per source is added, and a copy is
emitted for each integer boundary crossed. Since neighbours in that order are of nearly
equal size, the words taken miss the target by little more than the largest document.
All of it is exact integer arithmetic, so reruns and other engines agree.

Defined results: a null text has size 0; the null source is a source of its own, the
last; a source without words has target 0 and no copies; repeated rows are sampled each
(they have equal sizes, so which of them is taken does not matter); an empty table gives
an empty result.
"""

from __future__ import annotations

from math import prod

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import numbered, settled, word_count

BIG = "decimal(38,0)"
#: the random offset of a source is a multiple of 1/STEPS of a copy
STEPS = 2 ** 32


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: str = "mix") -> DataFrame:
    """One row per source: its size, its target, and the copies ``num / den`` a document expects.

    ``off`` is the random offset in units of 1 / den. Works on one row per source; the
    windows without a partition run over those alone.
    """
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("i") % len(weights) + 1).cast("int")).cast("long")
    per_source = (sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
                  .withColumn("i", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
                  .withColumn("w", weight))
    # Sources reach their cap in order of size / weight, compared as whole numbers. A
    # source is full when its cap is at most its share of what the fuller ones leave.
    fill = Window.orderBy(F.col("source_size") * F.expr(f"{prod(weights)} div w"), "i")
    whole = Window.partitionBy()
    cap = F.lit(most) * F.col("source_size")
    spent = F.coalesce(F.sum(cap).over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    filled = (per_source
              .withColumn("total", F.sum("source_size").over(whole))
              .withColumn("spent", spent)
              .withColumn("w_left", F.sum("w").over(fill.rowsBetween(0, Window.unboundedFollowing)))
              .withColumn("full", cap.cast(BIG) * F.col("w_left") <= F.col("w").cast(BIG) * (F.col("total") - F.col("spent")))
              .withColumn("rest", F.col("total") - F.coalesce(F.sum(F.when(F.col("full"), cap)).over(whole), F.lit(0)))
              .withColumn("w_open", F.sum(F.when(~F.col("full"), F.col("w"))).over(whole)))
    share = F.col("w").cast(BIG) * F.col("rest").cast(BIG)
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce("source", F.lit("")))), 1, 8), 16, 10)
    return (filled
            .withColumn("target", F.when(F.col("full"), cap.cast("double"))
                        .otherwise(share.cast("double") / F.col("w_open").cast("double")))
            .withColumn("num", F.when(F.col("full"), F.lit(most).cast(BIG)).otherwise(share))
            .withColumn("den", F.when(F.col("full"), F.lit(1).cast(BIG))
                        .otherwise((F.col("w_open").cast(BIG) * F.col("source_size")).cast(BIG)))
            .withColumn("draw", draw.cast(BIG))
            .withColumn("off", F.expr(f"CAST((draw * den) div {STEPS} AS {BIG})"))
            .select("source", "source_size", "target", "num", "den", "off"))


def sampled(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: str = "mix") -> DataFrame:
    """``copies`` and ``taken`` words for each row of ``sizes`` (doc_id, source, size).

    ``sizes`` is read several times, so pass it settled.
    """
    targets = source_targets(sizes, weights, most, seed)
    targets = settled(targets.select(F.col("source").alias("__source"), *targets.columns[1:]))
    placed = numbered(sizes, ["source"], ["size", "doc_id"], "place")
    crossed = (f"CAST((CAST(place AS {BIG}) * num + off) div den - "
               f"(CAST(place - 1 AS {BIG}) * num + off) div den AS BIGINT)")
    return (placed.join(targets, F.col("source").eqNullSafe(F.col("__source")), "left")
            .withColumn("copies", F.when(F.col("source_size") > 0, F.expr(crossed)).otherwise(F.lit(0)).cast("long"))
            .withColumn("taken", F.col("copies") * F.col("size"))
            .select("doc_id", "source", "size", "source_size", "target", "copies", "taken"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: str = "mix") -> DataFrame:
    """One row per document: size, its source's size and target, copies and words taken.

    The sizes are narrow: they are written to as many files as they fill, not to one for
    each part of the texts.
    """
    sizes = settled(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")).hint("rebalance"))
    return sampled(sizes, weights, most, seed)


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: str = "mix") -> DataFrame:
    """The documents themselves, each as often as the mix takes it (zero to ``most`` times).

    Rows of one doc_id, source and size are the same to the mix and share its copies evenly:
    equal rows are counted, the counts prefix-summed in order of a hash of the row, and a
    row takes the copies whose boundaries fall to it. Texts meet in a task only as one row
    of each of their kind.
    """
    key = ["__id", "__source", "__size"]
    copies = (mixed(docs, weights, most, seed).groupBy(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("size").alias("__size"))
              .agg(F.sum("copies").alias("__copies"), F.count("*").alias("__rows")))
    copies = settled(copies)
    rows = docs.select(F.struct(*docs.columns).alias("__all"), F.col("doc_id").alias("__d"), F.col("source").alias("__s"), word_count(F.col("text")).alias("__w"))

    def met(left: DataFrame, right: DataFrame) -> DataFrame:
        same = F.col("__d").eqNullSafe(F.col("__id")) & F.col("__s").eqNullSafe(F.col("__source")) & (F.col("__w") == F.col("__size"))
        return left.join(right, same)

    single = met(rows, copies.where("__rows = 1")).select("__all", F.col("__copies").cast("int").alias("__n"))
    placed = single
    if not copies.where("__rows > 1").isEmpty():
        placed = single.unionByName(dealt(met(rows, copies.where("__rows > 1")), key))
    return (placed.where("__n > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__n"))))
            .select("__all.*"))


def dealt(rows: DataFrame, key: list[str]) -> DataFrame:
    """(__all, __n): rows that share their key and its copies, with the copies that fall to each kind of row."""
    kinds = (rows.withColumn("__hash", F.xxhash64("__all"))
             .groupBy(*key, "__hash", "__copies", "__rows").agg(F.first("__all").alias("__all"), F.count("*").alias("__same")))
    before = F.coalesce(F.sum("__same").over(Window.partitionBy(*key).orderBy("__hash").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # the window runs over hashes and counts; the kinds themselves meet their shares by key and hash
    kinds = settled(kinds)
    shares = (kinds.select(*key, "__hash", "__copies", "__rows", "__same").withColumn("__before", before)
              .select(*[F.col(k).alias(f"__k{k}") for k in (*key, "__hash")],
                      F.expr("CAST((__copies * (__before + __same)) div __rows - (__copies * __before) div __rows AS INT)").alias("__n")))
    same = [F.col(k).eqNullSafe(F.col(f"__k{k}")) for k in (*key, "__hash")]
    return kinds.join(shares, same).select("__all", "__n")


#: DuckDB SQL of the query.
ORACLE = r"""
WITH sizes AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS ss, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS m,
         row_number() OVER (ORDER BY source NULLS LAST) AS i FROM sizes GROUP BY source
), wts AS (
  SELECT source, ss, i, CASE m WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, sum(ss) OVER () AS total FROM per
), steps AS (
  SELECT *, coalesce(sum(3 * ss) OVER (ORDER BY ss * (10 // w), i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent,
         sum(w) OVER (ORDER BY ss * (10 // w), i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS wl FROM wts
), filled AS (
  SELECT *, CAST(3 * ss AS HUGEINT) * wl <= CAST(w AS HUGEINT) * (total - spent) AS f FROM steps
), lam AS (
  SELECT *, total - coalesce(sum(CASE WHEN f THEN 3 * ss END) OVER (), 0) AS rest, sum(CASE WHEN NOT f THEN w END) OVER () AS wo FROM filled
), tgt AS (
  SELECT source, ss,
         CASE WHEN f THEN CAST(3 * ss AS DOUBLE) ELSE CAST(w * rest AS DOUBLE) / CAST(wo AS DOUBLE) END AS target,
         CASE WHEN f THEN CAST(3 AS HUGEINT) ELSE CAST(w * rest AS HUGEINT) END AS num,
         CASE WHEN f THEN CAST(1 AS HUGEINT) ELSE CAST(wo * ss AS HUGEINT) END AS den,
         CAST('0x' || substr(md5('mix:' || coalesce(source, '')), 1, 8) AS BIGINT) AS draw FROM lam
), place AS (
  SELECT doc_id, source, size, row_number() OVER (PARTITION BY source ORDER BY size, doc_id) AS p FROM sizes
), took AS (
  SELECT doc_id, place.source, size, ss, target,
         CASE WHEN ss > 0 THEN CAST((p * num + (draw * den) // 4294967296) // den - ((p - 1) * num + (draw * den) // 4294967296) // den AS BIGINT)
              ELSE 0 END AS copies
  FROM place JOIN tgt ON place.source IS NOT DISTINCT FROM tgt.source
)
SELECT doc_id, source, size, ss AS source_size, target, copies, CAST(copies * size AS BIGINT) AS taken FROM took
"""
