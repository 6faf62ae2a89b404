"""Inconsistent duplicates: spellings of one value that are not equal but nearly so.

Two spellings belong together when at most ``k`` edits (insert, delete, replace, swap two
neighbours: Damerau-Levenshtein) turn one into the other, after lower-casing and
collapsing blanks.

Candidates come from blocks of positional n-grams, without loss: a string is cut into
2k + 1 segments; an edit touches two of them at most (a swap across a border), so one
segment stays as it is and is found in the other string, moved by at most k places. The
shorter string is indexed by its segments, the longer one looks them up for each length it
may meet. Spark's own banded ``levenshtein`` (a swap costs 2 there, so 2k is its bound)
filters the pairs as they come out of the join; the few left get the exact distance.

A segment that very many strings share (a common prefix) makes a hot block. Its indexed
rows are dealt to as many parts as their number asks for, and those that look it up visit
all parts, so the pairs of a block are compared in many tasks and only links leave them.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.operators.graph import connected_components


def edit_distance(a: str, b: str) -> int:
    """Damerau-Levenshtein distance of two strings (swapped neighbours count once, also around later edits)."""
    last_row: dict[str, int] = {}
    far = len(a) + len(b)
    cost = [[far] * (len(b) + 2) for _ in range(len(a) + 2)]
    for i in range(len(a) + 1):
        cost[i + 1][1] = i
    for j in range(len(b) + 1):
        cost[1][j + 1] = j
    for i, x in enumerate(a, 1):
        last_col = 0
        for j, y in enumerate(b, 1):
            row, col = last_row.get(y, 0), last_col
            if x == y:
                last_col = j
            cost[i + 1][j + 1] = min(cost[i][j] + (x != y), cost[i + 1][j] + 1, cost[i][j + 1] + 1,
                                     cost[row][col] + (i - row - 1) + 1 + (j - col - 1))
        last_row[x] = i
    return cost[-1][-1]


@F.pandas_udf(T.IntegerType())
def _edit_distances(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([edit_distance(x, y) for x, y in zip(a, b)], dtype="int32")


def spelling(c) -> F.Column:
    """The form that is compared: lower case, blanks collapsed and trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def _segments(length, k: int, of=None, shift=0):
    """Hashes (length, number, text) of the 2k + 1 segments of a string of ``length``, read from ``of`` moved by ``shift``."""
    m = 2 * k + 1
    out = []
    for i in range(m):
        start, end = F.floor(length * i / m), F.floor(length * (i + 1) / m)
        inside = (start + shift >= 0) & (end + shift <= F.length(of))
        text = F.substring(of, (start + shift + 1).cast("int"), (end - start).cast("int"))
        out.append(F.when(inside, F.xxhash64(length.cast("int"), F.lit(i), text)))
    return out


def near_spellings(texts: DataFrame, k: int = 2, block: int = 1000) -> DataFrame:
    """(a, b, distance) for all pairs a, b of the distinct non-null strings ``texts`` (t) at most ``k`` edits apart."""
    t, n = F.col("t"), F.length("t")
    index = texts.select("t", F.explode(F.array_distinct(F.array(*_segments(n, k, t)))).alias("key"))
    asked = [h for shorter in range(k + 1) for shift in range(-k, k + 1)
             for h in _segments(n - shorter, k, t, shift)]
    lookups = texts.select(t.alias("u"), F.explode(F.array_distinct(F.array_compact(F.array(*asked)))).alias("key"))
    hot = (index.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > block)
           .select(F.col("key").alias("hot_key"), F.ceil(F.col("c") / block).cast("int").alias("parts")))
    parts = F.coalesce("parts", F.lit(1))
    index = (index.join(hot, F.col("key") == F.col("hot_key"), "left")
             .select("t", "key", F.pmod(F.xxhash64("t"), parts).cast("int").alias("part")))
    lookups = (lookups.join(hot, F.col("key") == F.col("hot_key"), "left")
               .select("u", "key", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part")))
    ordered = (F.length("t") < F.length("u")) | ((F.length("t") == F.length("u")) & (F.col("t") < F.col("u")))
    met = index.join(lookups, ["key", "part"]).where(ordered)
    edits = met.withColumn("edits", F.levenshtein("t", "u", 2 * k)).where("edits >= 0").select("t", "u", "edits").distinct()
    sure = edits.where("edits <= 1").select("t", "u", F.col("edits").alias("distance"))
    rest = edits.where("edits > 1").select("t", "u", _edit_distances("t", "u").alias("distance")).where(F.col("distance") <= k)
    return sure.unionByName(rest).select(F.least("t", "u").alias("a"), F.greatest("t", "u").alias("b"), "distance")


def inconsistent_values(df: DataFrame, column: str, k: int = 2) -> DataFrame:
    """Spellings of ``column`` that belong to one value: value, rows, canonical, spellings, distance.

    ``canonical`` is the most frequent spelling of the group (the least one if tied), ``spellings``
    the size of the group, ``distance`` the edits between value and canonical as compared.
    Groups are linked spellings, so two of them may be more than ``k`` edits apart. NULLs
    belong to nothing; values with one spelling have no row.
    """
    # one row per spelling; everything after works on distinct spellings
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("rows"))
    counts = counts.withColumn("t", spelling("value"))
    texts = counts.select("t").distinct()
    groups = connected_components(near_spellings(texts, k).select("a", "b"))
    member = (counts.join(groups, F.col("t") == F.col("node"), "left")
              .select("value", "rows", "t", F.coalesce("component", "t").alias("group")))
    best = (member.groupBy("group").agg(F.min(F.struct((-F.col("rows")).alias("r"), "value", "t")).alias("best"), F.count(F.lit(1)).alias("spellings"))
            .where("spellings > 1").select(F.col("group").alias("_group"), F.col("best.value").alias("canonical"), F.col("best.t").alias("_t"), "spellings"))
    rows = member.join(best, F.col("group") == F.col("_group"))
    near = F.levenshtein("t", "_t")
    same = rows.where(near <= 1).select("value", "rows", "canonical", "spellings", near.alias("distance"))
    other = rows.where(near > 1).select("value", "rows", "canonical", "spellings", _edit_distances("t", "_t").alias("distance"))
    return same.unionByName(other)


def harmonized(df: DataFrame, column: str, groups: DataFrame, name: str | None = None) -> DataFrame:
    """``df`` with each spelling replaced by its canonical one; ``groups`` is the result of ``inconsistent_values``."""
    change = groups.where(F.col("value") != F.col("canonical")).select(F.col("value").alias("_value"), F.col("canonical").alias("_canonical"))
    return (df.join(change, F.col(column) == F.col("_value"), "left")
            .withColumn(name or column, F.coalesce("_canonical", F.col(column))).drop("_value", "_canonical"))
