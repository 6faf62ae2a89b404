"""Near-duplicate vectors by an exact metric range join.

Vectors of one label are parted by pivots, each going to the cell of its nearest pivot.
On the unit sphere two vectors of cosine c are sqrt(2 - 2c) apart, so a vector is copied
to every other cell whose border is at most that far away. The triangle inequality gives
the border of two pivots p, q a distance of at least (d(x,q) - d(x,p)) / 2; in Euclidean
space the exact distance (d(x,q)^2 - d(x,p)^2) / (2 d(p,q)) is larger still, so it copies
less and loses nothing. Each cell then finds all links of its own vectors alone, in
double precision; a cell too large for one task is dealt in pairs of blocks.

Equal vectors of a label are one class from the start: their links are counted by
multiplicity and never listed. A cell reports a link count per class and one edge to the
least class it is joined to, not pairs.

Defined results: a vector that is null, empty, zero, or holds a null or non-finite
component, and one without a label or id, links with nothing. Vectors of different
lengths link with nothing. Rows that repeat an id share one component and their links
are summed. An empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, settled


@dataclass(frozen=True)
class Range:
    """Least cosine of a link; vectors a cell or block holds; most pivots of a label."""

    cosine: float = 0.98
    cell: int = 4096
    pivots: int = 256
    block: int = 4096
    #: vectors placed by one task
    place: int = 50_000


def unit(rows) -> np.ndarray:
    """Rows as unit vectors; each is first scaled by a power of two, which is exact."""
    x = np.stack([np.asarray(r, dtype=np.float64) for r in rows])
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def usable(vector, label, key) -> F.Column:
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    fine = ~F.coalesce(bad, F.lit(True)) & F.coalesce(F.exists(vector, lambda v: v != 0), F.lit(False))
    return fine & label.isNotNull() & key.isNotNull()


def placed(classes: DataFrame, how: Range) -> DataFrame:
    """(part, cls, home, cells): the cell of each class and all cells it is copied to, its own included.

    A class is a pivot by its hash, one in ``cell`` or rarer so that a label has about
    ``pivots`` at most; each label's least class is one in any case. Vectors are dealt to
    tasks by hash, each task with its label's pivots.
    """
    sizes = settled(classes.groupBy("part").agg(F.count("*").alias("n"), F.min("cls").alias("least")))
    sizes = sizes.withColumn("tasks", F.ceil(F.col("n") / how.place).cast("int"))
    known = classes.join(sizes, "part")
    rare = F.greatest(F.lit(how.cell).cast("long"), F.ceil(F.col("n") / how.pivots).cast("long"))
    pivots = (known.where((F.pmod(F.xxhash64("cls"), rare) == 0) | (F.col("cls") == F.col("least")))
              .select(F.col("part").alias("p_part"), F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("p_task"),
                      F.col("cls").alias("p_cls"), F.col("vector").alias("p_vector")))
    dealt = known.select("part", F.pmod(F.hash("cls"), F.col("tasks")).alias("task"), "cls", "vector")
    reach = math.sqrt(2 - 2 * how.cosine)

    def place(key: tuple, mine: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
        out: list = []
        if mine.empty:                # a task for which the hash left no vector
            return pd.DataFrame(columns=["part", "cls", "home", "cells"])
        p = unit(pivots.sort_values("p_cls")["p_vector"])
        apart = np.sqrt(np.maximum(0, 2 - 2 * (p @ p.T)))
        for at in range(0, len(mine), 2048):
            part = mine.iloc[at:at + 2048]
            near = unit(part["vector"]) @ p.T
            home = near.argmax(axis=1)
            gap = near[np.arange(len(part)), home][:, None] - near
            inside = gap <= reach * apart[home] + 1e-9
            out.append(pd.DataFrame({"part": part["part"].to_numpy(), "cls": part["cls"].to_numpy(), "home": home.astype(np.int32),
                                     "cells": [np.flatnonzero(r).astype(np.int32) for r in inside]}))
        return pd.concat(out) if out else pd.DataFrame(columns=["part", "cls", "home", "cells"])

    return (dealt.groupBy("part", "task").cogroup(pivots.groupBy("p_part", "p_task"))
            .applyInPandas(place, "part string, cls long, home int, cells array<int>"))


def linked(classes: DataFrame, how: Range) -> DataFrame:
    """(cls, links, least): links of a class to other classes, counted by multiplicity, and an edge
    to a class joined to it; several rows per class, whose links add up.

    A cell's own vectors, in blocks, meet all its vectors, in blocks: a task holds one block
    of each, however large the cell.
    """
    places = settled(placed(classes, how))
    spread = places.select("part", "cls", F.explode("cells").alias("cell"), "home").withColumn("mine", F.col("home") == F.col("cell"))
    sizes = (spread.groupBy("part", "cell").agg(F.ceil(F.count("*") / how.block).cast("int").alias("blocks"),
                                                F.ceil(F.count_if("mine") / how.block).cast("int").alias("own_blocks"))
             .where("own_blocks > 0"))
    as_other = F.transform(F.sequence(F.lit(0), F.col("own_blocks") - 1), lambda i: F.struct(
        i.alias("i"), F.pmod(F.hash("cls"), F.col("blocks")).alias("j"), F.lit(False).alias("own")))
    as_own = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(
        F.pmod(F.hash("cls"), F.col("own_blocks")).alias("i"), j.alias("j"), F.lit(True).alias("own")))
    dealt = (spread.join(sizes, ["part", "cell"])
             .withColumn("seat", F.explode(F.when(F.col("mine"), F.concat(as_other, as_own)).otherwise(as_other)))
             .select("part", "cell", "seat.i", "seat.j", "seat.own", "cls"))
    full = dealt.join(classes, ["part", "cls"])

    def link(block: pd.DataFrame) -> pd.DataFrame:
        x, cls, own = unit(block["vector"]), block["cls"].to_numpy(), block["own"].to_numpy()
        mine, others = np.flatnonzero(own), np.flatnonzero(~own)
        ids, place = np.unique(cls, return_inverse=True)
        times, joined = block["times"].to_numpy()[others], np.arange(len(ids))
        links = np.zeros(len(ids), dtype=np.int64)
        for at in range(0, len(mine), 512):
            rows = mine[at:at + 512]
            near = (x[rows] @ x[others].T >= how.cosine) & (place[rows][:, None] != place[others][None, :])
            links[place[rows]] = near @ times
            for i in np.flatnonzero(near.any(axis=1)):
                met = np.unique(joined[np.append(place[others[near[i]]], place[rows[i]])])
                if len(met) > 1:
                    joined[np.isin(joined, met)] = met[0]
        return pd.DataFrame({"cls": ids, "links": links, "least": ids[joined]})

    return full.groupBy("part", "cell", "i", "j").applyInPandas(link, "cls long, links long, least long")


def near_duplicates(vectors: DataFrame, how: Range = Range(), vec_id: str = "vec_id", vector: str = "embedding",
                    label: str = "label") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id (least id reachable by links) and kept."""
    key = F.col(vec_id).cast("long")
    rows = vectors.select(key.alias("vec_id"), F.col(vector).alias("vector"),
                          F.when(usable(F.col(vector), F.col(label), F.col(vec_id)),
                                 F.concat(F.col(label).cast("string"), F.lit("/"), F.size(vector).cast("string"))).alias("part"))
    classes = settled(rows.where("part IS NOT NULL").groupBy("part", "vector")
                      .agg(F.min("vec_id").alias("cls"), F.count("*").alias("times")))
    found = settled(linked(classes, how))
    least = components(found.where("cls != least").select(F.col("cls").alias("a"), F.col("least").alias("b")))
    copies = classes.groupBy("cls").agg(F.sum(F.col("times") - 1).alias("copies"))
    result = (copies.join(found.groupBy(F.col("cls").alias("__found")).agg(F.sum("links").alias("links")), F.col("cls") == F.col("__found"), "left")
              .join(least, F.col("cls") == F.col("node"), "left")
              .select(F.col("cls").alias("__cls"), (F.coalesce("links", F.lit(0)) + F.col("copies")).alias("links"),
                      F.coalesce("component", "cls").alias("component")))
    member = rows.join(classes.select(F.col("part").alias("__part"), F.col("vector").alias("__vector"), "cls"),
                       (F.col("part") == F.col("__part")) & (F.col("vector") == F.col("__vector")), "left")
    return (member.select("vec_id", "cls").join(result, F.col("cls") == F.col("__cls"), "left")
            .select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
                    F.coalesce("component", "vec_id").alias("component_id"))
            .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))))


#: DuckDB SQL of the query: brute force within labels, then a recursive reach.
ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), ok AS (
  SELECT * FROM v WHERE label IS NOT NULL AND vec_id IS NOT NULL AND e IS NOT NULL
    AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    AND list_cosine_similarity(a.e, b.e) >= 0.98
), reach AS (
  SELECT vec_id AS node, vec_id AS seen FROM v UNION SELECT reach.node, links.y FROM reach JOIN links ON reach.seen = links.x
), least AS (
  SELECT node, min(seen) AS component_id FROM reach GROUP BY node
), n AS (
  SELECT x, count(*) AS n FROM links GROUP BY x
)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN least ON vec_id = node LEFT JOIN n ON vec_id = x
"""
