"""Connected components of an edge list, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.session import ensure_checkpoint_dir


def _kept(df: DataFrame) -> DataFrame:
    """``df`` in the shared checkpoint folder, lineage cut, columns renewed for self joins."""
    out = df.checkpoint(eager=True)
    return out.select(*[F.col(c).alias(c) for c in out.columns])


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for undirected ``edges`` (a, b): the smallest node reachable.

    Every round a node takes the least label of its neighbours (a grouped minimum, combined
    before its shuffle) and then its label's label, which halves chains. A node with very
    many neighbours is the hot side of plain equi-joins that adaptive execution may split.
    Raises if labels still change after ``max_rounds`` rounds.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    one_way = edges.select("a", "b").where("a <> b").distinct()
    both = _kept(one_way.unionByName(one_way.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = _kept(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("label")))
    for _ in range(max_rounds):
        near = (both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near")))
        lower = _kept(labels.join(near, F.col("node") == F.col("a")).select("node", F.col("label").alias("was"), F.least("label", "near").alias("label")))
        target = lower.select(F.col("node").alias("_node"), F.col("label").alias("_label"))
        jumped = _kept(lower.join(target, F.col("label") == F.col("_node")).select("node", "was", F.least("label", "_label").alias("label")))
        changed = jumped.where("was <> label").limit(1).count()
        labels = jumped.select("node", "label")
        if not changed:
            return labels.select("node", F.col("label").alias("component"))
    raise RuntimeError(f"components still change after {max_rounds} rounds")
