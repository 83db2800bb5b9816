"""Connected components of an edge table, by hooking and contraction, without any part on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallow.llm.common import discard, materialize


def _settled(low: DataFrame) -> DataFrame:
    """(node, label) with labels below their nodes -> each node's last label, by pointer jumping: in log2(depth) steps."""
    while True:
        up = low.select(F.col("node").alias("label"), F.col("label").alias("_next"))
        jumped = materialize(low.join(up, "label").select("node", F.col("_next").alias("label"), (F.col("_next") < F.col("label")).alias("_moved")))
        discard(low)
        low = jumped
        if low.where("_moved").isEmpty():
            return low


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) -> (node, label): label is the smallest node of the component.

    Each round hooks every node to its smallest neighbour, follows the hooks to their end and replaces the nodes of the
    edges by what they lead to; edges within one node go. Nodes with edges at least halve each round, so it ends in
    logarithmically many, and edges are joined once or twice. A round is written to the shared folder; both sides of its
    joins are read from files, so hubs are skewed joins that Spark splits.
    """
    pairs = edges.select(F.col("a").alias("src"), F.col("b").alias("dst")).where("src <> dst")
    both = materialize(pairs.unionAll(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    labels = None
    while labels is None or not both.isEmpty():
        hooks = both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("_m"))
        low = _settled(materialize(hooks.select("node", F.least("node", "_m").alias("label"))))
        if labels is None:
            labels = materialize(low.select("node", "label"))
        else:
            old, up = labels, low.select(F.col("node").alias("label"), F.col("label").alias("_next"))
            labels = materialize(old.join(up, "label", "left").select("node", F.coalesce("_next", "label").alias("label")))
            discard(old)
        left, right = (low.select(F.col("node").alias(c), F.col("label").alias(f"_{c}")) for c in ("src", "dst"))
        old = both
        both = materialize(old.join(left, "src").join(right, "dst").where("_src <> _dst").select(F.col("_src").alias("src"), F.col("_dst").alias("dst")).distinct())
        discard(old, low)
    discard(both)
    return labels
