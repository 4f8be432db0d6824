"""Connected components by hooking labels with pointer jumping, on tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def component_labels(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b): the smallest node that it reaches.

    Each round takes the smallest label of a node's neighbours for the node and for the node of its label
    (so whole trees of labels hang onto smaller ones), and follows labels twice.  Rounds grow with the
    logarithm of a component's size, not with its length, and go on until no label changes; a round's tables are
    deleted once the next is written.  No row grows with a component's size, and the joins are plain equi-joins
    that Spark may split when skewed.  Nodes are of any type that can be ordered.
    """
    both = materialize(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    none = F.lit(None).cast(both.schema["a"].dataType)
    first = both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label"))
    jumped = materialize(first.select("node", "label", none.alias("was")), "labels")
    while True:
        labels = jumped.select("node", "label")
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        met = labels.join(near, labels["node"] == near["a"], "left").select("node", "label", F.least("label", F.coalesce("near", "label")).alias("near"))
        own = F.struct(F.col("node").alias("node"), F.col("near").alias("label"), F.col("label").alias("was"))
        hook = F.struct(F.col("label").alias("node"), F.col("near").alias("label"), none.alias("was"))
        moved = materialize(met.select(F.inline(F.array(own, hook))).groupBy("node").agg(F.min("label").alias("label"), F.max("was").alias("was")), "moved")
        up = moved.select(F.col("node").alias("_node"), F.col("label").alias("_up"))
        next_ = materialize(moved.join(up, moved["label"] == up["_node"], "left").select("node", F.least("label", F.coalesce("_up", "label")).alias("label"), "was"), "labels")
        discard(jumped, moved)
        jumped = next_
        if jumped.where("label <> was").isEmpty():
            discard(both)
            return jumped.select("node", "label")
