"""Connected components of a link table, as a loop of joins and small aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociq.llm.common import Scratch


def components(links: DataFrame, labels: DataFrame | None = None, scratch: Scratch | None = None, most_rounds: int = 60) -> DataFrame:
    """(node, label) of every node that has a link; label is the smallest node it reaches.

    links: (a, b). labels: earlier labels, whose nodes and reach are kept. Each round takes
    the least label among the neighbours and then follows labels of labels, so the number
    of rounds grows with the logarithm of a component's width. Every round is written to
    the shared folder; a node with very many links is no single task's work, since its
    join is between fresh scans and the minimum is taken before the shuffle.
    """
    cut = (scratch or Scratch(links.sparkSession)).cut
    edges = links.select("a", "b").where("a <> b")
    if labels is not None:
        edges = edges.unionByName(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).where("a <> b"))
    edges = cut(edges.union(edges.select("b", "a")).distinct())
    current = cut(edges.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label")).withColumnRenamed("a", "node"))
    for _ in range(most_rounds):
        near = edges.join(current.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("near")).withColumnRenamed("a", "node")
        stepped = cut(current.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label")))
        of_label = stepped.select(F.col("node").alias("label"), F.col("label").alias("further"))
        jumped = cut(stepped.join(of_label, "label", "left").select("node", "was", F.least("label", F.coalesce("further", "label")).alias("label")))
        current = jumped.select("node", "label")
        if jumped.where("label <> was").limit(1).count() == 0:
            return current
    raise RuntimeError(f"labels still change after {most_rounds} rounds")
