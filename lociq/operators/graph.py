"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint in the shared folder: a short lineage that survives lost executors."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints")
    return df.checkpoint(eager=True)


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node in an edge; the component is its smallest node.
    Labels spread along edges and then along labels, until none changes. Edges need not
    differ: each is kept once, lesser end first, before it is turned round, so that one
    table of them is in a task's memory and not three."""
    ends = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).dropna()
    ends = cut(ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    both = ends.union(ends.where("a <> b").select("b", "a"))
    labels = cut(both.groupBy("a").agg(F.min(F.least("a", "b")).alias("component")).withColumnRenamed("a", "node"))
    for _ in range(most_rounds):
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("component").alias("near")).withColumnRenamed("a", "node")
        stepped = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        leaders = labels.select(F.col("node").alias("component"), F.col("component").alias("further"))
        moved = cut(stepped.join(leaders, "component", "left").select("node", "was", F.least("component", F.coalesce("further", "component")).alias("component")))
        labels = moved.select("node", "component")
        if moved.where("component <> was").limit(1).count() == 0:
            return labels
    raise RuntimeError(f"components still change after {most_rounds} rounds")
