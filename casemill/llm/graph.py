"""Connected components by minimum labels and pointer jumping, all in the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemill.session import written


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the least node of each component names it. Nodes without edges don't appear.

    Each round takes the least label among a node and its neighbours, then the label of that label; labels only fall, so the
    rounds end after about log2 of the longest path. Rounds are written to the shared folder, which cuts the lineage.
    """
    both = edges.select(F.col(a).alias("node"), F.col(b).alias("other")).where(F.col(a) != F.col(b))
    both = written(both.union(both.select("other", "node")).distinct(), "edges")
    labels = written(both.groupBy("node").agg(F.least(F.first("node"), F.min("other")).alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), "component"), "other").groupBy("node").agg(F.min("component").alias("near"))
        step = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("further"))
        new = written(step.join(jump, "component", "left").select("node", "old", F.least("component", F.coalesce("further", "component")).alias("component")), "labels")
        if new.where("old <> component").isEmpty():
            return new.select("node", "component")
        labels = new.select("node", "component")
