"""Connected components of links between numbered vertices, as joins of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """c, label for every vertex of ``links`` (a, b): the label is the smallest vertex reachable.

    Each round takes the least label of the neighbours, then the label's own label, so that paths shrink by
    doubling. Labels are written between rounds; nothing but one count comes to the driver.
    """
    edges = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = written(edges.groupBy(F.col("a").alias("c")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = edges.join(labels.select(F.col("c").alias("b"), "label"), "b").groupBy(F.col("a").alias("c")).agg(F.min("label").alias("near"))
        step = labels.join(near, "c").select("c", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("c").alias("label"), F.col("label").alias("further"))
        moved = written(step.join(jump, "label", "left").select("c", "old", F.least("label", F.coalesce("further", "label")).alias("label")), "labels")
        labels = moved.select("c", "label")
        if moved.where("old <> label").isEmpty():
            return labels
