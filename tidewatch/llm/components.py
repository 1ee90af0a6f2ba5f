"""Connected components of a link table, by labels that shrink along links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.session import materialise


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); a component is named by its least node.

    Each round takes the least label among a node and its neighbours (combined before the
    shuffle, so a hub costs one row per task) and then the label of that label, so a chain
    shortens by half.  Rounds are written to the shared folder; the driver sees counts only.
    """
    both = materialise(
        links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        .where("a <> b").distinct(), "links")
    own = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    labels = materialise(own.select("node", F.col("node").alias("component")), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).select(F.col("a").alias("node"), "component")
        least = labels.union(near).groupBy("node").agg(F.min("component").alias("component"))
        jump = labels.select(F.col("node").alias("via"), F.col("component").alias("further"))
        moved = (least.join(jump, least.component == jump.via, "left")
                 .select("node", F.least("component", F.coalesce("further", "component")).alias("component")))
        before = labels.withColumnRenamed("component", "before")
        labels = materialise(moved.join(before, "node"), "labels")
        changed = labels.where("component <> before").limit(1).count()
        labels = labels.select("node", "component")
        if not changed:
            return labels
