"""Connected components of a table of links, by label passing with pointer jumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import keep


def components(links: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``node, label`` for every node of the links ``a, b``; the label is the component's smallest node.

    ``known`` are labels found from earlier links, whose components new links
    may join. Every round takes the least label among neighbours and then the
    label of that label, so chains shorten by half; each round is written to
    the shared folder, which cuts the lineage.
    """
    edges = links.select("a", "b")
    if known is not None:
        edges = edges.unionByName(known.where("node <> label").select(F.col("node").alias("a"), F.col("label").alias("b")))
    both = keep(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label"))
    before = None
    while True:
        labels = keep(labels, "labels")
        now = labels.agg(F.count(F.lit(1)), F.sum(F.col("label").cast("decimal(38,0)"))).first()
        if before == now:
            return labels
        before = now
        near = both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("_near")), "b").groupBy(F.col("a").alias("node")).agg(F.min("_near").alias("_near"))
        least = labels.join(near, "node", "left").select("node", F.least("label", "_near").alias("label"))
        hop = labels.select(F.col("node").alias("label"), F.col("label").alias("_hop"))
        labels = least.join(hop, "label", "left").select("node", F.least("label", "_hop").alias("label"))
