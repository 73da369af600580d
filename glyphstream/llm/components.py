"""Connected components by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphstream.runtime import materialize, skew_join


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); the component is its least node.

    Each round takes the least label among a node's neighbours, then jumps to the
    label's own label, so long chains shorten by halves. Labels are written to
    the shared folder between rounds; hubs and labels that many nodes have are joined by broadcast.
    Links of a node to itself are fine, repeated links too; links with a null end are skipped; no links give no rows.
    """
    links = links.where("a is not null and b is not null")
    both = links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct()
    both = materialize(both, "links")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component"), F.count("*").alias("degree")), "labels")
    while True:
        near = skew_join(both, labels.withColumnRenamed("node", "b"), ["b"], "degree").groupBy(F.col("a").alias("n")).agg(F.min("component").alias("near"))
        low = labels.join(near, F.col("node") == F.col("n")).select("node", "degree", F.col("component").alias("old"), F.least("component", "near").alias("low"))
        low = materialize(low, "low")
        jumped = skew_join(low, labels.select(F.col("node").alias("low"), F.col("component").alias("top")), ["low"])
        jumped = jumped.select("node", F.least("low", "top").alias("component"), "degree", (F.least("low", "top") != F.col("old")).alias("moved"))
        done = materialize(jumped, "labels")
        labels = done.select("node", "component", "degree")
        if not done.where("moved").limit(1).count():
            return labels.drop("degree")
