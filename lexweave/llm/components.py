"""Connected components of a link table, without collecting links or labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b): the smallest node that it reaches.

    Each round takes the smallest label among neighbours and then the label of that label, so
    chains shrink by halves. Rounds end when no label changes; each is cut in the shared folder.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = stored(both.distinct(), "links")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
    labels = stored(labels.select("node", F.least("node", "m").alias("component")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("m"))
        least = labels.join(near, labels["node"] == near["a"]).select("node", F.col("component").alias("was"), F.least("component", "m").alias("least"))
        least = stored(least, "labels_least")
        up = least.select(F.col("node").alias("top"), F.col("least").alias("up"))
        jumped = least.join(up, least["least"] == up["top"]).select("node", "was", F.least("least", "up").alias("component"))
        jumped = stored(jumped, "labels")
        labels = jumped.select("node", "component")
        if jumped.where("was <> component").isEmpty():
            return labels
