"""Connected components by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobweave.llm.store import stored


def components(links: DataFrame) -> DataFrame:
    """node and component (smallest node reachable) of all nodes in ``links`` (a, b).

    Each round takes the smallest label among the neighbours and then follows
    labels one step, so chains shorten by halves. Labels are written between
    rounds; nothing but one count comes to the driver.
    """
    links = links.where("a <> b")
    both = stored(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least("a", F.min("b")).alias("component")), "labels")
    while True:
        near = (
            both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("near"))
        )
        lower = labels.join(near, F.col("node") == F.col("a")).select(
            "node", F.col("component").alias("old"), F.least("component", "near").alias("via")
        )
        onward = labels.select(F.col("node").alias("via"), F.col("component").alias("beyond"))
        following = stored(
            lower.join(onward, "via").select("node", "old", F.least("via", "beyond").alias("component")), "labels"
        )
        labels = following.select("node", "component")
        if following.where("old <> component").limit(1).count() == 0:
            return labels
