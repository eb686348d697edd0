"""Connected components by labels that shrink along links and jump to their label's label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessaline.llm.base import plain_unions, removed, written


def connected(links: DataFrame) -> DataFrame:
    """node and label (the smallest node it reaches) of all nodes of links (a, b)."""
    plain_unions(links.sparkSession)
    both = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near, labels["node"] == near["a"], "left").select("node", "label", F.least("label", F.coalesce("near", "label")).alias("low"))
        lower = written(lower, "labels")
        jump = lower.select(F.col("node").alias("at"), F.col("low").alias("jump"))
        after = written(lower.join(jump, lower["low"] == jump["at"], "left").select("node", F.least("low", F.coalesce("jump", "low")).alias("label"), (F.least("low", F.coalesce("jump", "low")) < F.col("label")).alias("moved")), "labels")
        removed(labels, lower)
        if after.where("moved").limit(1).count() == 0:
            removed(both)
            return after.select("node", "label")
        labels = after
