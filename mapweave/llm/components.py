"""Connected components of a link table, by minimum labels with pointer jumping; every round is a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over ``links`` (a, b), for every node in a link. Labels only fall and
    are nodes of the same component; it ends when none changed. Pointer jumping halves the distances, so rounds grow with
    the logarithm of the longest path."""
    both = links.select("a", "b").union(links.select("b", "a")).where("a <> b")
    both = written(both.distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")), "labels")
    while True:
        seen = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("low"))
        lower = labels.join(seen, labels["node"] == seen["a"]).select("node", F.col("label").alias("old"), F.least("label", "low").alias("label"))
        lower = written(lower, "labels-low")
        of = lower.select(F.col("node").alias("at"), F.col("label").alias("next"))
        jumped = written(lower.join(of, lower["label"] == of["at"]).select("node", "old", "next"), "labels-jumped")
        done = jumped.where("old <> next").isEmpty()
        discard(labels, lower)
        labels = jumped.select("node", F.col("next").alias("label"))
        labels._written_at = jumped._written_at
        if done:
            discard(both)
            found = labels.select("node", F.col("label").alias("component"))
            found._written_at = jumped._written_at
            return found
