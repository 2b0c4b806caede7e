"""Connected components of links between ids, by label passing with pointer jumps. Each round's labels are checkpointed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def components(edges: DataFrame) -> DataFrame:
    """(a, b) links between long ids to (node, component), component being the smallest id reachable; ids without links are left out.

    A round joins links with labels and takes minima, which Spark sums up before it shuffles, so that a node with very many links is no hot
    spot. Labels then jump to their label's label, so that the rounds grow with the logarithm of a component's width. Null ids, repeated
    links and links of an id to itself are ignored; no links give no rows.
    """
    both = edges.select("a", "b").where("a is not null and b is not null and a <> b")
    both = both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")).checkpoint()
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("m"))
        low = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        jump = labels.select(F.col("node").alias("k"), F.col("label").alias("far"))
        after = low.join(jump, F.col("label") == F.col("k"), "left").select("node", "old", F.least("label", F.coalesce("far", "label")).alias("label")).checkpoint()
        if after.where("old <> label").isEmpty():
            return after.select("node", F.col("label").alias("component"))
        labels = after.select("node", "label")
