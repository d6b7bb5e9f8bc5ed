"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import materialize


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b): root is the component's smallest node.

    Each round takes the smallest label among the neighbours, then the label of the label, so that chains
    halve; rounds end when no label changes. Every round's table is written to the shared folder. The join
    on a hub's links is one that Spark can split. Null ends are left out.
    """
    links = links.filter("a is not null and b is not null and a <> b")
    edges = materialize(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialize(edges.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("root")), "labels")
    while True:
        near = edges.join(labels, edges["b"] == labels["node"]).groupBy("a").agg(F.min("root").alias("low"))
        better = labels.join(near, labels["node"] == near["a"]).select("node", "root", F.least("root", "low").alias("next"))
        jump = better.select(F.col("node").alias("at"), F.col("next").alias("beyond"))
        better = materialize(
            better.join(jump, F.col("next") == F.col("at")).select("node", "root", F.least("next", "beyond").alias("next")), "labels"
        )
        if better.filter("next <> root").isEmpty():
            return labels
        labels = better.select("node", F.col("next").alias("root"))
