"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from layoutlint.llm.common import materialize


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` for each node of the undirected ``edges`` (columns ``u``, ``v``).

    The root is a node of the same component, the same for all of its nodes. Each round every node points
    to the least of its neighbours and itself, and the edges are rewritten to those; edges inside a node
    go. Node values should be hashes, so that their order has nothing to do with the graph's shape: then a
    constant share of the nodes goes each round, also on chains. All steps are joins and partial minima;
    tables go to the shared folder after each round, and nothing but counts comes to the driver.
    """
    both = edges.select("u", "v").where("u <> v")
    both = materialize(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = None
    while not both.isEmpty():
        point = materialize(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("p")), "pointers")
        if labels is None:
            labels = point.select(F.col("u").alias("node"), F.col("p").alias("root"))
        else:
            labels = materialize(
                labels.join(point, labels["root"] == point["u"], "left").select("node", F.coalesce("p", "root").alias("root")), "labels"
            )
        at_v = point.select(F.col("u").alias("v"), F.col("p").alias("q"))
        both = materialize(
            both.join(point, "u").join(at_v, "v").where("p <> q").select(F.col("p").alias("u"), F.col("q").alias("v")).distinct(), "edges"
        )
    if labels is None:
        kind = edges.schema["u"].dataType
        return edges.sparkSession.createDataFrame([], f"node {kind.simpleString()}, root {kind.simpleString()}")
    return labels
