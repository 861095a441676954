"""Connected components of an edge table, as joins over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import materialize


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """One row (node, component) per node with an edge; the component is its smallest node.

    Every round each node takes the smallest label among its neighbours and then the label
    of that label. Labels only fall, and a round without a change ends the loop, so no depth
    is set. Each round is a written table: the plan stays short and a lost executor costs
    one round. A node with very many edges is one key of a join (split by adaptive
    execution) and of a partial minimum. Edges with a null end are left out, loops are fine.
    """
    both = edges.select(F.col(left).cast("long").alias("u"), F.col(right).cast("long").alias("v")).where(
        "u is not null and v is not null"
    )
    both = materialize(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = materialize(
        both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("l")).select(F.col("u").alias("node"), "l"), "labels"
    )
    while True:
        near = (
            both.join(labels, both.v == labels.node).groupBy("u").agg(F.min("l").alias("m"))
        )
        lower = labels.join(near, labels.node == near.u, "left").select(
            "node", F.col("l").alias("old"), F.least("l", "m").alias("l")
        )
        lower = materialize(lower, "labels")
        jump = lower.select(F.col("node").alias("at"), F.col("l").alias("further"))
        after = materialize(
            lower.join(jump, lower.l == jump["at"], "left").select(
                "node", "old", F.least("l", "further").alias("l")
            ),
            "labels",
        )
        if after.where("l <> old").isEmpty():
            return after.select("node", F.col("l").alias("component"))
        labels = after.select("node", "l")
