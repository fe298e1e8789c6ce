"""Connected components of a link table by repeated contraction, without any collect."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerscope.llm.common import materialise

def connected_components(links: DataFrame, rounds: list[int] | None = None) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b): the component is its smallest node.

    Each round points every node to the smallest node among itself and its neighbours, follows the pointers through each
    other until all lead to an end, renames the links by them and drops those inside one name, so that the links shrink
    until none is left. A jump doubles how far a pointer leads: a chain of n links, one after another, takes log n jumps
    and not n rounds, and a round at least halves the names of a component. Per round: one aggregation (partial first, so a
    hub costs one row a task), two equi-joins and one a jump, which AQE may split at a hub, and the written tables.
    Nulls and self-links are dropped; repeated links count once; no links give an empty table. ``rounds``: a list that
    gets the number of each round's links.
    """
    both = lambda e: e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = materialise(links.select("a", "b").where("a is not null and b is not null and a <> b"))
    labels = None
    while not edges.isEmpty():
        if rounds is not None:
            rounds.append(edges.count())
        step = materialise(both(edges).groupBy("a").agg(F.min("b").alias("low"))
                           .select(F.col("a").alias("node"), F.least("a", "low").alias("to")))
        while True:
            further = step.select(F.col("node").alias("to"), F.col("to").alias("next"))
            jumped = materialise(step.join(further, "to").select("node", "to", "next"))
            if jumped.where("next <> to").isEmpty():
                break
            step = jumped.select("node", F.col("next").alias("to"))
        if labels is None:
            labels = step.select("node", F.col("to").alias("component"))
        else:
            labels = materialise(labels.join(step.select(F.col("node").alias("component"), "to"), "component", "left")
                                 .select("node", F.coalesce("to", "component").alias("component")))
        edges = materialise(
            edges.join(step.select(F.col("node").alias("a"), F.col("to").alias("x")), "a")
            .join(step.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
            .where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels
