"""Connected components of links, smallest member first."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .store import Folder


def components(links: DataFrame, folder: Folder, name: str) -> DataFrame:
    """``(node, component)`` of all nodes that occur in links ``(a, b)``.

    Each round maps a node to its smallest neighbour, follows that map once more and
    contracts the links by it, so a round at least halves the nodes left and the smallest
    node of a component always stays. Every step is a partial aggregate or a join that
    Spark may split; each round is a written table. Self-links and nulls are ignored.
    """
    links = (links.where("a is not null and b is not null and a <> b")
             .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    links = folder.cut(links, f"{name}-links-0")
    label, step = None, 0
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = folder.cut(both.groupBy(F.col("a").alias("node"))
                          .agg(F.min("b").alias("b"))
                          .select("node", F.least("node", "b").alias("to")), f"{name}-near-{step}")
        jump = near.select(F.col("node").alias("to"), F.col("to").alias("up"))
        parent = folder.cut(near.join(jump, "to", "left")
                            .select("node", F.coalesce("up", "to").alias("to")),
                            f"{name}-parent-{step}")
        if label is None:
            label = parent.select("node", F.col("to").alias("component"))
        else:
            up = parent.select(F.col("node").alias("component"), "to")
            label = (label.join(up, "component", "left")
                     .select("node", F.coalesce("to", "component").alias("component")))
        label = folder.cut(label, f"{name}-label-{step}")
        a = parent.select(F.col("node").alias("a"), F.col("to").alias("x"))
        b = parent.select(F.col("node").alias("b"), F.col("to").alias("y"))
        links = folder.cut(
            links.join(a, "a").join(b, "b").where("x <> y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(),
            f"{name}-links-{step + 1}")
        folder.drop(f"{name}-near-{step}", f"{name}-parent-{step}", f"{name}-links-{step}")
        if step:
            folder.drop(f"{name}-label-{step - 1}")
        step += 1
    if label is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return label
