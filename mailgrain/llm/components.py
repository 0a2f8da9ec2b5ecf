"""Connected components of a table of links, by contraction; nothing is collected on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailgrain.llm import base


def _jump(hooks: DataFrame) -> DataFrame:
    """Follow pointers of a forest (v, p), p < v, until each leads to its root."""
    while True:
        up = hooks.select(F.col("v").alias("p"), F.col("p").alias("above"))
        jumped = base.store(hooks.join(up, "p", "left").select(
            "v", F.coalesce("above", "p").alias("p"), F.col("above").isNotNull().alias("moved")), "jump")
        moved = not jumped.where("moved").isEmpty()
        base.drop_stored(hooks)
        hooks = jumped.select("v", "p")
        if not moved:
            return hooks


def components(links: DataFrame) -> DataFrame:
    """(v, root) for every vertex of ``links`` (a, b) that has a smaller one in its component; the root is the smallest.

    Each round hooks every vertex onto its smallest neighbour, shortens the forest by pointer jumping and contracts
    the links to roots; the number of open components at least halves.
    """
    edges = base.store(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "links")
    labels = None
    while not edges.isEmpty():
        hooks = _jump(base.store(edges.groupBy(F.col("b").alias("v")).agg(F.min("a").alias("p")), "hooks"))
        if labels is None:
            labels = hooks.select("v", F.col("p").alias("root"))
        else:
            moved = labels.join(hooks.select(F.col("v").alias("root"), "p"), "root", "left").select("v", F.coalesce("p", "root").alias("root"))
            labels = base.store(moved.unionByName(hooks.select("v", F.col("p").alias("root"))), "labels")
        left = hooks.select(F.col("v").alias("a"), F.col("p").alias("pa"))
        right = hooks.select(F.col("v").alias("b"), F.col("p").alias("pb"))
        ends = edges.join(left, "a", "left").join(right, "b", "left").select(
            F.coalesce("pa", "a").alias("x"), F.coalesce("pb", "b").alias("y")).where("x <> y")
        contracted = base.store(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
        base.drop_stored(edges)
        edges = contracted
    if labels is None:
        labels = links.select(F.col("a").alias("v"), F.col("b").alias("root")).where("false")
    return labels
