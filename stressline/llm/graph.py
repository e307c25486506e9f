"""Connected components: locally over numpy arrays, and distributed over an edge table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Scratch


def unite(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Labels (smallest member of each component) after linking x[i] with y[i]."""
    while True:
        a, b = label[x], label[y]
        differ = a != b
        if not differ.any():
            return label
        a, b = a[differ], b[differ]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, label) of every node of the edges (a, b), of any type that can be ordered; a component has one label, one of its nodes.

    Each round hooks every node to its neighbour of least rank, if that is less than its own, and
    replaces the ends of all edges by what they hang from. The rank is a hash that
    changes with the round, so a node has at least even odds to be hooked away and the nodes that are left
    halve, on average, in every round, whatever the shape: the rounds grow with the logarithm of the largest component, and there is
    no limit to them. Then the rounds are read backwards, each a join with a table half as large."""
    ends = F.struct(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    left = scratch.save(edges.where("a <> b").select(ends.alias("x")).distinct().select("x.a", "x.b"), "edges0")
    hooks: list[DataFrame] = []
    while left.limit(1).count():
        i = len(hooks)
        rank = lambda c: F.struct(F.xxhash64(F.lit(i), c).alias("rank"), F.col(c).alias("node"))  # noqa: B023, E731
        both = left.select(F.col("a").alias("node"), rank("b").alias("near")).union(left.select(F.col("b").alias("node"), rank("a").alias("near")))
        least = both.groupBy("node").agg(F.min("near").alias("near"))
        hook = scratch.save(least.select("node", F.least(F.col("near"), rank("node"))["node"].alias("to")), f"hooks{i}")
        moved = left
        for side in ("a", "b"):  # both sides are plain exchanges, so a node with very many edges is split
            moved = moved.join(hook.select(F.col("node").alias(side), F.col("to").alias(f"to_{side}")).hint("merge"), side)
        moved = moved.where("to_a <> to_b").select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct()
        hooks.append(hook)
        left, old = scratch.save(moved, f"edges{i + 1}"), left
        scratch.drop(old)
    if not hooks:
        return left.select(F.col("a").alias("node"), F.col("b").alias("label"))
    label = hooks[-1].select("node", F.col("to").alias("label"))
    for i in range(len(hooks) - 2, -1, -1):
        above = label.select(F.col("node").alias("to"), "label")
        label = scratch.save(hooks[i].join(above, "to", "left").select("node", F.coalesce("label", "to").alias("label")), f"labels{i}")
    return label
