"""Connected components by randomised contraction, as a chain of Spark joins."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of longs -> ``(node, root)`` for every node that has an edge.

    Each round maps every node to the neighbour (or itself) that is first in a hashed order,
    relabels and deduplicates the edges, and drops loops; hashing the order makes a chain shrink by
    a constant factor a round. Every step is an aggregation with partial sums or a join on a node, so
    a hub with very many links is combined before the shuffle. Nothing is collected: the driver only
    asks whether edges are left. Self links, repeated and mirrored links are allowed; rows with a null
    end are ignored; no links give an empty result.
    """
    edges = cut(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").distinct())
    mapping = None
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b"), F.col("a")))
        first = both.groupBy("a").agg(F.min_by("b", F.xxhash64("b")).alias("m"))
        ahead = (F.xxhash64("m") < F.xxhash64("a")) | ((F.xxhash64("m") == F.xxhash64("a")) & (F.col("m") < F.col("a")))
        step = cut(first.select(F.col("a").alias("n"), F.when(ahead, F.col("m")).otherwise(F.col("a")).alias("to")))
        if mapping is None:
            mapping = step.select(F.col("n").alias("node"), F.col("to").alias("root"))
        else:
            mapping = cut(mapping.join(step, mapping.root == step.n, "left").select("node", F.coalesce("to", "root").alias("root")))
        left = step.select(F.col("n").alias("a"), F.col("to").alias("ta"))
        right = step.select(F.col("n").alias("b"), F.col("to").alias("tb"))
        moved = edges.join(left, "a").join(right, "b").where("ta <> tb")
        edges = cut(moved.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct())
    if mapping is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return mapping


def local_labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index reachable for each of ``n`` local nodes over links (i, j)."""
    label = np.arange(n)
    while len(i):
        least = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], least)
        np.minimum.at(new, label[j], least)
        while not np.array_equal(new[new], new):
            new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    return label
