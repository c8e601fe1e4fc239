"""Connected components by local contraction, in joins and aggregations."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nametwin.operators.keep import settle


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id on an edge (a, b); component is the smallest id reachable.

    Each round sends every node to the node of least hash among itself and its
    neighbours, and joins edges anew between where their ends went. Nodes fall by a
    constant factor a round, whatever the shape: hashes break long chains, and of a
    star's leaves nothing is left after two rounds. Only edges that still join two
    nodes go on. Every round is written out, so a lost executor costs no round again.
    """
    both_ways = edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    left = settle(both_ways.distinct())
    moves: list[DataFrame] = []
    while not left.isEmpty():
        ends = left.unionAll(left.select("b", "a"))
        near = ends.groupBy("a").agg(F.min(F.struct(F.xxhash64("b").alias("h"), F.col("b").alias("to"))).alias("m"))
        own = F.struct(F.xxhash64("a").alias("h"), F.col("a").alias("to"))
        move = settle(near.select(F.col("a").alias("id"), F.least(own, "m")["to"].alias("to")))
        moves.append(move)
        from_a = move.select(F.col("id").alias("a"), F.col("to").alias("x"))
        from_b = move.select(F.col("id").alias("b"), F.col("to").alias("y"))
        moved = left.join(from_a, "a").join(from_b, "b").filter("x <> y")
        left = settle(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    if not moves:
        return left.select(F.col("a").alias("id"), F.col("b").alias("component"))
    labels = moves[-1]
    for move in reversed(moves[:-1]):
        later = labels.select(F.col("id").alias("to"), F.col("to").alias("end"))
        labels = settle(move.join(later, "to", "left").select("id", F.coalesce("end", "to").alias("to")))
    least = settle(labels.groupBy("to").agg(F.min("id").alias("component")))
    return labels.join(least, "to").select("id", "component")


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A forest with the same components as the links a[i]-b[i]: (node, root) without roots."""
    if not len(a):
        return a, b
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        while not np.array_equal(label, label[label]):
            label = label[label]
        if np.array_equal(label[x], label[y]):
            break
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]
