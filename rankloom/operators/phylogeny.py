"""Distances, trees and organism weights."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.workspace import saved


def symmetric(dist: DataFrame) -> DataFrame:
    """Both orders of every pair of (a, b, d), and a zero diagonal."""
    d = dist.where("a <> b").select("a", "b", "d")
    names = d.select("a").union(d.select("b")).distinct()
    return d.union(d.select("b", "a", "d")).distinct().union(names.select("a", F.col("a").alias("b"), F.lit(0.0).alias("d")))


def upgma(names: list[str], dist: np.ndarray) -> list[tuple[str, str, float]]:
    """Edges (parent, child, length) of the average-linkage tree; inner nodes are numbered from 1 in the order they are made.

    The nearest two clusters are joined, of equally near ones those with the smaller numbers (leaves first, then as made). Every cluster
    remembers the nearest of those with larger numbers, so a step looks at a row and at those whose nearest is gone; thousands of leaves take seconds.
    """
    d = np.round(np.array(dist, float), 9)
    n = len(names)
    number, size, height = np.arange(n), np.ones(n), np.zeros(n)
    label, live = [str(x) for x in names], np.ones(n, bool)
    near, to = np.full(n, np.inf), np.zeros(n, int)

    def look(i: int) -> None:
        others = np.flatnonzero(live & (number > number[i]))
        near[i] = np.inf
        if len(others):
            near[i] = d[i, others].min()
            ties = others[d[i, others] == near[i]]
            to[i] = ties[number[ties].argmin()]

    for i in range(n):
        look(i)
    edges = []
    for step in range(1, n):
        ties = np.flatnonzero(live & (near == near[live].min()))
        i = int(ties[number[ties].argmin()])
        j, best = int(to[i]), float(near[i]) / 2
        edges += [(str(step), label[i], best - float(height[i])), (str(step), label[j], best - float(height[j]))]
        live[j] = False
        merged = np.round((size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j]), 9)
        d[i], d[:, i] = merged, merged
        size[i], height[i], label[i], number[i], near[i] = size[i] + size[j], best, str(step), n + step, np.inf
        for k in np.flatnonzero(live & ((to == i) | (to == j)) & (np.arange(n) != i)):
            look(k)
        closer = np.flatnonzero(live & (merged < near) & (np.arange(n) != i))
        near[closer], to[closer] = merged[closer], i
    return edges


def tree_of(dist: DataFrame) -> DataFrame:
    """Average-linkage tree of a symmetric (a, b, d): organisms are dozens, so the matrix is small."""
    rows = dist.collect()
    names = sorted({r["a"] for r in rows})
    at = {n: i for i, n in enumerate(names)}
    m = np.zeros((len(names),) * 2)
    for r in rows:
        m[at[r["a"]], at[r["b"]]] = r["d"]
    return dist.sparkSession.createDataFrame(upgma(names, m), "parent string, child string, length double")


def tree_length(edges: DataFrame) -> DataFrame:
    return edges.agg(F.sum("length").alias("tree_length"))


def ancestors(edges: DataFrame) -> DataFrame:
    """(node, ancestor, steps, via): every ancestor of a node, and the child of it on the way.

    Doubles: from the ancestors up to 2^k steps away, and each node's jump of 2^k steps, come those up to 2^(k+1), so a tree of any depth takes
    a join per digit of it. Edges that run in a circle are refused.
    """
    near = saved(edges.select(F.col("child").alias("node"), F.col("parent").alias("ancestor"), F.lit(1).cast("long").alias("steps"), F.col("child").alias("via")))
    reach, nodes = 1, near.count()
    while True:
        jump = near.where(F.col("steps") == reach).select("node", F.col("ancestor").alias("at"))
        far = jump.join(near.withColumnRenamed("node", "at"), "at").select("node", "ancestor", (F.col("steps") + reach).alias("steps"), "via")
        far = saved(far)
        if far.isEmpty():
            return near
        if reach > nodes:
            raise ValueError("edges run in a circle")
        near, reach = saved(near.unionByName(far)), 2 * reach


def subtree_lengths(edges: DataFrame) -> DataFrame:
    """(node, below): branch length below each inner node, without its own branch."""
    own = edges.select(F.col("child").alias("node"), "length")
    return ancestors(edges).join(own, "node").groupBy(F.col("ancestor").alias("node")).agg(F.sum("length").alias("below"))


def leaf_weights(edges: DataFrame) -> DataFrame:
    """(organism, weight): over a leaf's ancestors the product of (b + L/2) / (S + L), where S is the branch length below
    the ancestor, L its own branch (0 at the root), and b the leaf's branch at its parent, S + L of the ancestor before
    above. A tree without length weighs all leaves alike."""
    below = subtree_lengths(edges)
    own = edges.select(F.col("child").alias("node"), F.col("length").alias("own"))
    nodes = below.join(own, "node", "left").select("node", "below", F.coalesce("own", F.lit(0.0)).alias("own"))
    leaves = edges.select("child").join(edges.select(F.col("parent").alias("child")), "child", "left_anti").select(F.col("child").alias("node"))
    path = ancestors(edges).join(leaves, "node")
    up = nodes.select(F.col("node").alias("ancestor"), F.col("below").alias("s"), F.col("own").alias("l"))
    via = nodes.select(F.col("node").alias("via"), (F.col("below") + F.col("own")).alias("carried"))
    leaf = edges.select(F.col("child").alias("via"), F.col("length").alias("branch"))
    path = path.join(up, "ancestor").join(via, "via", "left").join(leaf, "via").withColumn("b", F.coalesce("carried", "branch"))
    factor = F.try_divide(F.col("b") + F.col("l") / 2, F.col("s") + F.col("l"))
    out = path.groupBy("node").agg(F.product(factor).alias("weight"))
    n = leaves.agg(F.count("*").alias("n"))
    total = tree_length(edges)
    out = leaves.join(out, "node").join(F.broadcast(n)).join(F.broadcast(total))  # one row each
    return out.select(F.col("node").alias("organism"), F.when(F.col("tree_length") == 0, 1 / F.col("n")).otherwise(F.col("weight")).alias("weight"))


def rooted_weights(weights: DataFrame, root: float) -> DataFrame:
    """weight ^ (1 / root); 0 makes all weights 1."""
    value = F.lit(1.0) if root == 0 else F.pow(F.col("weight"), F.lit(1.0 / root))
    return weights.withColumn("weight", value)


def heavy_weights(weights: DataFrame, limit: float = 0.5) -> DataFrame:
    """Organisms whose weight deserves a warning."""
    return weights.where(F.col("weight") > limit)
