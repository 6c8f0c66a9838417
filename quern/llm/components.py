"""Connected components by large-star and small-star steps over an edge table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each node to the least node of its component, over the given edges alone."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while True:
            jump = new[new]
            if (jump == new).all():
                break
            new = jump
        if (new == root).all():
            break
        root = new
    far = root != np.arange(len(nodes))
    return nodes[far], nodes[root[far]]


def contract(edges: DataFrame) -> DataFrame:
    """Each batch of edges (u, v) as a star forest of the same components; never more rows than before."""

    def of(batches):
        for b in batches:
            if b.num_rows:
                u, v = _forest(b.column(0).to_numpy(), b.column(1).to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return edges.select("u", "v").mapInArrow(of, "u long, v long")


def connected_components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, component) for all nodes of edges (u long, v long): component is the least node reachable.

    Large-star links all larger neighbours of a node to its least neighbour, small-star its smaller ones; both
    are a partial minimum and an equi-join that Spark may split where a node has many neighbours. Each round is
    written to the shared folder. Rounds grow with the logarithm of the largest component. Self loops and
    repeated edges are allowed; nulls are ignored; no edges give no rows.
    """
    e = contract(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    e = materialise(e.distinct(), "edges")

    def star(pairs: DataFrame, both: bool) -> DataFrame:
        """pairs: (u > v). Each neighbour of a node that is larger (both), or each smaller one, goes to the least."""
        at = pairs.select(F.col("u").alias("n"), F.col("v").alias("m"))
        if both:
            at = at.unionByName(pairs.select(F.col("v").alias("n"), F.col("u").alias("m")))
        least = at.groupBy("n").agg(F.least(F.min("m"), F.col("n")).alias("low"))
        # the join gets a key and so an exchange of its own: Spark splits it where a node has many neighbours
        apart = F.bitwise_not(F.col("n"))
        linked = at.withColumn("k", apart).join(least.select(apart.alias("k"), "low"), "k")
        if both:
            return linked.where("m > n").select(F.col("m").alias("u"), F.col("low").alias("v"))
        own = least.select(F.col("n").alias("u"), F.col("low").alias("v"))
        return linked.where("m <> low").select(F.col("m").alias("u"), F.col("low").alias("v")).unionByName(own)

    for _ in range(most):
        below = e.join(e.select(F.col("u").alias("v")), "v", "left_semi").select("u")
        torn = e.groupBy("u").agg(F.min("v").alias("a"), F.max("v").alias("b")).where("a < b").select("u")
        if below.unionByName(torn).isEmpty():  # each node hangs on one root, and roots hang on none
            break
        e = materialise(contract(star(star(e, True).where("u <> v").distinct(), False).where("u <> v")).distinct(), "edges")
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
