"""Connected components of an edge table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import staged


def forest(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest number reachable from each of 0..n-1."""
    label = np.arange(n)
    while len(u):
        a, b = label[u], label[v]
        differ = a != b
        if not differ.any():
            break
        u, v, a, b = u[differ], v[differ], a[differ], b[differ]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    return label


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (u, v), root being the least node of its component.

    Alternating large and small stars: each round hangs every node's
    neighbours on the least of them, first the larger neighbours, then the
    rest, until nothing moves. A hub costs a round its number of edges, spread
    by the skew-aware join, never a group in one task. Each round is written
    out, so a lost executor repeats a round at most.
    """
    edges = staged(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        # both columns of every edge end on the least neighbour m of u
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        edges = staged(small, "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    # now each node that is not a root hangs on its root
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
