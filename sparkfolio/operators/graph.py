"""Connected components of an edge table, in rounds whose results are written."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkfolio.session import cut_lineage


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): for every node of an edge the least node that edges lead to. Nodes may be of any type with an order.

    Alternating large-star and small-star rounds: each node links its larger neighbours to the least of its neighbourhood, then its smaller
    ones and itself, until nothing moves. A round is four aggregations and joins over edges of two nodes; no group is gathered.
    """
    now = cut_lineage(edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).filter("a <> b").distinct())
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.join(low, "a").filter("b > a AND b <> low").select(F.col("low").alias("a"), "b").distinct()
        parent = large.groupBy("b").agg(F.min("a").alias("low"))
        joined = large.join(parent, "b").select("low", F.explode(F.array("a", "b")).alias("b"))
        now = cut_lineage(joined.filter("low <> b").select(F.col("low").alias("a"), "b").distinct())
        before, state = state, _state(now)
        if state == before:
            break
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())


def labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node of the component of each of the nodes 0 to n - 1, by edges (a, b): for graphs that a task holds."""
    low = np.arange(n)
    while True:
        least, new = np.minimum(low[a], low[b]), low.copy()
        for at in (a, b, low[a], low[b]):
            np.minimum.at(new, at, least)
        new = new[new]
        if np.array_equal(new, low):
            return low
        low = new
