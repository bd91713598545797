"""Connected components and hop distances of graphs held as edge tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from fluoroframe.plans.cut import cut, forget


def merge_pairs(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of the component of each of ``n`` vertices."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        apart = ra != rb
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
    return root


def connected(edges: DataFrame, keys: list[str], src: str = "src", dst: str = "dst") -> DataFrame:
    """Smallest member of the component of every vertex that has an edge.

    Returns ``keys, node, root``.  One path for graphs of every size: rounds of joins
    and partial minima over written tables.
    """
    plain = edges.select(
        *keys,
        F.least(src, dst).cast("long").alias("a"),
        F.greatest(src, dst).cast("long").alias("b"),
    )
    return _rounds(plain.where("a < b").distinct(), keys)


def _rounds(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Each round takes the smallest label among the
    neighbours, hooks the old parent to it, and jumps one pointer; the number of
    rounds grows with the logarithm of the longest chain.  All aggregations are
    ``min`` with partial combine; the pointer jump, whose key may be one giant
    component, is a plain join that adaptive execution splits.
    """
    pairs = cut(edges.unionByName(edges.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))))
    state = cut(
        pairs.groupBy(*keys, "a")
        .agg(F.min("b").alias("m"))
        .select(*keys, F.col("a").alias("node"), F.least("a", "m").alias("root"))
    )
    while True:
        here = state.select(*keys, F.col("node").alias("b"), F.col("root").alias("rb"))
        heard = pairs.join(here, [*keys, "b"]).groupBy(*keys, "a").agg(F.min("rb").alias("m"))
        told = state.join(heard.withColumnRenamed("a", "node"), [*keys, "node"])
        offers = told.select(
            *keys,
            F.explode(
                F.array(
                    F.struct(F.col("node"), F.least("root", "m").alias("cand")),
                    F.struct(F.col("root").alias("node"), F.least("root", "m").alias("cand")),
                )
            ).alias("o"),
        ).select(*keys, "o.node", "o.cand")
        hooked = cut(offers.groupBy(*keys, "node").agg(F.min("cand").alias("parent")))
        above = hooked.select(*keys, F.col("node").alias("up"), F.col("parent").alias("root"))
        jumped = hooked.join(above.withColumnRenamed("up", "parent"), [*keys, "parent"])
        jumped = jumped.select(*keys, "node", "root")
        new = cut(jumped.join(state.withColumnRenamed("root", "old"), [*keys, "node"]), hooked, state)
        changed = new.where(F.col("root") != F.col("old")).limit(1).count()
        state = new.select(*keys, "node", "root")
        state._cut_path = new._cut_path
        if not changed:
            forget(pairs)
            return state
