"""Connected components by alternating large-star and small-star contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import materialise, row_count

#: Up to so many edges (16 bytes each) are solved in one task, without rounds of shuffles.
LOCAL_EDGES = 2_000_000


def roots_of(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """For nodes 0 to n-1 the smallest node of the component, by hooking roots on smaller ones and halving paths."""
    root = np.arange(n)
    while len(u):
        a, b = root[u], root[v]
        differ = a != b
        u, v = u[differ], v[differ]
        a, b = a[differ], b[differ]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def _solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    frames = list(frames)
    u = np.concatenate([f["u"].to_numpy() for f in frames] or [np.empty(0, dtype=np.int64)])
    v = np.concatenate([f["v"].to_numpy() for f in frames] or [np.empty(0, dtype=np.int64)])
    nodes, code = np.unique(np.concatenate([u, v]), return_inverse=True)
    root = roots_of(code[: len(u)], code[len(u) :], len(nodes))
    for a in range(0, len(nodes), 100_000):
        yield pd.DataFrame({"node": nodes[a : a + 100_000], "root": nodes[root[a : a + 100_000]]})


def _large_star(e: DataFrame) -> DataFrame:
    """Each larger neighbour of a node is hung on the smallest of the node and its neighbours."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are hung on the smallest of them."""
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.withColumnRenamed("m", "v")).distinct()


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, root) for every node of ``edges``; the root is the smallest node of its component.

    Edges count in both directions; loops give a node its own component;
    edges with a null end are ignored. Minima are pre-aggregated and joined
    back, so a node with very many edges does not gather them in one task.
    """
    known = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
    e = materialise(known.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), counted=True)
    if row_count(e) <= LOCAL_EDGES:
        kind = e.schema["u"].dataType.simpleString()
        return e.coalesce(1).mapInPandas(_solve, f"node {kind}, root {kind}")
    loops = e.filter("u = v").select(F.col("u").alias("node"), F.col("v").alias("root"))
    e, before = e.filter("u > v"), None
    while True:
        e = materialise(_small_star(_large_star(e)))
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    hung = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = hung.select(F.col("root").alias("node"), "root").distinct()
    found = hung.unionByName(roots)
    return found.unionByName(loops.join(found, "node", "left_anti"))
