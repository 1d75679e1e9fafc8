"""Connected components of a link table by rounds of hooking to the smallest neighbour and pointer jumping.

Before a round each task contracts the links that it reads to stars, which takes whole groups together where their links lie near each
other. A round is a grouped minimum (combined before its shuffle) and joins that adaptive execution may split; its result is a table
in the shared folder, so that lineage stays short and a lost executor costs one round at most.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Links that a task holds at a time while it contracts them, some 200 MB.
HELD_LINKS = 2_000_000


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node reachable) of all nodes of the links that aren't their own root."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    parent = np.arange(len(nodes))
    while len(x):
        while not np.array_equal(up := parent[parent], parent):
            parent = up
        x, y = parent[x], parent[y]
        apart = x != y
        x, y = x[apart], y[apart]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
    at = np.flatnonzero(parent != np.arange(len(nodes)))
    return nodes[at], nodes[parent[at]]


def _contracted(batches):
    held, size = [], 0

    def out():
        a, b = roots(*(np.concatenate(x) for x in zip(*held)))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    for batch in batches:
        held.append([batch.column(c).to_numpy() for c in ("a", "b")])
        size += batch.num_rows
        if size > HELD_LINKS:
            yield out()
            held, size = [], 0
    if held:
        yield out()


def _round(links: DataFrame) -> DataFrame:
    """Over (a, b) with a > b: every node's other links go to its smallest neighbour, and the node to that one's own smallest neighbour.

    A node is an `a` once per task that met it, so no node is a hub there; the many nodes of one root meet it in a join alone."""
    lowest = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(lowest, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    up = lowest.select(F.col("a").alias("_a"), F.col("m").alias("_m"))
    jumped = lowest.join(up, F.col("m") == F.col("_a"), "left").select("a", F.coalesce("_m", "m").alias("b"))
    return moved.union(jumped).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node that has a link to another; component is the smallest node reachable. Links to null or to oneself count for nothing."""
    links = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"), F.col(a).isNotNull().alias("x"), F.col(b).isNotNull().alias("y")).filter("x and y and a > b")
    links = materialize(links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).mapInArrow(_contracted, "a long, b long"), "links")
    mark = None
    while True:
        links = materialize(links.mapInArrow(_contracted, "a long, b long"), "links")
        # Stars with roots that are no node of another star are the result: every task has seen a node's only link.
        seen = links.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.lit(0))).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
        links = materialize(_round(links), "links")
    stars = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.union(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
