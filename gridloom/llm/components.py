"""Connected components of a link table.

Up to :data:`MOST_LINKS` links meet in one task, which joins them in memory;
rounds of joins over so few rows would be nearly all overhead of tasks and
files. More links are joined by alternating large-star and small-star steps
(Kiveris et al., "Connected Components in MapReduce and Beyond", 2014): each
round halves the height of the label trees, so the count of rounds grows with
the logarithm of the longest path. Links never reach the driver; each round is
cut into the shared folder once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH_ROWS, cut, drop_cut

#: Links that one task joins at most (16 bytes each, and some ten times as much while it works).
MOST_LINKS = 1 << 20


def least_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of links ``a[i] - b[i]``, ascending, and the least node that each reaches.

    In each round every root with a lesser neighbour hooks to its least one;
    in two rounds at least half of a component's roots do.
    """
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        u, v = root[u], root[v]
        open_ = u != v
        if not open_.any():
            return nodes, nodes[root]
        u, v = u[open_], v[open_]
        np.minimum.at(root, np.maximum(u, v), np.minimum(u, v))
        while not np.array_equal(up := root[root], root):
            root = up


def _joined(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [[c.to_numpy() for c in batch.columns] for batch in it]
    if parts:
        nodes, least = least_reachable(*(np.concatenate(x) for x in zip(*parts)))
        for i in range(0, len(nodes), BATCH_ROWS):
            yield pa.RecordBatch.from_arrays([pa.array(x[i : i + BATCH_ROWS]) for x in (nodes, least)], names=["node", "component"])


def _star(both: DataFrame) -> DataFrame:
    """Each node of ``both`` (u, v) with the least of itself and its neighbours."""
    return both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def _measure(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(links: DataFrame, label: str = "cc") -> DataFrame:
    """``links(a, b)``, long -> ``(node, component)``, component the least node reachable.

    Nodes without a link do not appear. Loops, repeated and null links are
    ignored. Empty input gives an empty table. ``links`` is read twice: where
    it is in files, its rows are counted from their footers.
    """
    if links.count() <= MOST_LINKS:
        return links.where("a <> b").select("a", "b").repartition(1).mapInArrow(_joined, "node long, component long")
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = cut(edges, label)
    was = _measure(edges)
    while True:
        both = edges.selectExpr("a u", "b v").unionAll(edges.selectExpr("b u", "a v"))
        large = both.join(_star(both), "u").where("v > u").selectExpr("v a", "m b").distinct()
        low = large.selectExpr("a u", "b v")
        low_min = low.groupBy("u").agg(F.min("v").alias("m"))
        small = low.join(low_min, "u").select(
            F.explode(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("e")
        )
        new = cut(small.select("e.a", "e.b").where("a <> b").distinct(), label)
        now = _measure(new)
        drop_cut(edges)
        edges = new
        if now == was:
            break
        was = now
    return edges.selectExpr("a node", "b component").unionAll(edges.selectExpr("b node", "b component").distinct())
