"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import forget, keep


def _with_least(edges: DataFrame) -> DataFrame:
    """Each edge with ``m``, the least of a and all its neighbours; minima are taken before the shuffle, so that a node
    of very many edges is no task's own."""
    least = edges.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return edges.join(least, "a")


def components(edges: DataFrame) -> DataFrame:
    """Nodes of edges (a, b), each with the least node of its component: node, component.

    Every node hangs from a smaller neighbour until all hang from the least; each round at least halves the
    depth. A round is one table in the shared folder, which goes when the next is there. Self-loops, repeated edges and
    either direction are allowed; edges with a null end are dropped; no edges give no rows.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    edges, before = keep(edges, "edges"), None
    if edges.isEmpty():
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _with_least(both).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        star = _with_least(large)
        small = star.select("a", F.col("m").alias("b")).union(star.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()
        last, edges = edges, keep(small, "edges")
        forget(last)
        after = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003)).first()
        if after == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())
        before = after
