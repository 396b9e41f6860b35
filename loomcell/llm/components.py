"""Connected components of a large undirected graph, by alternating stars.

Every round is a pair of aggregations and joins on edges, written to the shared
folder; no vertex's neighbours are ever gathered in one task: minima are
pre-aggregated where the edges lie and written too, so that a join has nothing but
exchanges under it and adaptive execution may split a hub that holds a third of all edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomcell.llm.common import discard, materialise


def _large_star(edges: DataFrame) -> DataFrame:
    """Link each larger neighbour of a vertex to the smallest vertex in reach."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = materialise(both.groupBy("a").agg(F.min(F.least("a", "b")).alias("m")), "least")
    out = materialise(both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct(), "edges")
    discard(least)
    return out


def _small_star(edges: DataFrame) -> DataFrame:
    """Link each smaller neighbour of a vertex, and the vertex, to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = materialise(down.groupBy("a").agg(F.min("b").alias("m")), "least")
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    out = materialise(moved.union(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct(), "edges")
    discard(least)
    return out


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of an edge; component is its smallest node.

    ``edges`` has two comparable columns a and b.  Self-loops and nulls are ignored,
    so their nodes appear only if another edge names them; no edges give no rows.
    """
    edges = materialise(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    state = None
    while True:
        large = _large_star(edges)
        discard(edges)
        edges = _small_star(large)
        discard(large)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
        state = now
