"""Connected components of a graph given as rows, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.shared import written


#: A node of more than a thousandth of the edges has its minimum broadcast; at most 2,000 nodes can.
HUB_PARTS = 1000


def with_least(edges: DataFrame, total: int) -> DataFrame:
    """(``a``, ``b``, ``m``): each edge with the least ``b`` of its ``a``; edges of hubs are not shuffled by their node."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    hubs = least.filter(F.col("n") * HUB_PARTS > total).selectExpr("a", "m AS hub")
    marked = edges.join(F.broadcast(hubs), "a", "left")
    rest = marked.filter("hub IS NULL").select("a", "b").join(least.select("a", "m"), "a")
    return marked.filter("hub IS NOT NULL").selectExpr("a", "b", "hub AS m").unionByName(rest)


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """Links every larger neighbour of a node to the least of its neighbours and itself."""
    both = edges.unionByName(edges.selectExpr("b AS a", "a AS b"))
    links = with_least(both, total).filter("b > a")
    return links.selectExpr("b AS a", "least(a, m) AS b").filter("a <> b").distinct()


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """Links a node and its smaller neighbours to the least of them; edges come as (larger, smaller)."""
    moved = with_least(edges, total).selectExpr("b AS a", "m AS b")
    own = edges.groupBy("a").agg(F.min("b").alias("b"))
    return moved.unionByName(own).filter("a <> b").distinct()


def roots(edges: DataFrame) -> DataFrame:
    """(``node``, ``root``): each node that has an edge in ``a``, ``b`` and is not the least of its component.

    Rounds until nothing changes, each step written to the shared folder. A node of
    high degree meets its minimum in a broadcast, so its rows stay where they are.
    """
    current = written(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges"
    )
    seen = None
    while True:
        now = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen or now[0] == 0:
            return current.selectExpr("a AS node", "b AS root")
        seen = now
        # Each step reads its edges many times, so a plan of both together is many times as long.
        large = written(_large_star(current, now[0]), "large-star")
        current = written(_small_star(large, now[0]), "edges")
