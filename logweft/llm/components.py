"""Connected components of a table of links, by alternating large-star and small-star steps.

Each step is a map-side combined minimum per vertex and an equi-join on the same partitioning, so no component is ever
gathered anywhere. Every round is written to the shared folder. Tables of links are narrow: their shuffles take as many
partitions as their counted rows ask for, not as many as those of texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from logweft.llm import common as c

#: Links of one shuffle partition.
PARTITION_ROWS = 500_000


def _star(edges: DataFrame, large: bool, parts: int) -> DataFrame:
    """``u, v`` edges with u > v, turned to the smallest neighbour of each vertex."""
    turned = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    near = (edges.unionByName(turned) if large else edges).repartition(parts, "u")
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = near.join(least, "u")
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = (joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
                     .unionByName(least.select("u", F.col("m").alias("v"))))
    return out.filter("u <> v").repartition(parts, "u").distinct()


def _are_stars(edges: DataFrame, parts: int) -> bool:
    """Whether each vertex has one end: a root itself, any other its root."""
    ends = edges.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(
        edges.select(F.col("v").alias("x"), F.col("v").alias("y")))
    odd = ends.repartition(parts, "x").groupBy("x").agg(F.min("y").alias("a"), F.max("y").alias("b")).filter("a < b")
    return not odd.limit(1).count()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``id, component`` (the smallest id reachable) of every vertex that has a link and is not that smallest id."""
    rows = c.written(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v"), "links")
    parts = max(1, -(-2 * rows.count() // PARTITION_ROWS))
    edges = c.written(rows.repartition(parts, "u").distinct(), "edges")
    c.removed(rows)
    while not _are_stars(edges, parts):
        large = c.written(_star(edges, True, parts), "large-star")
        small = c.written(_star(large, False, parts), "small-star")
        c.removed(edges, large)
        edges = small
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
