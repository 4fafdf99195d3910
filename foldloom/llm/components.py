"""Connected components of a graph of links, by large-star and small-star steps until nothing changes.

Each step is two joins and aggregates over links, written to the shared folder; a hub with very many links is an
aggregate that combines before the shuffle and a join that adaptive execution may split. Nothing reaches the driver but
one count and one checksum a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import dropped, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """``edges``: (u, v), u > v. Large: of each node, links to greater ones move to the least of all its
    neighbours and itself. Small: links to lesser neighbours, and the node itself, move to the least of them."""
    if large:
        near = edges.select("u", "v").union(edges.select(F.col("v"), F.col("u")))
    else:
        near = edges
    least = near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    moved = near.join(least, "u")
    if large:
        out = moved.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = moved.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the least node that each node with a link can reach."""
    edges = written(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "links")
    mark = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark, before = now, edges
        edges = written(_star(_star(edges, True), False).distinct(), "links")
        dropped(before)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v"), F.col("v")).distinct())


def extended(parts: DataFrame, links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``parts``, as :func:`components` makes them, with more links: those between different components alone are stepped
    through, from component to component."""
    top = lambda c: parts.select(F.col("node").alias(c), F.col("component").alias(f"top_{c}"))
    tops = links.select(F.col(a).alias("a"), F.col(b).alias("b")).join(top("a"), "a", "left").join(top("b"), "b", "left")
    between = tops.select(F.coalesce("top_a", "a").alias("a"), F.coalesce("top_b", "b").alias("b")).where("a <> b").distinct()
    moved = written(components(between), "moved")
    old = parts.join(moved.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return old.union(moved.join(parts.select("node"), "node", "left_anti").select("node", "component"))
