"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import discard, settle


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Link each vertex's larger (or not larger) neighbours to the smallest vertex around it.

    The smallest ones are written first, so that Spark can split the join at a vertex of many neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = both if large else both.where("v <= u")
    least = settle(near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    linked = near.join(least, "u")
    if large:
        out = linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    stars = settle(out.where("u <> v").distinct(), "stars")
    discard(least)
    return stars


def components(links: DataFrame) -> DataFrame:
    """Links (u, v) to (id, component): the smallest id that each linked id reaches. Unlinked ids are absent.

    Each turn is written to the shared folder, and the turn before it deleted."""
    edges = settle(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "links")
    mark = None
    while True:
        between = _stars(edges, True)
        discard(edges)
        edges = _stars(between, False)
        discard(between)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    ids = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return ids.unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
