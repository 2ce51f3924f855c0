"""Connected components of a table of links, by alternating star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def connected(links: DataFrame) -> DataFrame:
    """(a, b) to (id, component): for every id of a link the smallest id it reaches.

    Each step hangs neighbours on their smallest neighbour, as a table in the shared folder; the
    number of steps grows with the logarithm of the longest path.
    """
    edges = saved(_down(links.select(F.col("a").alias("u"), F.col("b").alias("v"))), "links")
    mark = _mark(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = _down(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        large = saved(large, "links")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = saved(_down(small), "links")
        new = _mark(edges)
        if new == mark:
            break
        mark = new
    found = edges.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component"))
    return saved(found.unionByName(found.select(F.col("component").alias("id"), "component").distinct()), "components")


def _down(edges: DataFrame) -> DataFrame:
    """Each edge once, from the larger id to the smaller."""
    return edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head())
