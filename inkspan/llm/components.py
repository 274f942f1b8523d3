"""Connected components of a table of links, by alternating large and small stars.

Every round is a few aggregations and joins of the links and ends in the shared
folder; nothing is gathered on the driver but one count per round, of the ids that are not yet in a star.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut


def _least(links: DataFrame, to_smaller: bool) -> DataFrame:
    """For each u the smallest of u and its neighbours (only smaller ones, if asked)."""
    near = links.where(F.col("v") < F.col("u")) if to_smaller else links
    return near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _are_stars(edges: DataFrame) -> bool:
    """Whether each u has one v, and no v is a u: then v names the component of u."""
    ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("as_u"), F.lit(0).alias("as_v")).unionByName(edges.select(F.col("v").alias("id"), F.lit(0).alias("as_u"), F.lit(1).alias("as_v")))
    sums = ends.groupBy("id").agg(F.sum("as_u").alias("n"), F.max("as_v").alias("m"))
    return sums.agg(F.count_if((F.col("n") > 1) | (F.col("n") == 1) & (F.col("m") == 1))).first()[0] == 0


def components(links: DataFrame, most_rounds: int = 64, settled: bool = True) -> DataFrame:
    """links: (u, v) of longs. Returns (id, component) for every id in a link; component is its smallest id.

    Not settled: the state after most_rounds, in which equal components are right but one may have several names.
    """
    edges = cut(links.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(most_rounds):
        if settled and _are_stars(edges):
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least(both, False), "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where(F.col("u") != F.col("v")).distinct()
        least = _least(large, True)
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = cut(small.where(F.col("u") != F.col("v")).distinct())
    else:
        if settled and not _are_stars(edges):
            raise RuntimeError("the components did not settle")
        if not settled:
            edges = edges.groupBy("u").agg(F.min("v").alias("v"))
    stars = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    ends = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return stars.unionByName(ends if settled else ends.join(edges.select(F.col("u").alias("id")), "id", "left_anti"))
