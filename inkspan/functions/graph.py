"""Connected components of links between keys of any orderable type, and lineage cuts for iterative jobs."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_ROUNDS = 64


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir; a temporary one only in local mode without it."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named and not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not context.getCheckpointDir():
        context.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="inkspan-"))
    return named or context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder, from where all that follows reads it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def components(links: DataFrame) -> DataFrame:
    """links: (a, b). Returns (id, root) for every id in a link; root is the smallest id that links reach.

    Each id keeps a parent, at first the smallest of its neighbours and itself.  A round hooks the parents of the two
    ends of every link onto the smaller one and then halves paths; links whose ends share a parent drop out.  A round is
    a few joins and ends in the shared folder; the driver sees one count.
    """
    ends = links.where(F.col("a") != F.col("b")).select("a", "b")
    both = ends.unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b")))
    parents = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("root")))
    live = cut(ends.distinct())
    for _ in range(MOST_ROUNDS):
        # links between the present roots
        up = live.join(parents.select(F.col("id").alias("a"), F.col("root").alias("x")), "a").join(parents.select(F.col("id").alias("b"), F.col("root").alias("y")), "b")
        live = cut(up.where(F.col("x") != F.col("y")).select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct())
        hooks = live.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("hook"))
        hooked = parents.join(hooks, "id", "left").select("id", F.least("root", F.coalesce("hook", "root")).alias("root"))
        above = hooked.select(F.col("id").alias("root"), F.col("root").alias("top"))
        new = cut(hooked.join(above, "root").select("id", F.col("top").alias("root"), (F.col("top") != F.col("root")).alias("moved")))
        moved = new.where("moved").limit(1).count()
        parents = new.select("id", "root")
        if not moved and live.limit(1).count() == 0:
            return parents
    raise RuntimeError("the components did not settle")
