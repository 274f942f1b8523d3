"""Views that stand for labels, predictions and probability maps on tables without images.

Each has one text for Spark and one for DuckDB (the same where both accept it).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

BOXES_SQL = """
SELECT l_orderkey AS image_id,
  cast(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS int) AS box_idx,
  cast((l_partkey * 7) % 560 AS double) AS x0, cast((l_suppkey * 13) % 560 AS double) AS y0,
  cast(l_quantity + 1 AS double) AS w, cast((l_linenumber * 6) % 20 + 3 AS double) AS h,
  CASE WHEN l_returnflag = 'R' AND floor(l_discount * 100 + 0.5) = 5 THEN NULL ELSE floor(l_discount * 100 + 0.5) / cast(10 AS double) END AS score,
  cast(floor(l_tax * 100 + 0.5) AS double) AS jit
FROM lineitem
"""

PX_SQL = """
SELECT vec_id AS image_id, cast((i // 8) AS int) AS y, cast((i % 8) AS int) AS x,
  cast(1 AS double) / (cast(1 AS double) + exp(cast(-20 AS double) * cast(embedding[i + 1] AS double))) AS p
FROM (SELECT vec_id, embedding, unnest(range(64)) AS i FROM embeddings)
"""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, box_idx, x0, y0, w, h, score, jit of every lineitem."""
    li = read(spark, sf_dir, "lineitem")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    percent = lambda c: F.floor(F.col(c) * 100 + 0.5)
    # numbered first: only the table's own columns are shuffled, and what follows knows that images are together
    return li.withColumn("box_idx", F.row_number().over(order)).select(
        F.col("l_orderkey").alias("image_id"), "box_idx",
        ((F.col("l_partkey") * 7) % 560).cast("double").alias("x0"), ((F.col("l_suppkey") * 13) % 560).cast("double").alias("y0"),
        (F.col("l_quantity") + 1).cast("double").alias("w"), ((F.col("l_linenumber") * 6) % 20 + 3).cast("double").alias("h"),
        F.when((F.col("l_returnflag") == "R") & (percent("l_discount") == 5), None).otherwise(percent("l_discount") / F.lit(10.0)).alias("score"),
        percent("l_tax").cast("double").alias("jit"),
    )


def predictions(boxes: DataFrame) -> DataFrame:
    """The boxes shifted by their jitter: image_id, pred_idx, px0, py0, pw, ph."""
    return boxes.select("image_id", F.col("box_idx").alias("pred_idx"), (F.col("x0") + F.col("jit")).alias("px0"), (F.col("y0") + F.col("jit")).alias("py0"), F.col("w").alias("pw"), F.col("h").alias("ph"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, y, x, p: each 64-dimensional vector as an 8 x 8 probability map."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v"))
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-20.0) * F.col("v").cast("double")))
    return e.select(F.col("vec_id").alias("image_id"), F.floor(F.col("i") / 8).cast("int").alias("y"), (F.col("i") % 8).cast("int").alias("x"), p.alias("p"))


def micro(c):
    """A double as an integer number of millionths, for exact comparison."""
    return F.floor(c * 1e6 + 0.5).cast("long")
