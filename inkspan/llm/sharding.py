"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly.

Documents with equal texts form a group that stays in one shard, unless it is
larger than a shard.  Groups above a share of the corpus are packed one by one
(there can be only 3 * n_shards * LARGE of them); all smaller ones are dealt by
hash into BUNDLES bundles, packed as one item each.  So the driver packs a bounded
number of items, whatever the corpus holds: largest first, each to the shard where
the dot product of its size vector with the residual capacity, its dimensions weighted
by WEIGHTS, is highest.  The law's dimension, bytes, weighs most.

Law: `bytes` (shard sizes are near equal; tokens and rows are balanced beside them).

Slots are gapless per shard without sorting a shard in one task: rows are numbered
inside hash chunks of about CHUNK_ROWS rows and shifted by the chunks before them.

Defined results: a null text counts as empty; repeated rows are documents of their
own, told apart by a row number; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import cut, table

LARGE = 64
BUNDLES = 4096
CHUNK_ROWS = 20_000
#: Of bytes, tokens and rows in the dot product.
WEIGHTS = (16.0, 1.0, 1.0)


def pack_items(sizes: np.ndarray, n_shards: int, weights: tuple[float, ...] = WEIGHTS) -> np.ndarray:
    """Greedy vector packing; sizes: one row of shares (of each dimension's total) per item."""
    residual = np.full((n_shards, sizes.shape[1]), 1.0 / n_shards)
    placed = np.zeros(len(sizes), np.int64)
    for i in np.lexsort((np.arange(len(sizes)), -sizes.max(axis=1))):
        fits = (residual + 1e-12 >= sizes[i]).all(axis=1)
        worth = residual @ (sizes[i] * weights)
        placed[i] = k = int(np.argmax(np.where(fits, worth, -np.inf) if fits.any() else worth))
        residual[k] -= sizes[i]
    return placed


def _piece():
    return F.pmod(F.xxhash64("doc_id", "row"), F.coalesce("pieces", F.lit(1))).cast("string")


def shard(documents: DataFrame, n_shards: int = 8, bundles: int = BUNDLES) -> DataFrame:
    """doc_id, size, text_crc32, n_tokens, shard, slot."""
    spark = documents.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = cut(
        documents.select(
            "doc_id", F.md5(text).alias("group"), (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("n_tokens"),
            F.monotonically_increasing_id().alias("row"),  # kept by the cut, so it holds from here on
        )
    )
    dims = ("size", "n_tokens", "rows")
    groups = cut(docs.groupBy("group").agg(F.sum("size").alias("size"), F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("rows")))
    total = groups.agg(*(F.greatest(F.coalesce(F.sum(d), F.lit(0)), F.lit(1)).alias(d) for d in dims)).first()
    share = F.greatest(*(F.col(d) / F.lit(total[d]) for d in dims))
    large = groups.select("group", *dims, share.alias("share")).where(F.col("share") > 1.0 / (n_shards * LARGE))
    # a group that no shard can hold is dealt out in pieces
    large = large.select("group", *dims, F.when(F.col("share") > 1.0 / n_shards, F.ceil(F.col("share") * n_shards * 8)).otherwise(1).cast("int").alias("pieces"))
    pieces = {r["group"]: r for r in large.collect()}
    small = groups.join(F.broadcast(large.select("group")), "group", "left_anti").groupBy(F.pmod(F.xxhash64("group"), F.lit(bundles)).alias("bundle")).agg(*(F.sum(d).alias(d) for d in dims))
    items = [(f"b{r['bundle']}", *(r[d] / total[d] for d in dims)) for r in small.collect()]
    items += [(f"{g}/0", *(r[d] / total[d] for d in dims)) for g, r in pieces.items() if r["pieces"] == 1]
    known = spark.createDataFrame([(g, r["pieces"]) for g, r in pieces.items()], "group string, pieces int")
    split = docs.join(F.broadcast(known.where("pieces > 1")), "group").groupBy(F.concat("group", F.lit("/"), _piece()).alias("item")).agg(F.sum("size").alias("size"), F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("rows"))
    items += [(r["item"], *(r[d] / total[d] for d in dims)) for r in split.collect()]
    items.sort()
    placed = pack_items(np.array([x[1:] for x in items], float).reshape(len(items), 3), n_shards)
    where = spark.createDataFrame([(x[0], int(k)) for x, k in zip(items, placed, strict=True)], "item string, shard int")
    item = F.when(F.col("pieces").isNotNull(), F.concat(F.col("group"), F.lit("/"), _piece())).otherwise(
        F.concat(F.lit("b"), F.pmod(F.xxhash64("group"), F.lit(bundles)).cast("string"))
    )
    put = docs.join(F.broadcast(known), "group", "left").withColumn("item", item).join(F.broadcast(where), "item")
    chunks = max(1, -(-total["rows"] // (CHUNK_ROWS * n_shards)))
    put = put.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "group", "row"), F.lit(chunks)))
    before = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    shift = put.groupBy("shard", "chunk").count().select("shard", "chunk", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    own = Window.partitionBy("shard", "chunk").orderBy("doc_id", "group", "row")
    numbered = put.withColumn("own", F.row_number().over(own)).join(shift, ["shard", "chunk"])
    return numbered.select("doc_id", "size", "text_crc32", "n_tokens", "shard", (F.col("before") + F.col("own") - 1).cast("long").alias("slot"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(table(spark, sf_dir, "documents"), 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "n_tokens")
