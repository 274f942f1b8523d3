"""Split lists, resuming, look-ups and batching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.order import digits, numbered, shuffle_key


def within_split(labels: DataFrame, split: DataFrame | None, key: str = "rel_path") -> DataFrame:
    """Rows whose path is in the split, duplicates included; no split means all."""
    return labels if split is None else labels.join(split.select(key), key, "left_semi")


def not_done(images: DataFrame, done: DataFrame, key: str = "rel_path") -> DataFrame:
    return images.join(done.select(key), key, "left_anti")


def seeded_order(paths: DataFrame, seed: int, key: str = "rel_path") -> DataFrame:
    """All rows with `pos` from 1 in a seeded order that depends only on seed and path.

    The order key is a digest, so its first digits deal rows evenly into buckets.
    """
    keyed = paths.withColumn("__key", shuffle_key(F.col(key), seed))
    return numbered(keyed, F.substring("__key", 1, digits(paths.count())), ["__key", key], "pos").drop("__key")


def train_val(paths: DataFrame, seed: int, fraction: float, key: str = "rel_path") -> DataFrame:
    """Every path with `is_val`: the first max(1, int(n * fraction)) of the seeded order are validation.

    Membership is by value: all rows of a validation path are validation.
    """
    n = paths.count()
    first = seeded_order(paths, seed, key).where(F.col("pos") <= max(1, int(n * fraction))).select(key).distinct().withColumn("__val", F.lit(True))
    return paths.join(first, key, "left").select(*paths.columns, F.col("__val").isNotNull().alias("is_val"))


def exact_shuffle(paths: list[str], seed: int) -> list[str]:
    """The order a seeded generator of the standard library gives; for lists that fit on one machine."""
    import random

    out = list(paths)
    random.Random(seed).shuffle(out)
    return out


def last_of_each(df: DataFrame, key: str, ordinal: str) -> DataFrame:
    """One row per key, that of the largest ordinal, as a dictionary keeps it."""
    return df.groupBy(key).agg(F.max_by(F.struct(*[c for c in df.columns if c != key]), ordinal).alias("__r")).select(key, "__r.*")


def first_of_each(df: DataFrame, key: str, ordinal: str) -> DataFrame:
    return df.groupBy(key).agg(F.min_by(F.struct(*[c for c in df.columns if c != key]), ordinal).alias("__r")).select(key, "__r.*")


def row_at(df: DataFrame, ordinal: str, at: int | None = None, where: Column | None = None) -> DataFrame:
    """The row of an ordinal, or the first by ordinal that matches; fails if there is none."""
    found = (df.where(F.col(ordinal) == at) if at is not None else df.where(where)).orderBy(ordinal).limit(1)
    if at is not None and at < 0:
        raise IndexError(at)
    if found.isEmpty():
        raise LookupError("no such row")
    return found


def batches(ordered: DataFrame, pos: str, size: int, drop_last: bool) -> DataFrame:
    """`batch_id` from 0 of rows numbered from 1 by pos; drop_last leaves out a short last batch."""
    out = ordered.withColumn("batch_id", F.floor((F.col(pos) - 1) / size).cast("long"))
    if not drop_last:
        return out
    full = out.groupBy("batch_id").count().where(F.col("count") == size).select("batch_id")
    return out.join(full, "batch_id", "left_semi")


def collated(batched: DataFrame, pos: str) -> DataFrame:
    """One row per batch with its members as an array in order."""
    own = [c for c in batched.columns if c != "batch_id"]
    return batched.groupBy("batch_id").agg(F.sort_array(F.collect_list(F.struct(pos, *[c for c in own if c != pos]))).alias("members"))


def status_counts(df: DataFrame, done: Column, failed: Column) -> DataFrame:
    """One row: ok, skipped, failed."""
    return df.agg(F.count_if(~done & ~failed).alias("ok"), F.count_if(done).alias("skipped"), F.count_if(~done & failed).alias("failed"))


def nth_worst(df: DataFrame, loss: str, ordinal: str, n: int) -> DataFrame:
    """The n-th row (from 0) by descending loss, ties by ordinal."""
    top = df.orderBy(F.desc(loss), ordinal).limit(n + 1)
    return top.withColumn("__r", F.row_number().over(Window.orderBy(F.desc(loss), ordinal))).where(F.col("__r") == n + 1).drop("__r")


def zipped(left: Column, right: Column) -> Column:
    """Pairs of two arrays' elements, as many as the shorter one has; null if either array is."""
    size = F.least(F.size(left), F.size(right))
    return F.when(left.isNotNull() & right.isNotNull(), F.slice(F.arrays_zip(left.alias("left"), right.alias("right")), 1, size))
