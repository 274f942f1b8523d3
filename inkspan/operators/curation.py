"""Dropping noisy samples by their loss."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.order import percentiles


def reject_nan(df: DataFrame, loss: str) -> DataFrame:
    """A NaN loss would silently empty the result; it fails instead."""
    return df.withColumn(loss, F.when(F.isnan(F.col(loss).cast("double")), F.raise_error(F.lit("loss is NaN")).cast("double")).otherwise(F.col(loss)))


def within_percentile(df: DataFrame, loss: str, q: float) -> DataFrame:
    """Rows whose loss is at most the q-th percentile; the threshold is a literal, so the filter reaches the scan."""
    [limit] = percentiles(reject_nan(df, loss), loss, [q])
    return df.where(F.col(loss) <= F.lit(limit))


def beyond_percentile(df: DataFrame, loss: str, q: float) -> DataFrame:
    """The other rows; order them by descending loss and ordinal to look at the worst."""
    [limit] = percentiles(reject_nan(df, loss), loss, [q])
    return df.where(F.col(loss) > F.lit(limit))


def summary(df: DataFrame, loss: str, at: list[float]) -> DataFrame:
    """One row: n, least, most and the percentiles p0, p1, ..."""
    p = percentiles(df, loss, at)
    return df.agg(F.count(loss).alias("n"), F.min(loss).alias("least"), F.max(loss).alias("most")).select("*", *(F.lit(v).alias(f"p{i}") for i, v in enumerate(p)))


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """bin (from 0), count of equal-width bins; the largest value falls into the last bin."""
    r = df.agg(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi")).first()
    if r["lo"] is None:
        return df.sparkSession.createDataFrame([], "bin int, count long")
    lo, width = r["lo"], r["hi"] - r["lo"]
    place = F.floor((F.col(value) - lo) / width * bins).cast("int") if width else F.lit(0)
    return df.where(F.col(value).isNotNull()).groupBy(F.least(place, F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("count"))
