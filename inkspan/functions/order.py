"""Dense global numbering and exact percentiles without gathering the table."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets that a numbering has at most, and rows that one should hold.
MOST_BUCKETS, PER_BUCKET = 65_536, 200_000
#: Values that are ranked at once.
GATHERED = 100_000


def numbered(df: DataFrame, bucket: Column, order: list, name: str = "n") -> DataFrame:
    """Numbers rows from 1 in (bucket, order).

    Rows are ranked inside buckets, and each bucket is shifted by the rows of the ones
    before it; the only window over everything has one row per bucket.  The order has
    to refine the buckets' order.  There should be MOST_BUCKETS of them at most, and
    their size bounded; id_bucket() and hex digits of a digest see to both.
    """
    df = df.withColumn("__bucket", bucket)
    before = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = df.groupBy("__bucket").count()
    shift = counts.select("__bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__before"))
    own = df.withColumn("__own", F.row_number().over(Window.partitionBy("__bucket").orderBy(*order)))
    return own.join(shift, "__bucket").withColumn(name, (F.col("__before") + F.col("__own")).cast("long")).drop("__bucket", "__before", "__own")


def id_bucket(df: DataFrame, column: str) -> Column:
    """Runs of ids as buckets, as many as rows need and MOST_BUCKETS at most."""
    facts = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi"), F.count("*").alias("n")).first()
    if facts["lo"] is None:
        return F.lit(0)
    width = max(1, -(-(facts["hi"] - facts["lo"] + 1) // min(MOST_BUCKETS, max(8, facts["n"] // PER_BUCKET))))
    return F.floor((F.col(column) - F.lit(facts["lo"])) / width)


def digits(rows: int) -> int:
    """Hex digits of a digest that deal so many rows into buckets."""
    n = 2
    while 16**n < min(MOST_BUCKETS, rows // PER_BUCKET):
        n += 1
    return n


def at_rank(values: DataFrame, rank: int, n: int) -> float:
    """The value of a rank (from 0) of n values `v`: bracketed by approximate percentiles until few are left."""
    below, lo, hi = 0, None, None
    inside = values
    while n > GATHERED:
        share = (rank - below) / n
        lo, hi = inside.agg(F.percentile_approx("v", F.array(F.lit(max(0.0, share - 3e-4)), F.lit(min(1.0, share + 3e-4))), 10_000).alias("p")).first()["p"]
        facts = inside.agg(F.count_if(F.col("v") < lo).alias("less"), F.count_if(F.col("v") == lo).alias("lo"), F.count_if((F.col("v") > lo) & (F.col("v") < hi)).alias("n")).first()
        if rank < below + facts["less"] + facts["lo"] and rank >= below + facts["less"]:
            return lo
        if rank >= below + facts["less"] + facts["lo"] + facts["n"]:
            return hi
        inside, below, n = values.where((F.col("v") > lo) & (F.col("v") < hi)), below + facts["less"] + facts["lo"], facts["n"]
    counts = inside.groupBy("v").count().orderBy("v").collect()  # at most GATHERED rows
    for r in counts:
        below += r["count"]
        if rank < below:
            return r["v"]
    raise LookupError(rank)


def percentiles(df: DataFrame, value: str, at: list[float]) -> list[float]:
    """Exact percentiles with linear interpolation.

    Each needs the values of two ranks.  A rank is bracketed by approximate percentiles, the rows below are
    counted, and what lies between is looked at again, so that no task gathers the column's distinct values.
    """
    values = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"))
    n = values.count()
    if not n:
        return [None] * len(at)
    if n <= GATHERED:
        counts = values.groupBy("v").count()
        return list(counts.agg(F.percentile("v", F.array(*map(F.lit, at)), F.col("count")).alias("p")).first()["p"])
    out, known = [], {}
    for q in at:
        place = q * (n - 1)
        for r in {math.floor(place), math.ceil(place)}:
            if r not in known:
                known[r] = at_rank(values, r, n)
        lo, hi = known[math.floor(place)], known[math.ceil(place)]
        out.append(lo + (hi - lo) * (place - math.floor(place)))
    return out


def shuffle_key(path: Column, seed: int) -> Column:
    """A seeded order that any engine can reproduce."""
    return F.md5(F.concat(F.lit(f"{seed}|"), path.cast("string")))
