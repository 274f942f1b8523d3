"""Running statistics over training steps, also where one key holds most of them.

Rows are cut into blocks that are contiguous in (key, order) and hold about PER_BLOCK rows, whatever the
keys are.  Blocks are scanned by themselves and reduced to one row each; what comes before a block
is scanned over these rows, and joined back.  So a task holds a block, or a row per block of a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import graph

PER_BLOCK = 200_000


def blocked(df: DataFrame, key: list[str], order: list[str], per_block: int | None = None) -> tuple[DataFrame, int]:
    """df with __block, which rises with (key, order), and how many blocks there are.

    Where there are several, the table is written once, so that all that follows sees the same blocks.
    """
    blocks = -(-df.count() // (per_block or PER_BLOCK))
    if blocks <= 1:
        return df.withColumn("__block", F.lit(0)), 1
    return graph.cut(df.repartitionByRange(blocks, *key, *order).withColumn("__block", F.spark_partition_id())), blocks


def scan(df: DataFrame, key: list[str], order: list[str], sums: dict[str, Column], before: dict[str, Column] | None = None, per_block: int | None = None) -> DataFrame:
    """All columns, prefix sums up to each row, and for `before` the largest value of the rows strictly before it.

    order has to be a total one within each key.
    """
    before = before or {}
    rows, blocks = blocked(df.withColumns({f"__{c}": v for c, v in (sums | before).items()}), key, order, per_block)
    own = Window.partitionBy(*key, "__block").orderBy(*order)
    up, prior = own.rowsBetween(Window.unboundedPreceding, Window.currentRow), own.rowsBetween(Window.unboundedPreceding, -1)
    local = rows.select("*", *(F.sum(f"__{c}").over(up).alias(c) for c in sums), *(F.max(f"__{c}").over(prior).alias(c) for c in before))
    hidden = [f"__{c}" for c in (*sums, *before)]
    if blocks == 1:
        return local.drop("__block", *hidden)
    total = rows.groupBy(*key, "__block").agg(*(F.sum(f"__{c}").alias(c) for c in sums), *(F.max(f"__{c}").alias(c) for c in before))
    earlier = Window.partitionBy(*key).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    shift = total.select(F.struct(F.lit(0).alias("one"), *key).alias("__key"), "__block", *(F.sum(c).over(earlier).alias(f"__s{c}") for c in sums), *(F.max(c).over(earlier).alias(f"__s{c}") for c in before))
    joined = local.withColumn("__key", F.struct(F.lit(0).alias("one"), *key)).join(shift, ["__key", "__block"])
    made = {c: F.coalesce(F.col(c) + F.col(f"__s{c}"), F.col(c), F.col(f"__s{c}")) for c in sums} | {c: F.greatest(c, f"__s{c}") for c in before}
    return joined.withColumns(made).drop("__key", "__block", *hidden, *(f"__s{c}" for c in made))


def ema(df: DataFrame, key: str, order: list[str], value: str, decay: float, seed: Column | None = None, per_block: int | None = None) -> DataFrame:
    """key, ema: v <- decay * v + (1 - decay) * x in order; starts from seed or else the first value.

    A run of steps is one map v -> a * v + b, so each block of a key is reduced to (a, b), and these are folded.
    """
    rows, _ = blocked(df.select(key, *order, F.col(value).cast("double").alias("__v")), [key], order, per_block)
    steps = rows.groupBy(key, "__block").agg(F.array_sort(F.collect_list(F.struct(*order, "__v"))).alias("s"))
    b = F.aggregate("s", F.lit(0.0), lambda a, x: decay * a + (1 - decay) * x["__v"])
    maps = steps.select(key, F.struct("__block", F.pow(F.lit(decay), F.size("s")).alias("a"), b.alias("b"), F.get("s", F.lit(0))["__v"].alias("first")).alias("m"))
    folded = maps.groupBy(key).agg(F.array_sort(F.collect_list("m")).alias("m"))
    start = F.get("m", F.lit(0))["first"] if seed is None else seed
    return folded.select(key, F.aggregate("m", start, lambda v, x: x["a"] * v + x["b"]).alias("ema"))


def running_mean(df: DataFrame, epoch: str, order: list, value: str, every: int, step: str, per_block: int | None = None) -> DataFrame:
    """All columns and `running`, the mean since the epoch began, at every n-th step."""
    rows = scan(df, [epoch], order, {"__total": F.col(value), "__seen": F.col(value).isNotNull().cast("long")}, per_block=per_block)
    return rows.withColumn("running", F.when(F.col("__seen") > 0, F.col("__total") / F.col("__seen"))).where(F.col(step) % every == 0).drop("__total", "__seen")


def epoch_means(df: DataFrame, epoch: str, values: list[str]) -> DataFrame:
    return df.groupBy(epoch).agg(F.count("*").alias("steps"), *(F.avg(v).alias(v) for v in values))


def best_so_far(df: DataFrame, run: list[str], order: list, value: str, per_block: int | None = None) -> DataFrame:
    """The rows that strictly exceed everything before them in their run, from 0.0 on."""
    rows = scan(df, run, order, {}, {"__best": F.col(value)}, per_block)
    return rows.where(F.col(value) > F.coalesce("__best", F.lit(0.0))).drop("__best")


def gated(df: DataFrame, epoch: str, every: int) -> DataFrame:
    """The epochs at which something due every n epochs happens."""
    return df.where((F.col(epoch) + 1) % every == 0)
