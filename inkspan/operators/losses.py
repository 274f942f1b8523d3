"""Masked losses over pixel tables, with hard-negative mining.

Pixels: group columns, p (prediction), t (target, 0 or 1), m (mask, 0 or 1) and w (weight).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.order import at_rank
from ..functions.scores import EPS, bce


def dice(px: DataFrame, by: list[str]) -> DataFrame:
    """1 - (2 * sum(p t w m) + eps) / (sum(p w m) + sum(t w m) + eps)."""
    w = F.col("w") * F.col("m")
    return px.groupBy(*by).agg((1 - (2 * F.sum(F.col("p") * F.col("t") * w) + EPS) / (F.sum(F.col("p") * w) + F.sum(F.col("t") * w) + EPS)).alias("dice"))


def masked_l1(px: DataFrame, by: list[str], prediction: str = "p", target: str = "t") -> DataFrame:
    """Mean absolute error under the mask; the denominator is at least 1."""
    return px.groupBy(*by).agg((F.sum(F.abs(F.col(prediction) - F.col(target)) * F.col("m")) / F.greatest(F.sum("m"), F.lit(1.0))).alias("l1"))


def _positive() -> Column:
    return (F.col("t") > 0.5) & (F.col("m") > 0.5)


def _negative() -> Column:
    return (F.col("t") <= 0.5) & (F.col("m") > 0.5)


def ohem_bce(px: DataFrame, by: list[str], ratio: float) -> DataFrame:
    """Positive losses and the largest negative ones, int(max(#positive, 1) * ratio) at most, averaged.

    Groups are images or batches of bounded size; a group's negatives are ranked in one task.
    """
    loss = px.select(*by, "x", "y", (bce(F.col("p"), F.col("t")) * F.col("w")).alias("loss"), _positive().alias("pos"), _negative().alias("neg"))
    group = Window.partitionBy(*by)
    rank = F.row_number().over(group.orderBy(F.desc(F.when(F.col("neg"), F.col("loss"))), "y", "x"))
    k = F.least(F.count_if("neg").over(group), F.floor(F.greatest(F.count_if("pos").over(group), F.lit(1)) * ratio).cast("long"))
    ranked = loss.select("*", rank.alias("rank"), k.alias("k"))
    taken = F.col("pos") | (F.col("neg") & (F.col("rank") <= F.col("k")))
    return ranked.groupBy(*by).agg((F.coalesce(F.sum(F.when(taken, F.col("loss"))), F.lit(0.0)) / F.greatest(F.count_if("pos") + F.max("k"), F.lit(1))).alias("bce"))


def ohem_by_threshold(px: DataFrame, ratio: float) -> tuple[float, int]:
    """(sum of the mined negatives' losses, their number) over a whole table that no task could rank."""
    r = _mined(px, ratio)
    return r["above"] + (r["k"] - r["n_above"]) * r["least"], r["k"]


def ohem_batch(px: DataFrame, ratio: float) -> DataFrame:
    """n_pos, k, bce: hard-negative mining over a whole batch, however large.

    The loss of rank k is found exactly by passes that bracket and count it; losses above it are summed, and it
    stands for the rest.
    """
    r = _mined(px, ratio)
    mined = r["above"] + (r["k"] - r["n_above"]) * r["least"]
    row = (r["pos"], r["k"], (r["pos_loss"] + mined) / max(r["pos"] + r["k"], 1))
    return px.sparkSession.createDataFrame([row], "n_pos long, k long, bce double")


def _mined(px: DataFrame, ratio: float) -> dict:
    loss = px.select((bce(F.col("p"), F.col("t")) * F.col("w")).alias("v"), _positive().alias("pos"), _negative().alias("neg"))
    pos_loss = F.coalesce(F.sum(F.when(F.col("pos"), F.col("v"))), F.lit(0.0))
    facts = loss.agg(F.count_if("pos").alias("pos"), F.count_if("neg").alias("neg"), pos_loss.alias("pos_loss")).first().asDict()
    k = min(facts["neg"], int(max(facts["pos"], 1) * ratio))
    if not k:
        return facts | {"k": 0, "least": 0.0, "above": 0.0, "n_above": 0}
    negatives = loss.where("neg").select("v")
    least = at_rank(negatives, facts["neg"] - k, facts["neg"])
    above = negatives.where(F.col("v") > least).agg(F.coalesce(F.sum("v"), F.lit(0.0)).alias("above"), F.count("*").alias("n_above")).first().asDict()
    return facts | above | {"k": k, "least": least}


def total(parts: DataFrame, alpha: float, beta: float, w_bce: float, w_dice: float) -> Column:
    """alpha * (w_bce * bce + w_dice * dice) + beta * l1 + binary dice."""
    return alpha * (w_bce * F.col("bce") + w_dice * F.col("dice")) + beta * F.col("l1") + F.coalesce("binary_dice", F.lit(0.0))
