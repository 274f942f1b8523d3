"""Greedy matching of predictions with ground truth, and precision, recall and H-mean."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry


def candidates(pred: DataFrame, gt: DataFrame, iou_thresh: float) -> DataFrame:
    """image_id, pred_idx, gt_idx, iou of the pairs within an image that reach the threshold.

    The join has an equality on image_id; boxes that do not overlap go before the IoU is taken.
    """
    g = gt.select("image_id", F.col("box_idx").alias("gt_idx"), F.col("x0").alias("gx0"), F.col("y0").alias("gy0"), F.col("w").alias("gw"), F.col("h").alias("gh"))
    pairs = pred.join(g, "image_id").where((F.col("px0") < F.col("gx0") + F.col("gw")) & (F.col("gx0") < F.col("px0") + F.col("pw")) & (F.col("py0") < F.col("gy0") + F.col("gh")) & (F.col("gy0") < F.col("py0") + F.col("ph")))
    iou = geometry.box_iou(*(F.col(c) for c in ("px0", "py0", "pw", "ph", "gx0", "gy0", "gw", "gh")))
    return pairs.select("image_id", "pred_idx", "gt_idx", iou.alias("iou")).where(F.col("iou") >= iou_thresh)


def greedy(cands: DataFrame) -> DataFrame:
    """image_id, matches (array of pred, gt): predictions in their own order take the free gt of the largest IoU, ties to the first.

    One fold per image over its sorted candidates, without Python.
    """
    row = F.struct("pred_idx", (-F.col("iou")).alias("minus"), "gt_idx")
    per = cands.groupBy("image_id").agg(F.array_sort(F.collect_list(row)).alias("c"))
    none = F.expr("cast(array() as array<struct<pred:int,gt:int>>)")

    def step(acc, c):
        free = ~F.exists(acc, lambda m: (m["gt"] == c["gt_idx"]) | (m["pred"] == c["pred_idx"]))
        return F.when(free, F.concat(acc, F.array(F.struct(c["pred_idx"].alias("pred"), c["gt_idx"].alias("gt"))))).otherwise(acc)

    return per.select("image_id", F.aggregate("c", none, step).alias("matches"))


def counts(pred: DataFrame, gt: DataFrame, iou_thresh: float) -> DataFrame:
    """tp, fp, fn summed over all images."""
    tp = greedy(candidates(pred, gt, iou_thresh)).agg(F.coalesce(F.sum(F.size("matches")), F.lit(0)).cast("long").alias("tp"))
    n = pred.agg(F.count("*").alias("n_pred")).join(gt.agg(F.count("*").alias("n_gt")), F.lit(True))  # one row each
    return tp.join(n, F.lit(True)).select("tp", (F.col("n_pred") - F.col("tp")).alias("fp"), (F.col("n_gt") - F.col("tp")).alias("fn"))


def hmean(counts: DataFrame) -> DataFrame:
    """tp, fp, fn, precision, recall, hmean; denominators are bounded as training logs do."""
    p = F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1))
    r = F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), F.lit(1))
    return counts.select("tp", "fp", "fn", p.alias("precision"), r.alias("recall")).withColumn("hmean", 2 * F.col("precision") * F.col("recall") / F.greatest(F.col("precision") + F.col("recall"), F.lit(1e-6)))
