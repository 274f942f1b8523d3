"""Scalar rules on confidences, losses and learning rates."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Channel means and deviations that public image backbones are trained with.
CHANNEL_MEAN = (0.485, 0.456, 0.406)
CHANNEL_STD = (0.229, 0.224, 0.225)
EPS = 1e-6


def training_score(s: Column) -> Column:
    """A missing score and a score of exactly 0 count as 1."""
    return F.when(s.isNull() | (s == 0), 1.0).otherwise(s)


def export_score(s: Column) -> Column:
    """A missing score counts as 0."""
    return F.coalesce(s, F.lit(0.0))


def reaches(s: Column, least: float) -> Column:
    """Not below the least score; NaN is kept."""
    return ~(~F.isnan(s) & (s < least))


def score_text(s: Column) -> Column:
    return F.format_string("%.2f", s)


def bce(p: Column, t: Column) -> Column:
    q = F.greatest(F.lit(EPS), F.least(F.lit(1 - EPS), p))
    return -(t * F.ln(q) + (1 - t) * F.ln(1 - q))


def diff_binarize(p: Column, threshold: Column, k: float = 50.0) -> Column:
    return 1.0 / (1.0 + F.exp(-k * (p - threshold)))


def normalize(v: Column, channel: Column) -> Column:
    """A byte value as a standardised float of its channel."""
    mean, std = F.array(*map(F.lit, CHANNEL_MEAN)), F.array(*map(F.lit, CHANNEL_STD))
    return (v / 255.0 - F.get(mean, channel)) / F.get(std, channel)


def denormalize(v: Column, channel: Column) -> Column:
    """Back to a byte, clipped and truncated."""
    mean, std = F.array(*map(F.lit, CHANNEL_MEAN)), F.array(*map(F.lit, CHANNEL_STD))
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v * F.get(std, channel) + F.get(mean, channel))) * 255.0).cast("int")


def cosine_lr(step: Column, total: int, warm: int, base: float, least: float) -> Column:
    """Linear warm-up, then half a cosine down to `least`.

    The angle is multiplied before it is divided, as formulas in SQL are read: in the other order its last bit differs.
    """
    angle = F.lit(math.pi) * (step - warm) / float(max(total - warm, 1))
    return F.when(step < warm, base * (step + 1) / float(max(warm, 1))).otherwise(least + 0.5 * (base - least) * (1 + F.cos(angle)))
