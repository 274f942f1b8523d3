"""A seeded augmentation plan: which turn and flips each image gets in each epoch, and its polygons after them.

Draws are digests of seed, epoch and path, so any engine and any rerun gets the same plan.  A quarter turn and the
flips compose to one element of the square's symmetry group, kept as (swap, flip_x, flip_y): swap the
coordinates, then mirror each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import AugmentConfig
from ..functions import geometry


def draw(seed: int, epoch: Column, path: Column, name: str) -> Column:
    """A number from 0 up to, not including, 1."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), path.cast("string"), F.lit(name)))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(1 << 32)


def plan(samples: DataFrame, cfg: AugmentConfig, size: int, epoch: Column, seed: int = 0) -> DataFrame:
    """samples (rel_path, width, height, ...) with swap, flip_x, flip_y, scale, pad_left, pad_top.

    Images are scaled to fit the square and centred.  A tier of "none" draws nothing; without a size, scale is 1.
    """
    if cfg.tier not in ("none", "standard", "handwriting"):
        raise ValueError(f"unknown tier: {cfg.tier}")
    on = lambda name, p: (draw(seed, epoch, F.col("rel_path"), name) < p) & F.lit(cfg.tier != "none")
    quarters = F.when(on("rot90", cfg.p_rot90), F.floor(draw(seed, epoch, F.col("rel_path"), "quarters") * 4)).otherwise(0)
    made = samples.withColumns({"__k": quarters, "__h": on("hflip", cfg.p_hflip), "__v": on("vflip", cfg.p_vflip), "__box": geometry.letterbox(F.col("width"), F.col("height"), size)})
    flags = {"swap": F.col("__k") % 2 == 1, "flip_x": F.col("__k").isin(2, 3) != F.col("__h"), "flip_y": F.col("__k").isin(1, 2) != F.col("__v")}
    pad = lambda side: F.floor((F.lit(size) - F.col(f"__box.{side}")) / 2).cast("int")
    return made.withColumns(flags | {"scale": F.col("__box.scale"), "pad_left": pad("new_w"), "pad_top": pad("new_h")}).drop("__k", "__h", "__v", "__box")


def moved(points: Column, size: int) -> Column:
    """A polygon of a planned sample in the square."""
    x = lambda p: p["x"] * F.col("scale") + F.col("pad_left")
    y = lambda p: p["y"] * F.col("scale") + F.col("pad_top")
    mirrored = lambda v, flag: F.when(F.col(flag), F.lit(size - 1.0) - v).otherwise(v)
    return F.transform(points, lambda p: F.struct(mirrored(F.when(F.col("swap"), y(p)).otherwise(x(p)), "flip_x").alias("x"), mirrored(F.when(F.col("swap"), x(p)).otherwise(y(p)), "flip_y").alias("y")))


def augmented(samples: DataFrame, cfg: AugmentConfig, size: int, epoch: Column, seed: int = 0) -> DataFrame:
    """Planned samples with their `polygons` (arrays of points) moved, jittered and clipped, and keep, a flag for each given one.

    A polygon goes if it has under three vertices, or if an extent is under min_side after clipping.
    """
    planned = plan(samples, cfg, size, epoch, seed)
    key = F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.col("rel_path").cast("string"))

    def one(p: Column, i: Column) -> Column:
        q = moved(p, size)
        if cfg.tier != "none" and cfg.box_jitter_px > 0:
            q = geometry.jitter(q, F.concat_ws("|", key, i.cast("string")), cfg.box_jitter_px)
        return geometry.clip_points(q, size, size)

    def good(p: Column) -> Column:
        e = geometry.extents(p)
        return F.coalesce((F.size(p) >= 3) & (F.least(e["x1"] - e["x0"], e["y1"] - e["y0"]) >= cfg.min_side), F.lit(False))

    made = planned.withColumn("__p", F.transform("polygons", one)).withColumn("keep", F.transform("__p", good))
    kept = F.transform(F.filter(F.arrays_zip(F.col("__p").alias("p"), F.col("keep").alias("k")), lambda z: z["k"]), lambda z: z["p"])
    return made.withColumn("polygons", kept).drop("__p")
