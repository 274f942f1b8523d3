"""Boxes and polygons as Spark expressions.

A polygon is an array of struct<x double, y double>; a box is (x0, y0, w, h).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEGENERATE = 1e-6


def box_points(x0: Column, y0: Column, w: Column, h: Column) -> Column:
    """The four corners, clockwise from the top left."""
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return F.array(corner(x0, y0), corner(x0 + w, y0), corner(x0 + w, y0 + h), corner(x0, y0 + h))


def pairs(flat: Column) -> Column:
    """A flat coordinate array [x0, y0, x1, y1, ...] as points; an odd last number is dropped."""
    n = F.floor(F.size(flat) / 2).cast("int")
    none = F.expr("cast(array() as array<struct<x:double,y:double>>)")
    made = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.struct(F.get(flat, 2 * i).cast("double").alias("x"), F.get(flat, 2 * i + 1).cast("double").alias("y")))
    return F.when(n > 0, made).otherwise(none)


def flat(points: Column) -> Column:
    return F.flatten(F.transform(points, lambda p: F.array(p["x"], p["y"])))


def map_points(points: Column, fx, fy) -> Column:
    """Every vertex through fx(x, y), fy(x, y)."""
    return F.transform(points, lambda p: F.struct(fx(p["x"], p["y"]).alias("x"), fy(p["x"], p["y"]).alias("y")))


def extents(points: Column) -> Column:
    """struct<x0, y0, x1, y1>; null for no points."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def _around(points: Column, term) -> Column:
    """Sum of term(vertex, next vertex) around the polygon."""
    n = F.size(points)
    turn = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.expr("cast(array() as array<int>)"))
    return F.aggregate(turn, F.lit(0.0), lambda s, i: s + term(F.get(points, i), F.get(points, (i + 1) % n)))


def area(points: Column) -> Column:
    return F.abs(_around(points, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])) / 2


def perimeter(points: Column) -> Column:
    return _around(points, lambda a, b: F.sqrt(F.pow(b["x"] - a["x"], 2) + F.pow(b["y"] - a["y"], 2)))


def offset_distance(area: Column, perimeter: Column, ratio: float) -> Column:
    """A (1 - r^2) / L; null for a degenerate outline."""
    return F.when(perimeter < DEGENERATE, None).otherwise(area * (1 - ratio * ratio) / perimeter)


def unclip_distance(area: Column, perimeter: Column, ratio: float) -> Column:
    return F.when(perimeter < DEGENERATE, None).otherwise(area * ratio / perimeter)


def clamp(v: Column, most) -> Column:
    return F.greatest(F.least(v, F.lit(float(most))), F.lit(0.0))


def clip_points(points: Column, width: int, height: int) -> Column:
    return map_points(points, lambda x, y: clamp(x, width - 1), lambda x, y: clamp(y, height - 1))


def overlap(ax, ay, aw, ah, bx, by, bw, bh) -> Column:
    x = F.least(ax + aw, bx + bw) - F.greatest(ax, bx)
    y = F.least(ay + ah, by + bh) - F.greatest(ay, by)
    return F.greatest(F.lit(0.0), x) * F.greatest(F.lit(0.0), y)


def box_iou(ax, ay, aw, ah, bx, by, bw, bh) -> Column:
    """Intersection over union of two boxes; 0 if their union is empty."""
    i = overlap(ax, ay, aw, ah, bx, by, bw, bh)
    union = aw * ah + bw * bh - i
    return F.when(union <= 0, 0.0).otherwise(i / union)


def segment_distance(x: Column, y: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance of a point from a segment, which may be a single point."""
    dx, dy = bx - ax, by - ay
    size = dx * dx + dy * dy
    t = F.when(size < 1e-12, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - ax) * dx + (y - ay) * dy) / size)))
    return F.sqrt(F.pow(x - (ax + t * dx), 2) + F.pow(y - (ay + t * dy), 2))


def edge_distance(points: Column, x: Column, y: Column) -> Column:
    """Distance of a point from the nearest edge of a polygon."""
    n = F.size(points)
    return F.array_min(F.transform(points, lambda p, i: segment_distance(x, y, p["x"], p["y"], F.get(points, (i + 1) % n)["x"], F.get(points, (i + 1) % n)["y"])))


def short_side(points: Column) -> Column:
    """Shorter side of a four-cornered polygon."""
    side = lambda a, b: F.sqrt(F.pow(F.get(points, a)["x"] - F.get(points, b)["x"], 2) + F.pow(F.get(points, a)["y"] - F.get(points, b)["y"], 2))
    return F.least(side(0, 1), side(1, 2))


def letterbox(width: Column, height: Column, size: int) -> Column:
    """struct<scale, new_w, new_h, pad_left, pad_top>: scaled to fit, padded at the right and bottom."""
    scale = F.lit(float(size)) / F.greatest(width, height)
    side = lambda v: F.greatest(F.lit(1), F.bround(v * scale, 0).cast("int"))
    return F.struct(scale.alias("scale"), side(width).alias("new_w"), side(height).alias("new_h"), F.lit(0).alias("pad_left"), F.lit(0).alias("pad_top"))


def inverse_transform(v: Column, pad: Column, scale: Column) -> Column:
    return (v - pad) / F.greatest(scale, F.lit(1e-8))


def turned(x: Column, y: Column, width: int, height: int, op: Column):
    """A point after op: 0 nothing, 1 mirrored, 2 upside down, 3 a quarter turn counter-clockwise, 4 a half turn, 5 a three-quarter turn."""
    w, h = F.lit(float(width - 1)), F.lit(float(height - 1))
    return (F.when(op.isin(1, 4), w - x).when(op == 3, y).when(op == 5, h - y).otherwise(x), F.when(op.isin(2, 4), h - y).when(op == 3, w - x).when(op == 5, x).otherwise(y))


def jitter(points: Column, key: Column, reach: float) -> Column:
    """Every vertex moved by up to `reach` in each direction, decided by key and place alone."""
    draw = lambda i, axis: (F.pmod(F.xxhash64(key, i, F.lit(axis)), F.lit(2_000_001)) / 1e6 - 1.0) * reach
    return F.transform(points, lambda p, i: F.struct((p["x"] + draw(i, "x")).alias("x"), (p["y"] + draw(i, "y")).alias("y")))


def palette(i: Column, n: Column) -> Column:
    """struct<r, g, b> of the i-th of n hues at full saturation and value."""
    h = F.when(n <= 1, F.lit(0.0)).otherwise(i / n) * 6.0
    sector = F.floor(h).cast("int") % 6
    f = h - F.floor(h)
    up, down = F.floor(f * 255).cast("int"), F.floor((1 - f) * 255).cast("int")
    on, off = F.lit(255), F.lit(0)
    table = {0: (on, up, off), 1: (down, on, off), 2: (off, on, up), 3: (off, down, on), 4: (up, off, on), 5: (on, off, down)}
    pick = lambda k: F.coalesce(*(F.when(sector == s, v[k]) for s, v in table.items()))
    return F.struct(pick(0).alias("r"), pick(1).alias("g"), pick(2).alias("b"))
