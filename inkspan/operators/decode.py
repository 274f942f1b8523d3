"""From probability maps to boxes: components, their statistics, and fitted rectangles.

components() labels whole images in one task each; components_tiled() labels squares of an image
and joins labels across their borders, so an image may be larger than a task.  What is kept of
a component is bounded by its lines, never its pixels.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry, graph


@dataclass(frozen=True)
class DecodeConfig:
    thresh: float = 0.3
    box_thresh: float = 0.5
    unclip_ratio: float = 1.8
    min_size: float = 3.0
    max_candidates: int = 1000


#: Pixels that are labelled together, in whole images.
PER_PACK = 200_000


def binarized(px: DataFrame, thresh: float) -> DataFrame:
    return px.where(F.col("p") > thresh)


def _label(pdf: pd.DataFrame) -> pd.DataFrame:
    """Union-find over right and lower neighbours; a component is named after its first pixel in raster order."""
    y, x = pdf["y"].to_numpy(np.int64), pdf["x"].to_numpy(np.int64)
    # several images lie one below the other, with an empty line between them
    image = pd.factorize(pdf["image_id"])[0].astype(np.int64)
    stride, lines = int(x.max()) + 2, int(y.max()) + 2
    key = (image * lines + y) * stride + x
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    parent = np.arange(len(key))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for step in (1, stride):
        at = np.searchsorted(sorted_key, sorted_key + step)
        hit = np.nonzero((at < len(key)) & (sorted_key[np.minimum(at, len(key) - 1)] == sorted_key + step))[0]
        for a, b in zip(hit.tolist(), at[hit].tolist(), strict=True):
            ra, rb = find(a), find(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
    first = order[[find(i) for i in range(len(key))]]
    out = pdf.iloc[order].copy()
    out["first_y"], out["first_x"] = y[first], x[first]
    return out


def components(mask: DataFrame) -> DataFrame:
    """image_id, y, x, p and first_y, first_x: the 4-neighbour component's first pixel in raster order."""
    rows = mask.select(F.col("image_id").cast("long"), F.col("y").cast("int"), F.col("x").cast("int"), F.col("p").cast("double"))
    packs = max(1, rows.count() // PER_PACK)
    dealt = rows.withColumn("pack", F.pmod(F.xxhash64("image_id"), F.lit(packs)))
    return dealt.groupBy("pack").applyInPandas(lambda pdf: _label(pdf.drop(columns="pack")), "image_id long, y int, x int, p double, first_y int, first_x int")


def components_tiled(mask: DataFrame, tile: int = 512) -> DataFrame:
    """As components(), for images of any size: squares of `tile` pixels are labelled by themselves, then joined.

    A label is an image's first pixel in raster order.  Links join the labels of two pixels that meet across
    a border; the components of the links give each label its root.
    """
    rows = mask.select(F.col("image_id").cast("long"), F.col("y").cast("int"), F.col("x").cast("int"), F.col("p").cast("double"))
    square = F.struct("image_id", F.floor(F.col("y") / tile).alias("r"), F.floor(F.col("x") / tile).alias("c"))
    packs = max(1, rows.count() // PER_PACK)
    dealt = rows.withColumn("square", F.xxhash64(square)).withColumn("pack", F.pmod("square", F.lit(packs)))
    schema = "image_id long, y int, x int, p double, first_y int, first_x int"

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        # squares are told apart by image and place; within one, neighbours are neighbours of the image
        own = pdf.assign(square=pd.factorize(pdf["image_id"].astype(str) + "," + (pdf["y"] // tile).astype(str) + "," + (pdf["x"] // tile).astype(str))[0])
        made = _label(pd.DataFrame({"image_id": own["square"], "y": own["y"] % tile, "x": own["x"] % tile, "at": np.arange(len(own))}))
        at = made["at"].to_numpy()
        out = pdf.iloc[at].drop(columns=["pack", "square"])
        out["first_y"] = (out["y"].to_numpy() // tile * tile + made["first_y"].to_numpy()).astype(np.int32)
        out["first_x"] = (out["x"].to_numpy() // tile * tile + made["first_x"].to_numpy()).astype(np.int32)
        return out

    labelled = graph.cut(dealt.groupBy("pack").applyInPandas(label, schema))
    node = F.struct("image_id", "first_y", "first_x")
    right = labelled.where((F.col("x") + 1) % tile == 0).select("image_id", "y", (F.col("x") + 1).alias("x"), node.alias("a"))
    below = labelled.where((F.col("y") + 1) % tile == 0).select("image_id", (F.col("y") + 1).alias("y"), "x", node.alias("a"))
    left, top = labelled.where(F.col("x") % tile == 0), labelled.where(F.col("y") % tile == 0)
    links = right.join(left.select("image_id", "y", "x", node.alias("b")), ["image_id", "y", "x"]).unionByName(below.join(top.select("image_id", "y", "x", node.alias("b")), ["image_id", "y", "x"]))
    roots = graph.components(links.select("a", "b").distinct()).select("id.*", F.col("root.first_y").alias("root_y"), F.col("root.first_x").alias("root_x"))
    joined = labelled.join(roots, ["image_id", "first_y", "first_x"], "left")
    return joined.select("image_id", "y", "x", "p", F.coalesce("root_y", "first_y").alias("first_y"), F.coalesce("root_x", "first_x").alias("first_x"))


def component_stats(labelled: DataFrame) -> DataFrame:
    """image_id, first_y, first_x, area, mean_p, lines (y and the extremes of x): what a hull needs, a row per line."""
    by = ["image_id", "first_y", "first_x"]
    lines = labelled.groupBy(*by, "y").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.count("*").alias("n"), F.sum("p").alias("s"))
    return lines.groupBy(*by).agg(F.sum("n").alias("area"), (F.sum("s") / F.sum("n")).alias("mean_p"), F.sort_array(F.collect_list(F.struct("y", "x0", "x1"))).alias("lines"))


def convex_hull(points: np.ndarray) -> np.ndarray:
    """Counter-clockwise hull without collinear points."""
    pts = np.unique(points, axis=0)
    if len(pts) < 3:
        return pts

    def half(rows):
        out: list = []
        for p in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out

    rows = pts.tolist()
    return np.array(half(rows)[:-1] + half(rows[::-1])[:-1])


def fitted_rect(hull: np.ndarray) -> tuple[int, int, int, int, int, int] | None:
    """Of a hull of integer points the smallest rectangle: a direction (dx, dy) with dx > 0 and dy >= 0, and the extents along and across it, in its lengths.

    Of equally small ones that of the least angle; None if the points lie on a line.  Calipers: the point of the hull
    farthest in a direction is where the angles of the edges pass it, so each edge takes a few binary searches.
    """
    if len(hull) < 3:
        return None
    edges = np.roll(hull, -1, axis=0) - hull
    turn = np.arctan2(edges[:, 1], edges[:, 0])
    turn = np.mod(turn - turn[0], 2 * np.pi)
    turn[turn > 2 * np.pi - 1e-12] = 0.0

    def extent(quarter: int, unit: np.ndarray) -> np.ndarray:
        """Largest product of a hull point with the edges' directions turned by so many quarters; neighbours of the place found guard against rounding."""
        at = np.searchsorted(turn, np.mod(turn + (quarter + 1) * np.pi / 2, 2 * np.pi))
        return np.max([(hull[(at + k) % len(hull)] * unit).sum(1) for k in (-1, 0, 1)], axis=0)

    across = np.stack([-edges[:, 1], edges[:, 0]], 1)
    size = (extent(0, edges) + extent(2, -edges)) * (extent(1, across) - (hull * across).sum(1)) / (edges**2).sum(1)
    least = size.min()
    best = None
    for dx, dy in edges[size <= least * (1 + 1e-9)].tolist():
        while not (dx > 0 and dy >= 0):
            dx, dy = dy, -dx
        g = math.gcd(int(dx), int(dy))
        dx, dy = int(dx) // g, int(dy) // g
        if best is None or dy * best[0] < best[1] * dx:
            best = (dx, dy)
    dx, dy = best
    along, over = hull[:, 0] * dx + hull[:, 1] * dy, hull[:, 1] * dx - hull[:, 0] * dy
    return dx, dy, int(along.min()), int(along.max()), int(over.min()), int(over.max())


def min_area_rect(points: np.ndarray) -> np.ndarray | None:
    """Corners of the smallest rectangle around integer points; None if they lie on a line."""
    found = fitted_rect(convex_hull(np.asarray(points).astype(np.int64)))
    return None if found is None else _corners(found, 0.0)


def _corners(rect: tuple, grown: float) -> np.ndarray:
    dx, dy, a0, a1, b0, b1 = rect
    length = math.sqrt(dx * dx + dy * dy)
    a0, a1, b0, b1 = a0 / length - grown, a1 / length + grown, b0 / length - grown, b1 / length + grown
    return np.array([((a * dx - b * dy) / length, (a * dy + b * dx) / length) for a, b in ((a0, b0), (a1, b0), (a1, b1), (a0, b1))])


def box_of(lines: np.ndarray, cfg: DecodeConfig) -> np.ndarray | None:
    """The grown rectangle around a component given as rows of y, x0, x1; None if it is too small before or after."""
    points = np.concatenate([lines[:, [1, 0]], lines[:, [2, 0]]])
    rect = fitted_rect(convex_hull(points))
    if rect is None:
        return None
    dx, dy, a0, a1, b0, b1 = rect
    length = math.sqrt(dx * dx + dy * dy)
    w, h = (a1 - a0) / length, (b1 - b0) / length
    # offsetting a rectangle with round corners and fitting again grows it by the distance on every side
    d = w * h * cfg.unclip_ratio / (2 * (w + h))
    if min(w, h) < cfg.min_size or min(w, h) + 2 * d < cfg.min_size + 2:
        return None
    return _corners(rect, d)


def grown_rect(rect: np.ndarray, ratio: float) -> np.ndarray:
    """A rectangle grown by area * ratio / perimeter on every side: what offsetting and fitting again give."""
    u, v = rect[1] - rect[0], rect[3] - rect[0]
    w, h = np.linalg.norm(u), np.linalg.norm(v)
    d = w * h * ratio / (2 * (w + h))
    u, v = u / w * d, v / h * d
    return rect + np.array([-u - v, u - v, u + v, -u + v])


def convex_clip(subject: np.ndarray, clip: np.ndarray) -> np.ndarray:
    """Part of a polygon inside a convex counter-clockwise one, half-plane by half-plane."""
    out = [tuple(p) for p in subject]
    for a, b in zip(clip, np.roll(clip, -1, axis=0), strict=True):
        inside = lambda p: (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0]) >= 0  # noqa: B023, E731
        rows, out = out, []
        for p, q in zip(rows, rows[1:] + rows[:1], strict=True):
            ip, iq = inside(p), inside(q)
            if ip:
                out.append(p)
            if ip != iq:
                den = (p[0] - q[0]) * (a[1] - b[1]) - (p[1] - q[1]) * (a[0] - b[0])
                t = ((p[0] - a[0]) * (a[1] - b[1]) - (p[1] - a[1]) * (a[0] - b[0])) / den
                out.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
        if not out:
            break
    return np.array(out)


def polygon_area(p: np.ndarray) -> float:
    if len(p) < 3:
        return 0.0
    x, y = p[:, 0], p[:, 1]
    return float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum() / 2)


def convex_iou(a: np.ndarray, b: np.ndarray) -> float:
    """Intersection over union of convex polygons; 0 for degenerate ones."""
    a, b = (p if polygon_area(p) >= 0 else p[::-1] for p in (np.asarray(a, float), np.asarray(b, float)))
    sa, sb = polygon_area(a), polygon_area(b)
    if sa <= 0 or sb <= 0:
        return 0.0
    i = abs(polygon_area(convex_clip(a, b)))
    return i / (sa + sb - i)


def inward_offset(polygon: np.ndarray, d: float) -> np.ndarray | None:
    """A convex polygon with every edge moved inwards by d; None if nothing is left."""
    p = np.asarray(polygon, float)
    p = p if polygon_area(p) >= 0 else p[::-1]
    out = p
    for a, b in zip(p, np.roll(p, -1, axis=0), strict=True):
        n = np.array([-(b - a)[1], (b - a)[0]]) / max(np.linalg.norm(b - a), 1e-12)
        a2, far = a + n * d, 1e6
        u = (b - a) / max(np.linalg.norm(b - a), 1e-12)
        out = convex_clip(out, np.array([a2 - u * far, a2 + u * far, a2 + u * far + n * 2 * far, a2 - u * far + n * 2 * far]))
        if len(out) < 3:
            return None
    return out


def decode(px: DataFrame, cfg: DecodeConfig, width: float | None = None, height: float | None = None, scale: float = 1.0, pad: tuple[float, float] = (0.0, 0.0), tile: int | None = None) -> DataFrame:
    """image_id, rank, points, score: boxes in order of their components, in original coordinates, clipped to a size if one is given.

    Cheap tests (area, mean) are plain filters before any rectangle is fitted.  With `tile`, images may be larger than a task.
    """
    mask = binarized(px, cfg.thresh)
    stats = component_stats(components(mask) if tile is None else components_tiled(mask, tile)).where((F.col("area") >= cfg.min_size**2) & (F.col("mean_p") >= cfg.box_thresh))

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            lines = b.column("lines")
            flat, offsets = lines.flatten(), lines.offsets.to_numpy()
            rows = np.stack([flat.field(c).to_numpy(zero_copy_only=False) for c in ("y", "x0", "x1")], 1).astype(np.int64)
            made = [box_of(rows[i:j], cfg) for i, j in zip(offsets[:-1] - offsets[0], offsets[1:] - offsets[0], strict=True)]
            points = pa.array([None if r is None else [{"x": x, "y": y} for x, y in r.tolist()] for r in made], pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], points], names=["image_id", "first_y", "first_x", "score", "points"])

    boxes = stats.select("image_id", "first_y", "first_x", F.col("mean_p").alias("score"), "lines").mapInArrow(run, "image_id long, first_y int, first_x int, score double, points array<struct<x:double,y:double>>").where(F.col("points").isNotNull())
    place = lambda v, i, most: geometry.inverse_transform(v, F.lit(pad[i]), F.lit(scale)) if most is None else geometry.clamp(geometry.inverse_transform(v, F.lit(pad[i]), F.lit(scale)), most - 1)
    back = geometry.map_points(F.col("points"), lambda x, y: place(x, 0, width), lambda x, y: place(y, 1, height))
    rank = F.row_number().over(Window.partitionBy("image_id").orderBy("first_y", "first_x"))
    return boxes.withColumn("rank", rank).where(F.col("rank") <= cfg.max_candidates).select("image_id", "rank", back.alias("points"), "score")
