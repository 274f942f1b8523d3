"""Shapes drawn in numpy inside tasks, as pixels of an image's maps or as the sums of these maps.

Shapes are rows with the bounds of their pixels, __x0 to __x1 and __y0 to __y1, both ends included and inside the
image.  dealt() brings the shapes of an image, or of a band of its lines, to one task, in order, and maps() streams over
them: shapes that meet no other are summed as they are drawn, the others' pixels are merged by sorting.  An
image that has more shapes than are drawn at once is carried along as its merged pixels, so a task never holds more
than CHUNK pixels and those of one band, and no pixel is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pixels of a band of lines, of what is drawn before pixels are merged, and of shapes of like size drawn together, about.
TILE, CHUNK, BLOCK = 1 << 19, 1 << 21, 1 << 15
BOUNDS = ("__x0", "__x1", "__y0", "__y1")
#: No columns besides the pixels' places.
PLACES = ""
SUMS = "pixels long, prob long, cleared long, ring long, total double"


class Drawn(NamedTuple):
    """Shapes on their own grids (shape, line, column): pixels they cover and, each if it is used, what they set there."""

    hit: np.ndarray
    prob: np.ndarray | None = None
    #: per shape: False if it clears the mask
    keep: np.ndarray | None = None
    #: a value that is not negative; negative where there is none
    value: np.ndarray | None = None
    #: per shape: the value of the last one counts, not the largest
    order: np.ndarray | None = None


def bands(shapes: DataFrame, width: int, height: int, pixels: int) -> DataFrame:
    """Shapes cut by bands of lines that hold so many pixels of the image: __band, and bounds inside it."""
    lines = max(1, pixels // width)
    if lines >= height:
        return shapes.withColumn("__band", F.lit(0))
    cut = shapes.withColumn("__band", F.explode(F.sequence(F.floor(F.col("__y0") / lines).cast("int"), F.floor(F.col("__y1") / lines).cast("int"))))
    first = F.col("__band") * lines
    return cut.withColumns({"__y0": F.greatest("__y0", first).cast("int"), "__y1": F.least(F.col("__y1"), first + lines - 1).cast("int")})


def dealt(shapes: DataFrame, width: int, height: int) -> DataFrame:
    """The shapes of an image's band in one task, next to each other."""
    return bands(shapes, width, height, TILE).repartition("image_id", "__band").sortWithinPartitions("image_id", "__band")


def blocks(bounds: tuple[np.ndarray, ...], kind: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Shapes of like size (and kind) together: which, their x (shape, column), y (shape, line), and the grid's pixels that are theirs."""
    x0, x1, y0, y1 = bounds
    w, h = x1 - x0 + 1, y1 - y0 + 1
    size = [-(-h // 4), -(-w // 8), *([kind] if kind is not None else [])]
    order = np.lexsort(size)
    changes = np.zeros(len(order), bool)
    for c in size:
        changes[1:] |= np.diff(c[order]) != 0
    part = np.cumsum(w[order] * h[order]) // BLOCK
    changes[1:] |= np.diff(part) != 0
    for own in np.split(order, np.flatnonzero(changes)):
        if len(own):
            across, down = np.arange(int(w[own].max())), np.arange(int(h[own].max()))
            theirs = (down < h[own, None])[:, :, None] & (across < w[own, None])[:, None, :]
            yield own, (x0[own, None] + across).astype(float), (y0[own, None] + down).astype(float), theirs


def at(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where a (shape, line, column) mask is set: flat, and the three places."""
    flat = np.flatnonzero(hit)
    line = flat // hit.shape[2]
    shape = line // hit.shape[1]
    return flat, shape, line - shape * hit.shape[1], flat - line * hit.shape[2]


def _alone(group: np.ndarray, bounds: tuple[np.ndarray, ...]) -> np.ndarray:
    """Whether no other shape of the group can share a pixel: groups are parted where no line, then where no column is shared."""
    cluster = group
    for lo, hi in (bounds[2:], bounds[:2]):
        span = int(hi.max(initial=0)) + 1
        order = np.lexsort((lo, cluster))
        reach = np.maximum.accumulate(hi[order] + cluster[order] * span)
        new = np.ones(len(order), bool)
        new[1:] = lo[order][1:] + cluster[order][1:] * span > reach[:-1]
        cluster = np.empty(len(order), np.int64)
        cluster[order] = np.cumsum(new) - 1
    return np.bincount(cluster)[cluster] == 1


def _merged(px: dict[str, np.ndarray], joined: bool) -> dict[str, np.ndarray]:
    """Pixels of equal place as one; all of them in order of group and place."""
    order = np.lexsort((px["order"], px["place"], px["group"])) if joined and "order" in px else np.lexsort((px["place"], px["group"]))
    px = {c: v[order] for c, v in px.items()}
    if not joined or not len(order):
        return px
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(px["place"]) != 0) | (np.diff(px["group"]) != 0)
    first = np.flatnonzero(new)
    if "order" in px:
        last = np.append(first[1:], len(order)) - 1
        return {c: v[last] for c, v in px.items()}
    fold = {"prob": np.maximum, "keep": np.minimum, "value": np.maximum}
    return {c: fold[c].reduceat(v, first) if c in fold else v[first] for c, v in px.items()}


def maps(shapes: DataFrame, prepare: Callable, draw: Callable, width: int, by: list[str], joined: bool, scale: tuple[float, float] = (1.0, 0.0), pixels: str | None = None) -> DataFrame:
    """`by` and SUMS, a row for each run of shapes that are equal in `by`; or, with `pixels`, by, y, x and the columns it names.

    prepare makes arrays by name of a batch (one row a shape); draw(arrays, x, y) draws shapes of like size, see Drawn.
    If joined, pixels of equal place count once: they have the largest prob and value and the smallest keep, or the value
    of the last in order.  total is the sum of value * scale[0] + scale[1].
    """
    kinds = ", ".join(f"{c} {shapes.schema[c].dataType.simpleString()}" for c in by)
    places = pixels is not None
    schema = f"{kinds}, {SUMS}" if not places else f"{kinds}, y int, x int, {pixels}".removesuffix(", ")
    names = [p.split()[0] for p in schema.split(", ")]
    wanted = names[len(by) + 2 :]

    def summed(px: dict[str, np.ndarray], groups: int) -> np.ndarray:
        g = px["group"]
        count = lambda flag: np.bincount(g[flag], minlength=groups)
        none, ring = np.zeros(groups), ~(px["value"] < 0) if "value" in px else np.zeros(len(g), bool)
        total = np.bincount(g[ring], px["value"][ring] * scale[0] + scale[1], groups) if "value" in px else none
        return np.stack([np.bincount(g, minlength=groups), count(px["prob"] > 0) if "prob" in px else none, count(px["keep"] == 0) if "keep" in px else none, count(ring), total]).astype(float)  # an empty weighted count is one of integers

    def given(rows: list[pa.Array], px: dict[str, np.ndarray], groups: int) -> pa.RecordBatch:
        """What leaves the task, of groups whose keys are the rows."""
        if places:
            key = pa.array(px["group"])
            y = px["place"] // width
            return pa.RecordBatch.from_arrays([*(r.take(key) for r in rows), pa.array(y.astype(np.int32)), pa.array((px["place"] - y * width).astype(np.int32)), *(pa.array(px[c]) for c in wanted)], names=names)
        made = summed(px, groups)
        return result(rows, made)

    def result(rows: list[pa.Array], made: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*rows, *(pa.array(made[i].astype(np.int64)) for i in range(4)), pa.array(made[4])], names=names)

    def picked(d: Drawn, group: np.ndarray, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        flat, shape, line, column = at(d.hit)
        px = {"group": group[shape], "place": (y[shape, line] * width + x[shape, column]).astype(np.int64)}
        px |= {c: v.reshape(-1)[flat] for c, v in (("prob", d.prob), ("value", d.value)) if v is not None}
        px |= {c: v[shape] for c, v in (("keep", d.keep), ("order", d.order)) if v is not None}
        return {c: v.astype(np.int32) if c in ("prob", "keep") else v for c, v in px.items()}

    def drawn(c: dict[str, np.ndarray], bounds: tuple[np.ndarray, ...], group: np.ndarray, whole: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Pixels that have to be looked at once more, and sums by group of all others."""
        groups = int(group[-1]) + 1
        alone = np.zeros(len(group), bool) if places else np.ones(len(group), bool) if not joined else _alone(group, bounds) & whole
        made, left = np.zeros((5, groups)), []
        for own, x, y, theirs in blocks(bounds, c.get("kind")):
            d = draw({n: v[own] for n, v in c.items()}, x, y)
            d = d._replace(hit=d.hit & theirs)
            here = alone[own]
            if not here.all():
                more = ~here
                left.append(picked(Drawn(*(None if v is None else v[more] for v in d)), group[own][more], x[more], y[more]))
            if here.any():
                n = len(own)
                sums = np.zeros((5, n))
                sums[0] = np.count_nonzero(d.hit.reshape(n, -1), axis=1)
                if d.prob is not None:
                    sums[1] = np.count_nonzero((d.prob & d.hit).reshape(n, -1), axis=1)
                if d.keep is not None:
                    sums[2] = np.where(d.keep, 0, sums[0])
                if d.value is not None:
                    ring = d.hit & ~(d.value < 0)
                    sums[3] = np.count_nonzero(ring.reshape(n, -1), axis=1)
                    sums[4] = np.where(ring, d.value, 0.0).reshape(n, -1).sum(1) * scale[0] + sums[3] * scale[1]
                for i in range(5):
                    made[i] += np.bincount(group[own][here], sums[i][here], groups)
        if not left:
            return {}, made
        return {n: np.concatenate([p[n] for p in left]) for n in left[0]}, made

    def run(batches: Iterator[pa.RecordBatch]):
        held, key = {}, None  # pixels and key of the run that may go on
        for b in batches:
            if not b.num_rows:
                continue
            rows = [b.column(c) for c in by]
            new = np.ones(b.num_rows, bool)
            codes = [np.asarray(r.dictionary_encode("encode").indices) for r in rows]
            new[1:] = np.any([np.diff(k) != 0 for k in codes], axis=0)
            c = prepare(b)
            bounds = tuple(np.asarray(b.column(n)).astype(np.int64) for n in BOUNDS)
            area = np.cumsum((bounds[1] - bounds[0] + 1) * (bounds[3] - bounds[2] + 1))
            cuts = [0, *(np.flatnonzero(np.diff(area // CHUNK)) + 1), b.num_rows]
            for i, j in zip(cuts, cuts[1:], strict=False):
                goes_on = key is not None and (not new[i] if i else all(k[0].as_py() == r[0].as_py() for k, r in zip(key, rows, strict=True)))
                if key is not None and not goes_on and joined:
                    yield given(key, held, 1)
                start = new[i:j].copy()
                start[0] = True
                group = np.cumsum(start) - 1
                last = int(group[-1])
                first = pa.array(i + np.flatnonzero(start))
                keys = [r.take(first) for r in rows]
                whole = (group != last) & ((group > 0) | (not goes_on))
                px, made = drawn({n: v[i:j] for n, v in c.items()}, tuple(v[i:j] for v in bounds), group, whole)
                if not joined:
                    yield given(keys, _merged(px, False), last + 1) if places else result(keys, made)
                    key = keys
                    continue
                if goes_on:
                    px = {n: np.concatenate([held[n], v]) for n, v in px.items()}
                px = _merged(px, True)
                done = np.searchsorted(px["group"], last)
                closed, held = ({n: v[part] for n, v in px.items()} for part in (slice(0, done), slice(done, None)))
                held["group"] = np.zeros_like(held["group"])
                key = [k.slice(last, 1) for k in keys]
                if last:
                    before = [k.slice(0, last) for k in keys]
                    yield given(before, closed, last) if places else result(before, made[:, :last] + summed(closed, last))
        if key is not None and joined:
            yield given(key, held, 1)

    out = shapes.mapInArrow(run, schema)
    return out if places else out.where("pixels > 0")


def image_maps(shapes: DataFrame, prepare: Callable, draw: Callable, width: int, height: int, scale: tuple[float, float] = (1.0, 0.0), pixels: str | None = None) -> DataFrame:
    """image_id and SUMS of each image's map; or, with `pixels`, its pixels: image_id, y, x and the columns named."""
    made = maps(dealt(shapes, width, height), prepare, draw, width, ["image_id", "__band"], True, scale, pixels).drop("__band")
    return made if pixels is not None or max(1, TILE // width) >= height else added(made, ["image_id"])


def added(sums: DataFrame, by: list[str]) -> DataFrame:
    """The sums of parts that are equal in `by`."""
    return sums.groupBy(*by).agg(*(F.sum(c.split()[0]).alias(c.split()[0]) for c in SUMS.split(", ")))
