"""The decoder against a plain one, and labels across the borders of squares."""

import itertools
import math
import random

import pytest

from inkspan.functions import graph
from inkspan.operators import decode

PX = "image_id long, y int, x int, p double"


def flood(pixels):
    """{(y, x): first pixel of its component}"""
    out = {}
    for start in sorted(pixels):
        stack = [start]
        while stack:
            y, x = at = stack.pop()
            if at in pixels and at not in out:
                out[at] = start
                stack += [(y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)]
    return out


def snake(n):
    """One path through all columns of an n x n map."""
    return {(y, x) for x in range(0, n, 2) for y in range(n)} | {(0 if x % 4 == 1 else n - 1, x) for x in range(1, n - 1, 2)}


@pytest.mark.parametrize("tile", [4, 7, 64])
def test_labels_across_borders(spark, tile):
    draw = random.Random(tile)
    maps = {i: {(y, x) for y in range(23) for x in range(19) if draw.random() < 0.55} for i in range(4)} | {4: snake(21), 5: {(0, 0)}}
    rows = [(i, y, x, 0.5) for i, px in maps.items() for y, x in px]
    draw.shuffle(rows)
    df = spark.createDataFrame(rows, PX).repartition(3)
    got = {(r.image_id, r.y, r.x): (r.first_y, r.first_x) for r in decode.components_tiled(df, tile).collect()}
    assert got == {(i, *at): first for i, px in maps.items() for at, first in flood(px).items()}
    assert decode.components_tiled(df.limit(0), tile).count() == 0


def test_graph_components(spark):
    draw = random.Random(2)
    chain = [(str(i), str(i + 1)) for i in range(100, 160)]
    links = chain + [(f"s{draw.randint(0, 60)}", f"s{draw.randint(0, 60)}") for _ in range(50)] + [("hub", f"leaf{i}") for i in range(200)] + [("x", "x")]
    near = {}
    for a, b in links:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = {}
    for start in sorted(near):
        stack = [start]
        while stack:
            a = stack.pop()
            if a not in want:
                want[a] = start
                stack += near[a]
    assert {r.id: r.root for r in graph.components(spark.createDataFrame(links, "a string, b string")).collect()} == want


def plain_box(points, cfg):
    best = None
    for (ax, ay), (bx, by) in itertools.permutations(points, 2):
        dx, dy = bx - ax, by - ay
        while not (dx > 0 and dy >= 0):
            dx, dy = dy, -dx
        u, v = [x * dx + y * dy for x, y in points], [y * dx - x * dy for x, y in points]
        size = (max(u) - min(u)) * (max(v) - min(v)) / (dx * dx + dy * dy)
        if best is None or (size, dy / dx) < best[0]:
            best = (size, dy / dx), (math.hypot(dx, dy), dx, dy, min(u), max(u), min(v), max(v))
    if best is None or not best[0][0]:
        return None
    n, dx, dy, *ends = best[1]
    a0, a1, b0, b1 = (e / n for e in ends)
    w, h = a1 - a0, b1 - b0
    d = w * h * cfg.unclip_ratio / (2 * (w + h))
    if min(w, h) < cfg.min_size or min(w, h) + 2 * d < cfg.min_size + 2:
        return None
    return [((a * dx - b * dy) / n, (a * dy + b * dx) / n) for a, b in ((a0 - d, b0 - d), (a1 + d, b0 - d), (a1 + d, b1 + d), (a0 - d, b1 + d))]


@pytest.mark.parametrize("tile", [None, 6])
def test_decode_against_a_plain_decoder(spark, tile):
    draw = random.Random(7)
    rows = []
    for image in range(6):
        for y in range(16):
            for x in range(20):
                # slanted bars that touch at corners or edges, and noise
                bar = (y + (x * (image + 1)) // 6) % 7 < 4 if image < 4 else draw.random() < 0.5
                rows.append((image, y, x, draw.uniform(0.55, 0.95) if bar else 0.1))
    cfg = decode.DecodeConfig(thresh=0.5, box_thresh=0.7, min_size=2.0, max_candidates=5)
    got = {}
    for r in decode.decode(spark.createDataFrame(rows, PX), cfg, scale=0.5, pad=(1.0, 2.0), tile=tile).collect():
        got[r.image_id, r.rank] = [c for p in r.points for c in (p.x, p.y)], r.score
    want = {}
    for image in range(6):
        px = {(y, x): p for i, y, x, p in rows if i == image and p > 0.5}
        groups = {}
        for at, first in flood(px).items():
            groups.setdefault(first, []).append(at)
        rank = 0
        for _, own in sorted(groups.items()):
            score = sum(px[at] for at in own) / len(own)
            if len(own) >= 4 and score >= 0.7 and rank < 5:
                box = plain_box([(x, y) for y, x in own], cfg)
                if box:
                    rank += 1
                    want[image, rank] = [c for x, y in box for c in ((x - 1) / 0.5, (y - 2) / 0.5)], score
    assert set(got) == set(want) and len(want) > 8
    for k, (points, score) in want.items():
        assert got[k][0] == pytest.approx(points) and got[k][1] == pytest.approx(score)
