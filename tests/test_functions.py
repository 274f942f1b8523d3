"""Micro-fixtures of scores, geometry, order and decoding."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkspan.functions import geometry, scores
from inkspan.functions.order import numbered, percentiles
from inkspan.operators import decode


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_scores(spark):
    df = spark.createDataFrame([(None,), (0.0,), (0.3,), (0.5,), (float("nan"),)], "s double")
    got = [r[0] for r in df.select(scores.training_score(F.col("s"))).collect()]
    assert got[:4] == [1.0, 1.0, 0.3, 0.5] and math.isnan(got[4])
    assert [r[0] for r in df.select(scores.export_score(F.col("s"))).collect()][:2] == [0.0, 0.0]
    kept = df.select(scores.training_score(F.col("s")).alias("t")).where(scores.reaches(F.col("t"), 0.5)).count()
    assert kept == 4


def test_rectangle_measures(spark):
    p = geometry.box_points(*(F.lit(float(v)) for v in (1, 2, 4, 3)))
    r = one(spark, geometry.area(p).alias("a"), geometry.perimeter(p).alias("l"), geometry.short_side(p).alias("s"))
    assert (r.a, r.l, r.s) == (12.0, 14.0, 3.0)
    d = one(spark, geometry.offset_distance(F.lit(12.0), F.lit(14.0), 0.4).alias("d"), geometry.offset_distance(F.lit(0.0), F.lit(0.0), 0.4).alias("n"))
    assert abs(d.d - 0.72) < 1e-12 and d.n is None


def test_pairs_and_flat(spark):
    r = one(spark, geometry.pairs(F.array(*(F.lit(float(v)) for v in (1, 2, 3, 4, 5)))).alias("p"), geometry.pairs(F.expr("cast(array() as array<double>)")).alias("e"))
    assert [(p.x, p.y) for p in r.p] == [(1, 2), (3, 4)] and r.e == []


def test_letterbox_rounds_half_to_even(spark):
    r = one(spark, geometry.letterbox(F.lit(1280.0), F.lit(1.0), 640).alias("l")).l
    assert (r.new_w, r.new_h, r.pad_left) == (640, 1, 0)


def test_edge_distance_matches_closed_form(spark):
    from inkspan.operators.raster import outline_distance

    pts = [(float(x), float(y)) for x in range(-3, 12) for y in range(-3, 9)]
    df = spark.createDataFrame(pts, "x double, y double")
    box = [F.lit(float(v)) for v in (1, 2, 6, 3)]
    rows = df.select(geometry.edge_distance(geometry.box_points(*box), F.col("x"), F.col("y")).alias("a"), outline_distance(F.col("x"), F.col("y"), *box).alias("b")).collect()
    assert all(abs(r.a - r.b) < 1e-9 for r in rows)


def test_jitter_is_bounded_and_repeatable(spark):
    p = geometry.box_points(*(F.lit(10.0) for _ in range(4)))
    a, b = (one(spark, geometry.jitter(p, F.lit("k"), 2.0).alias("p")).p for _ in range(2))
    assert a == b and all(abs(q.x - o[0]) <= 2 and abs(q.y - o[1]) <= 2 for q, o in zip(a, [(10, 10), (20, 10), (20, 20), (10, 20)], strict=True))


def test_normalize_round_trip(spark):
    df = spark.range(256).select(F.col("id").cast("double").alias("v"))
    assert df.where(scores.denormalize(scores.normalize(F.col("v"), F.lit(1)) + 1e-9, F.lit(1)) != F.col("v").cast("int")).count() == 0


def test_cosine_lr(spark):
    df = spark.range(101).select(scores.cosine_lr(F.col("id"), 100, 10, 1.0, 0.1).alias("v"))
    v = [r.v for r in df.collect()]
    assert v[0] == 0.1 and v[9] == 1.0 and abs(v[10] - 1.0) < 1e-12 and abs(v[100] - 0.1) < 1e-12


def test_numbered_and_percentiles(spark):
    df = spark.createDataFrame([(i * 7 % 50,) for i in range(50)], "v int")
    got = numbered(df, F.floor(F.col("v") / 8), ["v"]).collect()
    assert all(r.n == r.v + 1 for r in got)
    assert percentiles(df, "v", [0.0, 0.5, 0.95, 1.0]) == pytest.approx(list(np.percentile(np.arange(50), [0, 50, 95, 100])))
    assert percentiles(df.where("v > 99"), "v", [0.5]) == [None]


def test_rect_fit_and_growth():
    pts = np.array([[x, y] for x in range(5) for y in range(3)], float)
    r = decode.min_area_rect(pts)
    assert abs(decode.polygon_area(r)) == pytest.approx(8.0)
    g = decode.grown_rect(r, 1.5)
    d = 8 * 1.5 / 12
    assert abs(decode.polygon_area(g)) == pytest.approx((4 + 2 * d) * (2 + 2 * d))
    assert decode.min_area_rect(np.array([[0, 0], [1, 0], [2, 0]], float)) is None


def test_convex_iou_and_inward_offset():
    a = np.array([[0, 0], [4, 0], [4, 4], [0, 4]], float)
    assert decode.convex_iou(a, a + 2) == pytest.approx(4 / 28)
    assert decode.convex_iou(a, a[::-1]) == pytest.approx(1.0)
    assert decode.convex_iou(a, a[:2]) == 0.0
    assert abs(decode.polygon_area(decode.inward_offset(a, 1.0))) == pytest.approx(4.0)
    assert decode.inward_offset(a, 2.5) is None


def test_cosine_lr_far_beyond_the_first_epochs(spark):
    # steps at which the rounded rate depends on the last bit of the angle; rates as DuckDB computes them
    want = {427589: 803722725, 726089: 197277275, 1024589: 803722724, 2119089: 197277276}
    rate = scores.cosine_lr(F.col("step"), 100_000, 500, 1e-3, 1e-6)
    got = spark.createDataFrame([(s,) for s in want], "step long").select("step", F.floor(rate * 1e12 + 0.5).alias("lr")).collect()
    assert {r.step: r.lr for r in got} == want
