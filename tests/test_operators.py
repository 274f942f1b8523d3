"""Labels, splits, raster, losses, matching, curation, sequence and streams on small fixtures."""

import json
import math
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkspan.operators import curation, decode, losses, matching, plugins, raster, sequence, splits
from inkspan.sources import labels
from inkspan.streaming import state

QUAD = [[0, 0], [4, 0], [4, 3], [0, 3]]


def label_file(tmp_path, lines):
    p = tmp_path / "labels.txt"
    p.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(p)


def box(points, score):
    return {"transcription": "", "points": points, "score": score}


def test_label_rules(spark, tmp_path):
    lines = ["a/1.jpg\t" + json.dumps([box(QUAD, 0.9), box(QUAD[:2], None)]), "", "b/2.jpg\t" + json.dumps([box(QUAD[:3], 0.0), box(QUAD[:3], float("nan"))])]
    path = label_file(tmp_path, lines)
    numbered = labels.read_numbered_labels(spark, path)
    assert sorted(r.image_id for r in numbered.collect()) == [1, 3]
    kept = sorted((r.rel_path, str(r.score)) for r in labels.training_boxes(labels.read_labels(spark, path), 0.5).collect())
    assert kept == [("a/1.jpg", "0.9"), ("b/2.jpg", "1.0"), ("b/2.jpg", "nan")]
    assert labels.training_boxes(labels.read_labels(spark, path), 0.5, vertices=0).count() == 4


def test_bad_lines(spark, tmp_path):
    path = label_file(tmp_path, ["no-tab.jpg", "x.jpg\t[]\textra"])
    with pytest.raises(Exception, match="without a tab"):
        labels.read_labels(spark, path).collect()
    assert sorted(r.rel_path for r in labels.read_done(spark, path).collect()) == ["no-tab.jpg", "x.jpg"]
    assert labels.read_done(spark, str(tmp_path / "none.txt")).count() == 0
    with pytest.raises(Exception):
        labels.read_labels(spark, label_file(tmp_path, ["a\t{not json"])).collect()
    assert labels.read_labels(spark, label_file(tmp_path, ["a\t{not json"]), strict=False).first().boxes is None


def test_lines_round_trip(spark, tmp_path):
    path = label_file(tmp_path, ["ü.jpg\t" + json.dumps([box([[0.5, 1.5], [2.5, 3.4], [1, 1]], None)], ensure_ascii=False)])
    out = str(tmp_path / "out")
    labels.append_labels(labels.read_labels(spark, path), out)
    labels.append_labels(labels.read_labels(spark, path), out)
    rows = labels.read_labels(spark, out).collect()
    assert len(rows) == 2 and rows[0].boxes[0].points == [[0.0, 2.0], [2.0, 3.0], [1.0, 1.0]] and rows[0].boxes[0].score is None
    assert '"score":null' in spark.read.text(out).first().value


def test_discovery_and_sizes(spark, tmp_path):
    (tmp_path / "a-b").mkdir()
    (tmp_path / "a").mkdir()
    png = b"\x89PNG\r\n\x1a\n" + b"\0" * 8 + (640).to_bytes(4, "big") + (480).to_bytes(4, "big")
    for name in ("a-b/x.PNG", "a/x.jpg", "a/y.txt"):
        (tmp_path / name).write_bytes(png)
    found = labels.discover_images(spark, str(tmp_path), content=True)
    names = [r.path.split("/")[-2:] for r in found.orderBy(labels.path_order(F.col("path"))).collect()]
    assert names == [["a", "x.jpg"], ["a-b", "x.PNG"]]
    assert {(r.width, r.height) for r in plugins.dimensions(found).collect()} == {(640, 480)}
    assert plugins.header_size(b"junk") == (0, 0) and plugins.header_size(None) == (0, 0)


def test_splits(spark):
    paths = spark.createDataFrame([(f"p{i}",) for i in range(40)] + [("p0",)], "rel_path string")
    a = {(r.rel_path, r.is_val) for r in splits.train_val(paths, 42, 0.1).collect()}
    assert a == {(r.rel_path, r.is_val) for r in splits.train_val(paths.repartition(3), 42, 0.1).collect()}
    assert len(a) == 40 and 3 <= sum(v for _, v in a) <= 4
    assert sorted(splits.exact_shuffle(["a", "b", "c"], 1)) == ["a", "b", "c"]
    assert splits.within_split(paths, None).count() == 41
    assert splits.within_split(paths, paths.where("rel_path = 'p0'")).count() == 2
    dup = spark.createDataFrame([("x", 1, "first"), ("x", 2, "last")], "k string, n int, v string")
    assert splits.last_of_each(dup, "k", "n").first().v == "last" and splits.first_of_each(dup, "k", "n").first().v == "first"
    with pytest.raises(LookupError):
        splits.row_at(dup, "n", at=9)
    pos = spark.range(1, 36).withColumnRenamed("id", "pos")
    assert splits.batches(pos, "pos", 16, True).count() == 32 and splits.batches(pos, "pos", 16, False).count() == 35
    members = splits.collated(splits.batches(pos, "pos", 16, False), "pos").orderBy("batch_id").collect()
    assert [len(r.members) for r in members] == [16, 16, 3] and members[2].members[0].pos == 33
    assert splits.nth_worst(spark.createDataFrame([(1, 5.0), (2, 7.0), (3, 7.0)], "i int, l double"), "l", "i", 1).first().i == 3


def test_polygon_raster_against_brute_force(spark):
    tri = [(1.0, 1.0), (9.0, 2.0), (4.0, 8.0)]
    square = [(2.0, 2.0), (6.0, 2.0), (6.0, 5.0), (2.0, 5.0)]
    df = spark.createDataFrame([(1, 1, [{"x": x, "y": y} for x, y in tri]), (1, 2, [{"x": x, "y": y} for x, y in square])], "image_id long, box_idx int, points array<struct<x:double,y:double>>")

    def inside(poly, x, y):
        for i in range(len(poly)):
            (ax, ay), (bx, by) = poly[i], poly[(i + 1) % len(poly)]
            if (bx - ax) * (y - ay) - (by - ay) * (x - ax) < -1e-9:
                return False
        return True

    got = {(r.box_idx, r.y, r.x) for r in raster.polygon_pixels(df, 10, 10).collect()}
    assert got == {(k, y, x) for k, p in ((1, tri), (2, square)) for y in range(10) for x in range(10) if inside(p, x, y)}


def plain_targets(boxes, ratio, low, high, min_size, width, height):
    """The four maps pixel by pixel: clip, ignore, shrink, ring with round corners, nothing off the ring."""
    prob, mask, thresh, on_ring = ({} for _ in range(4))
    for x0, y0, w, h, ignore in boxes:
        x1, y1 = min(max(x0 + w, 0), width - 1), min(max(y0 + h, 0), height - 1)
        x0, y0 = min(max(x0, 0), width - 1), min(max(y0, 0), height - 1)
        w, h = x1 - x0, y1 - y0
        d = w * h * (1 - ratio * ratio) / (2 * (w + h)) if w + h else 0
        if ignore or min(w, h) < min_size or 2 * d >= min(w, h):
            for y in range(int(y0), int(y1) + 1):
                for x in range(int(x0), int(x1) + 1):
                    mask[y, x] = 0
            continue
        for y in range(height):
            for x in range(width):
                core = int(x0 + d) <= x <= int(x1 - d) and int(y0 + d) <= y <= int(y1 - d)
                if core:
                    prob[y, x] = 1
                    continue
                px, py = min(max(x, x0), x1), min(max(y, y0), y1)
                inside = (px, py) == (x, y)
                dist = min(x - x0, x1 - x, y - y0, y1 - y) if inside else math.hypot(x - px, y - py)
                if inside or dist <= d:
                    on_ring[y, x] = 1
                    thresh[y, x] = max(thresh.get((y, x), 0), (1 - min(dist / d, 1)) * (high - low) + low)
    return prob, mask, thresh, on_ring


def test_targets_against_brute_force(spark):
    own = [(2.0, 2.0, 12.0, 8.0, False), (8.0, 4.0, 10.0, 10.0, False), (20.0, 20.0, 30.0, 9.0, False), (-5.0, 22.0, 14.0, 9.0, False), (3.0, 12.0, 9.0, 3.0, False), (14.0, 1.0, 9.0, 9.0, True)]
    scores_ = [0.5, 0.9, 0.0, 0.7, 0.6, 0.8]
    rows = [(1, i + 1, *b, s) for i, (b, s) in enumerate(zip(own, scores_, strict=True))]
    df = spark.createDataFrame(rows, "image_id int, box_idx int, x0 double, y0 double, w double, h double, ignore boolean, score double")
    prob, mask, thresh, on_ring = plain_targets(own, 0.4, 0.3, 0.7, 4.0, 32, 32)
    got = {(r.y, r.x): r for r in raster.targets(df, 0.4, 0.3, 0.7, 4.0, 32, 32).collect()}
    assert {k for k, r in got.items() if r.prob} == set(prob) and {k for k, r in got.items() if not r.prob_mask} == set(mask)
    assert {k for k, r in got.items() if r.thresh_mask} == set(on_ring)
    assert all(r.thresh == pytest.approx(thresh.get(k, 0.0)) for k, r in got.items())
    got = {(r.y, r.x): r.value for r in raster.threshold_map(df, 0.4, 0.3, 0.7, 4.0, 32, 32).collect()}
    assert got == pytest.approx(thresh)
    assert {(r.y, r.x) for r in raster.ring_mask(df, 0.4, 4.0, 32, 32).collect()} == set(on_ring)
    want = {}
    for (x0, y0, w, h, _), s in zip(own, scores_, strict=True):
        # boxes over a border are clipped before they shrink; small and ignored ones count
        x1, y1 = min(max(x0 + w, 0), 31), min(max(y0 + h, 0), 31)
        x0, y0 = min(max(x0, 0), 31), min(max(y0, 0), 31)
        w, h = x1 - x0, y1 - y0
        d = w * h * (1 - 0.16) / (2 * (w + h))
        for y in range(32):
            for x in range(32):
                if 2 * d < min(w, h) and int(x0 + d) <= x <= int(x0 + w - d) and int(y0 + d) <= y <= int(y0 + h - d):
                    want[y, x] = s if s > 0 else 1.0
    assert {(r.y, r.x): r.value for r in raster.score_map(df, 0.4, 32, 32).collect()} == want


def test_percentiles_of_many_values(spark, monkeypatch):
    from inkspan.functions import order

    monkeypatch.setattr(order, "GATHERED", 200)
    rng = np.random.default_rng(2)
    for x in (rng.normal(size=30_000), np.concatenate([np.zeros(20_000), rng.random(9_000)]), np.ones(5_000)):
        df = spark.createDataFrame([(float(v),) for v in x], "v double")
        assert order.percentiles(df, "v", [0.0, 0.5, 0.95, 1.0]) == pytest.approx(np.quantile(x, [0.0, 0.5, 0.95, 1.0]))


def test_later_history_counts(spark, tmp_path):
    path, schema = str(tmp_path / "h"), "epoch int, hmean double, note string"
    labels.append_history(spark.createDataFrame([(1, 0.1, "a"), (2, 0.2, "a")], schema).coalesce(1), path)
    time.sleep(1.1)
    labels.append_history(spark.createDataFrame([(1, 0.9, "b" * 500)], schema).coalesce(1), path)  # a larger file is read first
    assert {r.epoch: r.hmean for r in labels.read_history(spark, path, schema).collect()} == {1: 0.9, 2: 0.2}


def test_small_label_helpers(spark, tmp_path):
    df = spark.createDataFrame([("/data/set/a/b.png",), ("/other/c.png",)], "p string")
    assert [r[0] for r in df.select(labels.relative_path(F.col("p"), "/data/set/")).collect()] == ["a/b.png", "/other/c.png"]
    pts = spark.createDataFrame([([{"x": 1.0, "y": 1.0}],), ([{"x": 1.0, "y": 1.0}, {"x": 2.0, "y": 1.0}],)], "p array<struct<x:double,y:double>>")
    assert [r[0] for r in pts.select(labels.drawable(F.col("p"))).collect()] == [False, True]
    (tmp_path / "train.txt").write_text("a\n")
    assert not labels.both_exist(spark, str(tmp_path / "train.txt"), str(tmp_path / "val.txt"))
    images = spark.createDataFrame([(1, "a.jpg"), (2, "b.jpg")], "id long, file_name string")
    boxes = spark.createDataFrame([(1, 1, [{"x": 0.0, "y": 0.0}, {"x": 4.0, "y": 0.0}, {"x": 4.0, "y": 3.0}], 0.9)], "image_id long, box_idx int, points array<struct<x:double,y:double>>, score double")
    doc = labels.coco_document(images, labels.coco_annotations(boxes, 0.5), F.lit(True))
    assert [i["id"] for i in doc["images"]] == [1, 2] and doc["annotations"][0]["area"] == 12.0 and json.loads(json.dumps(doc)) == doc


def test_turns(spark):
    from inkspan.functions import geometry

    df = spark.createDataFrame([(op,) for op in range(6)], "op int").select("op", *(c.alias(n) for n, c in zip("xy", geometry.turned(F.lit(1.0), F.lit(2.0), 10, 20, F.col("op")), strict=True)))
    assert {r.op: (r.x, r.y) for r in df.collect()} == {0: (1, 2), 1: (8, 2), 2: (1, 17), 3: (2, 8), 4: (8, 17), 5: (17, 1)}


def pixels(spark, pos, neg):
    rows = [(1, 0, i, 0.9, 1.0, 1.0, 1.0) for i in range(pos)] + [(1, 1, i, (i + 1) / (neg + 1), 0.0, 1.0, 1.0) for i in range(neg)]
    return spark.createDataFrame(rows, "image_id int, y int, x int, p double, t double, m double, w double")


def test_ohem_takes_k_negatives(spark):
    for pos, neg, ratio in ((2, 10, 3.0), (0, 10, 3.0), (5, 3, 3.0)):
        k = min(neg, int(max(pos, 1) * ratio))
        worst = sorted((-math.log(1 - (i + 1) / (neg + 1)) for i in range(neg)), reverse=True)[:k]
        want = (pos * -math.log(0.9) + sum(worst)) / max(pos + k, 1)
        px = pixels(spark, pos, neg)
        assert losses.ohem_bce(px, ["image_id"], ratio).first().bce == pytest.approx(want)
        total, n = losses.ohem_by_threshold(px, ratio)
        assert n == k and total == pytest.approx(sum(worst), rel=1e-6)


def test_dice_bounds(spark):
    px = pixels(spark, 4, 4)
    assert 0 <= losses.dice(px, ["image_id"]).first().dice <= 1
    assert losses.dice(px.withColumn("p", F.col("t")), ["image_id"]).first().dice == pytest.approx(0, abs=1e-6)
    assert losses.masked_l1(px.withColumn("m", F.lit(0.0)), ["image_id"]).first().l1 == 0


def test_components_and_decode(spark):
    rng = np.random.default_rng(3)
    grid = rng.random((12, 12)) > 0.45
    rows = [(7, int(y), int(x), 0.9) for y, x in zip(*np.nonzero(grid), strict=True)]
    df = spark.createDataFrame(rows, "image_id long, y int, x int, p double")
    seen, want = set(), {}
    for y, x in zip(*np.nonzero(grid), strict=True):
        if (y, x) in seen:
            continue
        stack = [(y, x)]
        while stack:
            q = stack.pop()
            if q in seen or not (0 <= q[0] < 12 and 0 <= q[1] < 12) or not grid[q]:
                continue
            seen.add(q)
            want[int(q[0]), int(q[1])] = (int(y), int(x))
            stack += [(q[0] + 1, q[1]), (q[0] - 1, q[1]), (q[0], q[1] + 1), (q[0], q[1] - 1)]
    assert {(r.y, r.x): (r.first_y, r.first_x) for r in decode.components(df).collect()} == want
    block = [(1, y, x, 0.9) for y in range(10, 20) for x in range(10, 40)] + [(1, y, 50, 0.9) for y in range(5, 60)]
    out = decode.decode(spark.createDataFrame(block, "image_id long, y int, x int, p double"), decode.DecodeConfig(), 64, 64).collect()
    d = 29 * 9 * 1.8 / (2 * 38)
    assert len(out) == 1 and min(p.x for p in out[0].points) == pytest.approx(10 - d) and max(p.y for p in out[0].points) == pytest.approx(19 + d)


def test_greedy_is_in_prediction_order(spark):
    c = spark.createDataFrame([(1, 1, 1, 0.6), (1, 1, 2, 0.9), (1, 2, 1, 0.8), (1, 2, 2, 0.7)], "image_id int, pred_idx int, gt_idx int, iou double")
    assert [(m.pred, m.gt) for m in matching.greedy(c).first().matches] == [(1, 2), (2, 1)]
    h = matching.hmean(spark.createDataFrame([(2, 1, 0)], "tp long, fp long, fn long")).first()
    assert h.precision == pytest.approx(2 / 3) and h.recall == 1 and h.hmean == pytest.approx(0.8)
    assert matching.hmean(spark.createDataFrame([(0, 0, 0)], "tp long, fp long, fn long")).first().hmean == 0


def test_curation(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(100)], "i int, loss double")
    assert curation.within_percentile(df, "loss", 0.95).count() == 95 and curation.beyond_percentile(df, "loss", 0.95).count() == 5
    with pytest.raises(Exception, match="NaN"):
        curation.within_percentile(spark.createDataFrame([(float("nan"),)], "loss double"), "loss", 0.95).collect()
    h = {r["bin"]: r["count"] for r in curation.histogram(df, "loss", 60).collect()}
    assert sum(h.values()) == 100 and max(h) == 59 and len(h) == 60


def test_sequence(spark):
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate((1, 2, 3))], "k int, t int, v double")
    assert sequence.ema(df, "k", ["t"], "v", 0.9, F.lit(0.5)).first().ema == pytest.approx(0.9255)
    best = spark.createDataFrame([(1, i, v) for i, v in enumerate((0.0, 0.2, 0.2, 0.5, 0.1))], "k int, t int, v double")
    assert [r.t for r in sequence.best_so_far(best, ["k"], ["t"], "v").orderBy("t").collect()] == [1, 3]
    assert sequence.gated(spark.range(10), "id", 5).count() == 2


def test_plugins(spark):
    def make():
        def detector(path):
            if path == "bad":
                raise ValueError("no image")
            return {"dt_polys": [QUAD]} if path == "unscored" else {"dt_polys": [QUAD], "dt_scores": [0.7]}

        return detector

    out = {r.rel_path: r for r in plugins.detect(spark.createDataFrame([("bad",), ("unscored",), ("ok",)], "rel_path string"), make).collect()}
    assert out["bad"].error == "ValueError: no image" and out["unscored"].boxes[0].score is None and out["ok"].boxes[0].score == 0.7
    sample = spark.createDataFrame([("a", bytearray(b"x"), [{"points": [{"x": 0.0, "y": 0.0}, {"x": 9.0, "y": 0.0}, {"x": 9.0, "y": 9.0}], "score": 1.0}, {"points": [{"x": 0.0, "y": 0.0}] * 3, "score": 1.0}])], "rel_path string, image binary, boxes array<struct<points:array<struct<x:double,y:double>>,score:double>>")
    assert len(plugins.augment(sample, lambda: lambda image, polys: (image, polys)).first().boxes) == 1
    maps = plugins.score_maps(spark.createDataFrame([(1, bytearray(b"x"))], "image_id long, content binary"), lambda: lambda b: [[0.1, 0.9]])
    assert [(r.y, r.x, r.p) for r in maps.collect()] == [(0, 0, 0.1), (0, 1, 0.9)]


def test_image_decoders_fall_back(spark):
    df = spark.createDataFrame([("a", bytearray(b"ok")), ("b", bytearray(b"no"))], "path string, content binary")

    def make():
        def second(content):
            if content != b"ok":
                raise ValueError("unknown format")
            return 1, 1, b"rgb"

        return [lambda content: 1 / 0, second]

    got = {r.path: (r.width, r.error) for r in plugins.decode_images(df, make).collect()}
    assert got == {"a": (1, None), "b": (None, "ValueError: unknown format")}


def test_config(tmp_path):
    from inkspan import config

    (tmp_path / "c.yaml").write_text("loss:\n  alpha: 2\n")
    path, rest = config.split_args(["x.yaml", "loss.beta=3", str(tmp_path / "c.yaml")])
    c = config.load(path, rest)
    assert (c.loss.alpha, c.loss.beta, c.postprocess.thresh) == (2.0, 3.0, 0.3)
    config.dump(c, str(tmp_path / "d.yaml"))
    assert config.load(str(tmp_path / "d.yaml")) == c
    with pytest.raises(KeyError):
        config.load(None, ["loss.gamma=1"])
    (tmp_path / "e.yaml").write_text("data:\n  min_score: 0.6\ntrainer:\n  epochs: 3\n  optimizer: adamw\npostprocess:\n  unclip_ratio: 2\nmodel:\n  head:\n    k: 50\n    bias: false\ndevice: cuda\n")
    c = config.load(str(tmp_path / "e.yaml"), ["model.head.k=40", "trainer.lr=0.01"])
    assert (c.data.min_score, c.trainer.epochs, c.trainer.other, c.postprocess.unclip_ratio, c.model, c.device) == (0.6, 3, {"optimizer": "adamw"}, 2.0, {"head": {"k": 40, "bias": False}}, "cuda")


def test_streams_resume(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    args = (str(inbox), str(tmp_path / "labels"), str(tmp_path / "failures"), str(tmp_path / "cp"), lambda: lambda p: {"dt_polys": [QUAD]} if p != "bad" else 1 / 0)
    for name, paths in (("1", "a\nbad\n"), ("2", "b\na\n")):  # a comes again
        (inbox / name).write_text(paths)
        state.label_stream(spark, *args).awaitTermination()
    assert sorted(r.rel_path for r in labels.read_labels(spark, args[1]).collect()) == ["a", "b"]
    assert "ZeroDivisionError" in spark.read.text(args[2]).first().value


def test_ema_stream(spark, tmp_path):
    src = str(tmp_path / "steps")
    rng = random.Random(1)
    rows = [(k, i, rng.random()) for i in range(20) for k in (1, 2)]
    spark.createDataFrame(rows[::-1], "k long, t int, v double").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("k long, t int, v double").parquet(src)
    q = state.ema_stream(stream, "k", "t", "v", 0.9, 0.5).writeStream.outputMode("update").format("memory").queryName("ema_out").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    for k in (1, 2):
        v = 0.5
        for kk, _, x in rows:
            v = 0.9 * v + (1 - 0.9) * x if kk == k else v
        assert spark.sql(f"select ema from ema_out where key = {k}").first()[0] == pytest.approx(v)


@pytest.mark.parametrize(("tile", "chunk"), [(1 << 19, 1 << 21), (1 << 19, 700), (640, 700)])
def test_sums_of_maps_are_those_of_their_pixels(spark, monkeypatch, tile, chunk):
    from inkspan.operators import paint, raster

    monkeypatch.setattr(paint, "TILE", tile)
    monkeypatch.setattr(paint, "CHUNK", chunk)
    r = random.Random(5)
    # image 3 has more boxes than are drawn at once, and most of them overlap
    rows = [(i, k + 1, r.uniform(-9, 60), r.uniform(-9, 60), r.uniform(0, 30), r.uniform(0, 20), r.choice([None, 0.0, 0.4, 0.9]), r.random() < 0.2) for i, n in ((1, 1), (2, 3), (3, 60), (4, 9)) for k in range(n)]
    df = spark.createDataFrame(rows, "image_id long, box_idx int, x0 double, y0 double, w double, h double, score double, ignore boolean")
    of = {}
    for row in rows:
        of.setdefault(row[0], []).append((*row[2:6], row[7]))
    want = {i: plain_targets(b, 0.4, 0.3, 0.7, 4.0, 64, 64) for i, b in of.items()}
    sums = lambda made: {x.image_id: x for x in made.collect()}
    four = sums(raster.targets(df, 0.4, 0.3, 0.7, 4.0, 64, 64, sums=True))
    for i, (prob, mask, thresh, on_ring) in want.items():
        assert (four[i].pixels, four[i].prob, four[i].cleared, four[i].ring) == (len(prob.keys() | mask.keys() | on_ring.keys()), len(prob), len(mask), len(on_ring))
        assert four[i].total == pytest.approx(sum(thresh.values()))
    pixels = {(x.image_id, x.y, x.x) for x in raster.targets(df, 0.4, 0.3, 0.7, 4.0, 64, 64).collect()}
    assert len(pixels) == sum(x.pixels for x in four.values())
    assert {i: x.pixels for i, x in sums(raster.ring_mask(df, 0.4, 4.0, 64, 64, sums=True)).items()} == {i: len(w[3]) for i, w in want.items() if w[3]}
    assert {i: x.pixels for i, x in sums(raster.core_mask(df, 0.4, 4.0, 64, 64, sums=True)).items()} == {i: len(w[0]) for i, w in want.items() if w[0]}
    assert {i: x.pixels for i, x in sums(raster.masked_out(df, 0.4, 4.0, 64, 64, sums=True)).items()} == {i: len(w[1]) for i, w in want.items() if w[1]}
    got = {}
    for x in raster.score_map(df, 0.4, 64, 64).collect():
        got.setdefault(x.image_id, []).append(x.value)
    assert {i: (x.pixels, x.total) for i, x in sums(raster.score_map(df, 0.4, 64, 64, sums=True)).items()} == {i: (len(v), pytest.approx(sum(v))) for i, v in got.items()}


def test_images_that_only_clear_the_mask_have_sums(spark):
    df = spark.createDataFrame([(1, 1, 2.0, 2.0, 9.0, 3.0), (2, 1, 2.0, 2.0, 12.0, 8.0), (3, 1, 4.0, 4.0, 2.0, 9.0)], "image_id long, box_idx int, x0 double, y0 double, w double, h double").coalesce(1)
    got = {r.image_id: (r.cleared, r.ring > 0) for r in raster.targets(df, 0.4, 0.3, 0.7, 4.0, 32, 32, sums=True).collect()}
    assert got == {1: (40, False), 2: (0, True), 3: (30, False)}


@pytest.mark.parametrize("name", ["rasterize", "score_map", "edge_distance", "threshold_map", "ring_mask", "prob_mask", "targets", "polygon_offset", "polygon_targets"])
def test_no_row_per_pixel_leaves_a_task(spark, name):
    from inkspan.plans import registry

    df = registry.queries()[name](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"\by#\d", plan)
