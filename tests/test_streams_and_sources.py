"""Meters in streams, line numbers by splits, image sizes, split lists, scans over blocks, augmentation plans."""

import struct

import pytest
from pyspark.sql import functions as F

from inkspan.config import AugmentConfig
from inkspan.operators import augment, plugins, sequence
from inkspan.sources import labels
from inkspan.streaming import state


def test_meters_hold_early_steps(spark, tmp_path):
    inbox, out, point = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    schema = "run string, step long, value double"
    runs = {"a": [0.0, 3.0, 1.0, 3.0, 5.0, 2.0], "b": [-1.0, -2.0]}
    batches = [[("a", 1), ("a", 0), ("b", 1), ("a", 4)], [("a", 0), ("a", 2), ("a", 4)], [("a", 5), ("b", 0), ("a", 3)]]
    for batch in batches:  # each batch is a query that starts again from the checkpoint
        spark.createDataFrame([(k, i, runs[k][i]) for k, i in batch], schema).coalesce(1).write.mode("append").parquet(inbox)
        made = state.meter_stream(spark.readStream.schema(schema).parquet(inbox), "run", "step", "value", 0.5, 1.0)
        write = lambda df, _: df.write.mode("append").parquet(out)
        made.writeStream.foreachBatch(write).option("checkpointLocation", point).outputMode("update").trigger(availableNow=True).start().awaitTermination()
    rows = {(r.run, r.steps): r for r in spark.read.parquet(out).collect()}
    assert set(rows) == {("a", 2), ("b", 0), ("a", 3), ("a", 6), ("b", 2)}
    assert rows["a", 2].waiting == 1 and rows["a", 3].waiting == 1 and rows["a", 6].waiting == 0
    last, ema = rows["a", 6], 1.0
    for v in runs["a"]:
        ema = 0.5 * ema + 0.5 * v
    assert (last.mean, last.ema, last.best, last.best_step) == (pytest.approx(14 / 6), pytest.approx(ema), 5.0, 4)
    assert rows["a", 2].best_step == 1 and rows["b", 2].best is None and rows["b", 0].waiting == 1


def test_line_numbers_across_splits(spark, tmp_path):
    for name in ("one", "two"):
        lines = [("" if i % 7 == 3 else f'{name}{i}.png\t[{{"transcription": "{"x" * (i % 50)}", "points": [], "score": 1.0}}]') for i in range(3000)]
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = labels.numbered_lines(spark, str(tmp_path))
        assert rows.rdd.getNumPartitions() >= 1 and spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 8
        got = {(r.file.rsplit("/", 1)[1], r.line): r.value.split("\t")[0] for r in rows.collect()}
        assert got == {(n, i + 1): "" if i % 7 == 3 else f"{n}{i}.png" for n in ("one", "two") for i in range(3000)}
        assert {r.image_id for r in labels.read_numbered_labels(spark, str(tmp_path / "one")).collect()} == {i + 1 for i in range(3000) if i % 7 != 3}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)


def tiff(order, big, width, height, kind):
    e = "<" if order == b"II" else ">"
    size = {3: "H", 4: "I", 16: "Q"}[kind]
    value = lambda v: struct.pack(e + size, v).ljust(8 if big else 4, b"\0")
    entry = lambda tag, v: struct.pack(e + ("HHQ" if big else "HHI"), tag, kind, 1) + value(v)
    rows = entry(254, 0) + entry(256, width) + entry(257, height)
    if big:
        return order + struct.pack(e + "HHHQ", 43, 8, 0, 24) + b"pad pad " + struct.pack(e + "Q", 3) + rows
    return order + struct.pack(e + "HI", 42, 12) + b"pad " + struct.pack(e + "H", 3) + rows


def webp(kind, body):
    chunk = kind + struct.pack("<I", len(body)) + body
    return b"RIFF" + struct.pack("<I", len(chunk) + 4) + b"WEBP" + chunk


def test_image_sizes(spark):
    files = [tiff(o, big, 700, 410, kind) for o in (b"II", b"MM") for big in (False, True) for kind in (3, 4)] + [tiff(b"MM", True, 700, 410, 16)]
    files.append(webp(b"VP8 ", b"\x30\x01\x00\x9d\x01\x2a" + struct.pack("<HH", 700 | 1 << 14, 410)))
    files.append(webp(b"VP8L", b"\x2f" + struct.pack("<I", 699 | 409 << 14 | 1 << 28)))
    files.append(webp(b"VP8X", b"\0\0\0\0" + (699).to_bytes(3, "little") + (409).to_bytes(3, "little")))
    df = spark.createDataFrame([(str(i), bytearray(b)) for i, b in enumerate(files)], "path string, content binary")
    assert {(r.width, r.height) for r in plugins.dimensions(df).collect()} == {(700, 410)}
    for b in files:
        for n in range(len(b)):
            assert plugins.header_size(b[:n]) in ((0, 0), (700, 410))
        assert plugins.header_size(b[:20]) == (0, 0)
    assert plugins.header_size(b"II\x2b\x01" + b"\0" * 40) == plugins.header_size(b"RIFFxxxxWEBPnone" + b"\0" * 40) == (0, 0)


def test_split_lists_are_written_together(spark, tmp_path):
    train, val = str(tmp_path / "train"), str(tmp_path / "val")
    split = spark.createDataFrame([(f"p{i:02}", "val" if i < 3 else "train", 20 - i) for i in range(12)], "rel_path string, part string, pos int")
    assert labels.write_split_lists(spark, split, train, val) and not labels.write_split_lists(spark, split, train, val)
    (tmp_path / "val").rename(tmp_path / "gone")
    assert labels.write_split_lists(spark, split, train, val)
    assert [r.value for r in spark.read.text(val).collect()] == ["p02", "p01", "p00"]


@pytest.mark.parametrize("per_block", [7, 1000])
def test_scans_do_not_depend_on_blocks(spark, per_block):
    rows = [("hot", i, float((i * 37) % 101) - 20) for i in range(90)] + [(None, i, float(i)) for i in range(30)] + [(f"k{i}", 0, -1.0) for i in range(20)]
    df = spark.createDataFrame(rows, "k string, t int, v double")
    got = {(r.k, r.t): (r.n, r.total, r.most) for r in sequence.scan(df, ["k"], ["t"], {"n": F.lit(1), "total": F.col("v")}, {"most": F.col("v")}, per_block).collect()}
    want, seen = {}, {}
    for k, t, v in rows:
        own = seen.setdefault(k, [])
        want[k, t] = (len(own) + 1, sum(own) + v, max(own, default=None))
        own.append(v)
    assert got == want
    for seed in (None, 0.5):
        emas = {r.k: r.ema for r in sequence.ema(df, "k", ["t"], "v", 0.9, None if seed is None else F.lit(seed), per_block).collect()}
        for k, values in seen.items():
            e = values[0] if seed is None else seed
            for v in values:
                e = 0.9 * e + (1 - 0.9) * v
            assert emas[k] == pytest.approx(e)
    best = [(r.k, r.t) for r in sequence.best_so_far(df, ["k"], ["t"], "v", per_block).collect()]
    assert set(best) == {(k, t) for (k, t), (_, _, most) in want.items() if dict(((a, b), c) for a, b, c in rows)[k, t] > (0.0 if most is None else most)}
    assert sequence.scan(df.limit(0), ["k"], ["t"], {"n": F.lit(1)}).count() == 0


def test_augmentation_plan(spark):
    quad = lambda x, y, w, h: [{"x": float(a), "y": float(b)} for a, b in ((x, y), (x + w, y), (x + w, y + h), (x, y + h))]
    rows = [(f"p{i}", 80, 40, [quad(10, 5, 20, 10), quad(0, 0, 1, 30), quad(1, 1, 5, 5)[:2]]) for i in range(400)] + [("none", 80, 40, [])]
    df = spark.createDataFrame(rows, "rel_path string, width int, height int, polygons array<array<struct<x:double,y:double>>>")
    made = augment.augmented(df, AugmentConfig(), 80, F.lit(3), 7).collect()
    seen = set()
    for r in made:
        assert (r.scale, r.pad_left, r.pad_top) == (1.0, 0, 20) and r.keep == ([True, False, False] if r.rel_path != "none" else [])
        for p in r.polygons:
            want = []
            for x, y in ((10, 25), (30, 25), (30, 35), (10, 35)):
                a, b = (y, x) if r.swap else (x, y)
                want.append((79 - a if r.flip_x else a, 79 - b if r.flip_y else b))
            assert [(q.x, q.y) for q in p] == want
        seen.add((r.swap, r.flip_x, r.flip_y))
    assert len(seen) == 8
    again = {r.rel_path: (r.swap, r.flip_x, r.flip_y) for r in augment.plan(df, AugmentConfig(), 80, F.lit(3), 7).collect()}
    assert again == {r.rel_path: (r.swap, r.flip_x, r.flip_y) for r in made}
    other = {r.rel_path: (r.swap, r.flip_x, r.flip_y) for r in augment.plan(df, AugmentConfig(), 80, F.lit(4), 7).collect()}
    assert 200 < sum(other[k] != again[k] for k in again) < 401
    still = augment.plan(df, AugmentConfig(tier="none"), 40, F.lit(3)).collect()
    assert not any(r.swap or r.flip_x or r.flip_y for r in still) and still[0].scale == 0.5 and still[0].pad_top == 10
    shaken = augment.augmented(df, AugmentConfig(box_jitter_px=2.0, p_rot90=0, p_hflip=0, p_vflip=0), 80, F.lit(1)).first()
    assert all(abs(q.x - x) <= 2 and abs(q.y - y) <= 2 for q, (x, y) in zip(shaken.polygons[0], ((10, 25), (30, 25), (30, 35), (10, 35)), strict=True))
