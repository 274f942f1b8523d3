"""Places where a detector, an augmenter, an image decoder or a score-map network is plugged in.

Each takes a factory that a task calls once, so a model is loaded once per partition.
Neural inference itself stays outside this library.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BOX = "struct<transcription:string,points:array<array<double>>,score:double>"


def detect(images: DataFrame, make: Callable[[], Callable[[str], dict]]) -> DataFrame:
    """rel_path, boxes, error.  The detector gives dt_polys and perhaps dt_scores; a failure becomes `Type: message`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for b in batches:
            rows = []
            for path in b["rel_path"]:
                try:
                    got = model(path)
                    polys = [[[float(v) for v in p] for p in poly] for poly in got["dt_polys"]]
                    scores = got.get("dt_scores")
                    scores = [None] * len(polys) if scores is None else [float(s) for s in scores]
                    rows.append((path, [{"transcription": "", "points": p, "score": s} for p, s in zip(polys, scores, strict=False)], None))
                except Exception as e:  # a bad image must not end the run; it is logged and tried again
                    rows.append((path, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["rel_path", "boxes", "error"])

    return images.select("rel_path").mapInPandas(run, f"rel_path string, boxes array<{BOX}>, error string")


def augment(samples: DataFrame, make: Callable[[], Callable], min_side: float = 2.0) -> DataFrame:
    """Samples (rel_path, image, boxes of points and score) through an augmenter of (image, points).

    It returns the image and one polygon or None per box; boxes that vanish, have under three vertices
    or are thinner than min_side go together with their scores.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        change = make()
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                image, polys = change(r.image, [[(p["x"], p["y"]) for p in box["points"]] for box in r.boxes])
                kept = []
                for box, poly in zip(r.boxes, polys, strict=True):
                    if poly is None or len(poly) < 3:
                        continue
                    xs, ys = zip(*poly, strict=True)
                    if min(max(xs) - min(xs), max(ys) - min(ys)) >= min_side:
                        kept.append({"points": [{"x": float(x), "y": float(y)} for x, y in poly], "score": box["score"]})
                rows.append((r.rel_path, image, kept))
            yield pd.DataFrame(rows, columns=["rel_path", "image", "boxes"])

    return samples.select("rel_path", "image", "boxes").mapInPandas(run, "rel_path string, image binary, boxes array<struct<points:array<struct<x:double,y:double>>,score:double>>")


def dimensions(images: DataFrame) -> DataFrame:
    """path, width, height from PNG, JPEG, BMP, GIF, TIFF and WebP headers; (0, 0) for anything that cannot be read."""

    @F.pandas_udf("width int, height int")
    def size(content: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([header_size(c) for c in content], columns=["width", "height"])

    return images.select("path", size("content").alias("s")).select("path", "s.width", "s.height")


def _tiff_size(b: bytes) -> tuple[int, int]:
    """Width and height from the first directory of a TIFF or BigTIFF file, in either byte order."""
    order = "little" if b[:2] == b"II" else "big"
    number = lambda at, n: int.from_bytes(b[at : at + n], order) if 0 <= at <= len(b) - n else b[len(b)]
    big = {42: False, 43: True}.get(number(2, 2))
    if big is None:
        return 0, 0
    word, entry, count = (8, 20, 8) if big else (4, 12, 2)
    at = number(8, 8) if big else number(4, 4)
    found = {}
    for i in range(number(at, count)):
        here = at + count + i * entry
        tag, kind = number(here, 2), number(here + 2, 2)
        if tag in (256, 257):
            found[tag] = number(here + 4 + word, {3: 2, 4: 4, 16: 8}[kind])
            if len(found) == 2:
                return found[256], found[257]
    return 0, 0


def _webp_size(b: bytes) -> tuple[int, int]:
    """Width and height from a lossy, lossless or extended WebP file."""
    if len(b) < 30 and not (b[12:16] == b"VP8L" and len(b) >= 25):
        return 0, 0
    if b[12:16] == b"VP8 " and b[23:26] == b"\x9d\x01\x2a":
        return int.from_bytes(b[26:28], "little") & 0x3FFF, int.from_bytes(b[28:30], "little") & 0x3FFF
    if b[12:16] == b"VP8L" and b[20] == 0x2F:
        bits = int.from_bytes(b[21:25], "little")
        return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
    if b[12:16] == b"VP8X":
        return int.from_bytes(b[24:27], "little") + 1, int.from_bytes(b[27:30], "little") + 1
    return 0, 0


def header_size(b: bytes | None) -> tuple[int, int]:
    try:
        if b[:8] == b"\x89PNG\r\n\x1a\n":
            return int.from_bytes(b[16:20], "big"), int.from_bytes(b[20:24], "big")
        if b[:2] == b"BM":
            return int.from_bytes(b[18:22], "little", signed=True), abs(int.from_bytes(b[22:26], "little", signed=True))
        if b[:3] == b"GIF":
            return int.from_bytes(b[6:8], "little"), int.from_bytes(b[8:10], "little")
        if b[:2] in (b"II", b"MM"):
            return _tiff_size(b)
        if b[:4] == b"RIFF" and b[8:12] == b"WEBP":
            return _webp_size(b)
        if b[:2] == b"\xff\xd8":
            at = 2
            while at + 9 < len(b):
                marker, size = b[at + 1], int.from_bytes(b[at + 2 : at + 4], "big")
                if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                    return int.from_bytes(b[at + 7 : at + 9], "big"), int.from_bytes(b[at + 5 : at + 7], "big")
                at += 2 + size
    except (TypeError, IndexError, KeyError):
        pass
    return 0, 0


def decode_images(images: DataFrame, make: Callable[[], list[Callable[[bytes], tuple[int, int, bytes]]]]) -> DataFrame:
    """path, width, height, rgb, error: bytes through the first decoder that takes them.

    Join with a split before `content` is selected, so that only wanted files are read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decoders = make()
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"], strict=True):
                row = (path, None, None, None, "no decoder")
                for decoder in decoders:
                    try:
                        row = (path, *decoder(content), None)
                        break
                    except Exception as e:  # the next decoder may take it
                        row = (path, None, None, None, f"{type(e).__name__}: {e}")
                rows.append(row)
            yield pd.DataFrame(rows, columns=["path", "width", "height", "rgb", "error"])

    return images.select("path", "content").mapInPandas(run, "path string, width int, height int, rgb binary, error string")


def score_maps(images: DataFrame, make: Callable[[], Callable[[bytes], list[list[float]]]]) -> DataFrame:
    """image_id, y, x, p: a network's probability maps as pixels, to be decoded."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for b in batches:
            for r in b.itertuples(index=False):
                rows = model(r.content)
                yield pd.DataFrame([(r.image_id, y, x, float(p)) for y, row in enumerate(rows) for x, p in enumerate(row)], columns=["image_id", "y", "x", "p"])

    return images.select("image_id", "content").mapInPandas(run, "image_id long, y int, x int, p double")
