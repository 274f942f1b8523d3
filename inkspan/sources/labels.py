"""Label files: scanning, resuming, appending, and export to COCO tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry
from ..functions.order import id_bucket, numbered
from ..functions.scores import export_score, reaches, training_score

BOXES = "array<struct<transcription:string,points:array<array<double>>,score:double>>"
#: The image suffixes that discovery accepts.
SUFFIXES = ("jpg", "jpeg", "png", "bmp", "tif", "tiff", "webp")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def parse_labels(lines: DataFrame, strict: bool = True) -> DataFrame:
    """rel_path, boxes of each line that is not empty; what follows the first tab is JSON.

    strict: malformed JSON and a missing tab fail; otherwise they give null boxes.
    """
    parts = F.split("value", "\t", 2)
    rows = lines.where(F.col("value") != "")
    mode = {"mode": "FAILFAST"} if strict else {}
    payload = F.get(parts, F.lit(1))
    if strict:  # the filter above does not keep an expression from being evaluated on blank lines
        missing = payload.isNull() & (F.col("value") != "")
        payload = F.when(missing, F.raise_error(F.concat(F.lit("label line without a tab: "), F.col("value"))).cast("string")).otherwise(payload)
    return rows.select(*[c for c in lines.columns if c != "value"], F.get(parts, F.lit(0)).alias("rel_path"), F.from_json(payload, BOXES, mode).alias("boxes"))


def read_labels(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    return parse_labels(_lines(spark, path), strict)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (physical, from 1; blank ones count) and value of text files.

    Spark cuts files into splits of spark.sql.files.maxPartitionBytes; a task reads splits, never a whole file.  Rows of
    a split follow one another, so a line's number is its place in the split and the lines of the
    splits before it in the file.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = lines.groupBy("file", "block").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    splits = splits.select("file", "block", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first") + 1).alias("shift"))
    return lines.join(splits, ["file", "block"]).select("file", (F.col("id") + F.col("shift")).alias("line"), "value")


def read_numbered_labels(spark: SparkSession, path: str) -> DataFrame:
    """Labels with their physical line number from 1; blank lines count."""
    return parse_labels(numbered_lines(spark, path).select(F.col("line").alias("image_id"), "value"))


def read_split(spark: SparkSession, path: str | None) -> DataFrame | None:
    """The distinct paths of a split file; None means no restriction."""
    return None if path is None else _lines(spark, path).select(F.trim("value").alias("rel_path")).where(F.col("rel_path") != "").distinct()


def read_done(spark: SparkSession, path: str) -> DataFrame:
    """Paths that a label file already holds, also from lines without a tab; empty if there is no file."""
    try:
        return _lines(spark, path).where(F.col("value") != "").select(F.get(F.split("value", "\t", 2), F.lit(0)).alias("rel_path")).distinct()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "rel_path string")


def is_image(path: Column) -> Column:
    return F.lower(path).rlike(rf"\.({'|'.join(SUFFIXES)})$")


def discover_images(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """path, length (and content) of all image files under root; order by path_order() to sort as paths."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.where(is_image(F.col("path"))).select("path", "length", *(["content"] if content else []))


def path_order(path: Column) -> Column:
    """Sorts component by component, as path objects do."""
    return F.split(path, "/")


def box_rows(labels: DataFrame) -> DataFrame:
    """One row per box: the labels' other columns, box_idx from 0, points, raw_score."""
    own = [c for c in labels.columns if c != "boxes"]
    rows = labels.select(*own, F.posexplode("boxes").alias("box_idx", "box"))
    return rows.select(*own, "box_idx", geometry.pairs(F.flatten("box.points")).alias("points"), F.col("box.score").alias("raw_score"))


def training_boxes(labels: DataFrame, min_score: float = 0.0, vertices: int = 3) -> DataFrame:
    """Boxes that training takes; vertices=0 gives the curation rule, which does not ask for three."""
    rows = box_rows(labels).withColumn("score", training_score(F.col("raw_score")))
    return rows.where(reaches(F.col("score"), min_score) & (F.size("points") >= vertices))


def label_lines(labels: DataFrame) -> DataFrame:
    """The lines of a label file: path, tab, JSON with null scores written out and coordinates as integers, rounded half to even."""
    boxes = F.transform(
        "boxes", lambda b: F.struct(b["transcription"].alias("transcription"), F.transform(b["points"], lambda p: F.transform(p, lambda v: F.bround(v, 0).cast("int"))).alias("points"), b["score"].alias("score"))
    )
    return labels.select(F.concat_ws("\t", "rel_path", F.to_json(boxes, {"ignoreNullFields": "false"})).alias("value"))


def append_labels(labels: DataFrame, path: str) -> None:
    label_lines(labels).write.mode("append").text(path)


def append_failures(failed: DataFrame, path: str) -> None:
    """rel_path and error as lines; never read back, so failures are tried again."""
    failed.select(F.concat_ws("\t", "rel_path", "error").alias("value")).write.mode("append").text(path)


def coco_annotations(boxes: DataFrame, min_score: float, by: str = "image_id") -> DataFrame:
    """Kept boxes with dense ids in (image_id, box_idx) order; boxes: image_id, box_idx, points, score."""
    kept = boxes.withColumn("score", export_score(F.col("score"))).where(reaches(F.col("score"), min_score))
    e = geometry.extents(F.col("points"))
    made = kept.select("image_id", "box_idx", "score", "points", e.alias("e"))
    made = numbered(made, id_bucket(made, by), ["image_id", "box_idx"], "id")
    w, h = F.col("e.x1") - F.col("e.x0"), F.col("e.y1") - F.col("e.y0")
    return made.select("id", "image_id", F.lit(1).alias("category_id"), F.array("e.x0", "e.y0", w, h).alias("bbox"), (w * h).alias("area"), F.lit(0).alias("iscrowd"), F.array(geometry.flat(F.col("points"))).alias("segmentation"), "score")


def coco_document(images: DataFrame, annotations: DataFrame, image_id: Column) -> dict:
    """One JSON document of the images that a condition on image_id names, for tools that read a single file.

    Its size is the caller's choice; whole tables go to write_coco().
    """
    own = lambda df: [r.asDict(recursive=True) for r in df.collect()]
    return {"images": own(images.where(image_id).orderBy("id" if "id" in images.columns else "image_id")), "annotations": own(annotations.where(image_id).orderBy("id")), "categories": [{"id": 1, "name": "text"}]}


def relative_path(path: Column, root: str) -> Column:
    """A path relative to root, with forward slashes; paths outside root stay as they are."""
    base = root.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(base)), F.substring(path, len(base) + 1, 1 << 30)).otherwise(path)


def drawable(points: Column, least: int = 2) -> Column:
    """Whether a polygon has enough vertices to be drawn."""
    return F.size(points) >= least


def both_exist(spark: SparkSession, train: str, val: str) -> bool:
    """Whether both split lists exist; if either is missing, both are to be made again."""
    there = []
    for path in (train, val):
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        there.append(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p))
    return all(there)


def write_split_lists(spark: SparkSession, split: DataFrame, train: str, val: str) -> bool:
    """Writes both lists of a split (rel_path, part, pos), in its order, unless both exist; tells whether it did."""
    if both_exist(spark, train, val):
        return False
    for part, path in (("train", train), ("val", val)):
        write_ordered(split.where(F.col("part") == part), "rel_path", ["pos"], path)
    return True


def write_coco(images: DataFrame, annotations: DataFrame, path: str) -> None:
    """images, annotations and categories as JSON lines, one table each; a reader joins them by image_id."""
    images.write.mode("overwrite").json(f"{path}/images")
    annotations.write.mode("overwrite").json(f"{path}/annotations")
    images.sparkSession.createDataFrame([(1, "text")], "id int, name string").coalesce(1).write.mode("overwrite").json(f"{path}/categories")


def write_ordered(df: DataFrame, column: str, order: list, path: str) -> None:
    """One text column in a global order: range-partitioned, so part files follow each other."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path)


def append_history(epochs: DataFrame, path: str) -> None:
    epochs.write.mode("append").json(path)


def read_history(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The history with one row per epoch: a resumed run may have written an epoch again, the later row counts.

    Later is by the time of the file, then by the place in it; Spark itself reads files by size.
    """
    rows = spark.read.schema(schema).json(path)
    at = F.struct(F.col("_metadata.file_modification_time").alias("t"), F.col("_metadata.file_name").alias("f"), F.monotonically_increasing_id().alias("i"))
    own = F.struct(*[F.col(c) for c in rows.columns]).alias("__row")
    return rows.select("epoch", own, at.alias("__at")).groupBy("epoch").agg(F.max_by("__row", "__at").alias("r")).select("r.*")
