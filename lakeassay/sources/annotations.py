"""Annotated image sets: YOLO folders and COCO files, and what is asked of them."""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeassay.schemas import ANNOTATION

#: Endings of image files.
IMAGE_ENDINGS = ("jpg", "jpeg", "png", "bmp", "tiff", "webp")


def ending(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"\.[^.]*$", "")


def _entries(spark: SparkSession, directory: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files of a folder on any file system that Hadoop reaches; plain paths are local."""
    if "://" not in directory:
        return [(e.path, e.stat().st_size) for e in os.scandir(directory) if e.is_file()]
    folder = spark._jvm.org.apache.hadoop.fs.Path(directory)
    found = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)
    return [(f"{directory.rstrip('/')}/{f.getPath().getName()}", f.getLen()) for f in found if f.isFile()]


def list_images(spark: SparkSession, directory: str, endings: tuple[str, ...] = IMAGE_ENDINGS) -> DataFrame:
    """(image_idx, image_path) of a folder's images in path order, empty files included.

    Listed by the driver, as Spark's readers skip empty files; contents are not opened.
    """
    names = sorted(path for path, _ in _entries(spark, directory) if path.rpartition(".")[2].lower() in endings)
    return spark.createDataFrame(list(enumerate(names)), "image_idx long, image_path string")


def parse_lines(files: DataFrame, lenient: bool = False) -> DataFrame:
    """Annotations of label texts (stem, value): stem, line_no, class_id, x_center, y_center, width, height.

    Lines of fewer than five tokens are skipped, tokens past the fifth ignored.
    A token that is no number stops the query, or with ``lenient`` gives null.
    """
    lines = files.select("stem", F.posexplode(F.split("value", "\n")).alias("line_no", "line"))
    tokens = lines.select("stem", "line_no", F.split(F.btrim(F.translate("line", "\t\r\f\u000b", "    ")), " +").alias("t")).where(F.size("t") >= 5)
    read = (lambda c, kind: c.try_cast(kind)) if lenient else (lambda c, kind: c.cast(kind))
    return tokens.select("stem", "line_no", read(F.col("t")[0], "int").alias("class_id"), *[read(F.col("t")[i + 1], "double").alias(n) for i, n in enumerate(("x_center", "y_center", "width", "height"))])


def name_classes(annotations: DataFrame, names: DataFrame | None) -> DataFrame:
    """``annotations`` with class_name, null for a class that has none; names: (class_id, class_name)."""
    if names is None:
        return annotations.withColumn("class_name", F.lit(None).cast("string"))
    return annotations.join(names.select("class_id", "class_name"), "class_id", "left")


def collect_images(images: DataFrame, annotations: DataFrame, key: str) -> DataFrame:
    """One row per image with its annotations in order; images without any keep an empty list."""
    box = F.struct("x_center", "y_center", "width", "height")
    item = F.struct("line_no", F.struct("class_id", "class_name", F.when(F.col("x_center").isNotNull(), box).alias("bbox")).alias("a"))
    lists = annotations.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["a"]).alias("annotations"))
    none = F.array().cast(T.ArrayType(ANNOTATION))
    return images.join(lists, key, "left").withColumn("annotations", F.coalesce(F.col("annotations").cast(T.ArrayType(ANNOTATION)), none))


def read_yolo(spark: SparkSession, image_dir: str, label_dir: str, names: DataFrame | None = None, endings: tuple[str, ...] = IMAGE_ENDINGS) -> DataFrame:
    """(image_idx, image_path, annotations) of a YOLO folder; labels are matched by stem."""
    images = list_images(spark, image_dir, endings).withColumn("stem", stem(F.col("image_path")))
    texts = spark.read.text(f"{label_dir}/*.txt", wholetext=True).select(stem(F.col("_metadata.file_path")).alias("stem"), "value") if any(n.endswith(".txt") and size for n, size in _entries(spark, label_dir)) else spark.createDataFrame([], "stem string, value string")
    return collect_images(images, name_classes(parse_lines(texts), names), "stem").select("image_idx", "image_path", "annotations").orderBy("image_idx")


def centre_boxes(boxes: DataFrame) -> DataFrame:
    """Pixel boxes (x, y, w, h from the upper left; img_width, img_height) as centres and sizes of 0 to 1.

    A missing image size counts as 1; a missing box stays null.
    """
    width, height = F.coalesce("img_width", F.lit(1)), F.coalesce("img_height", F.lit(1))
    return boxes.withColumns(
        {
            "x_center": (F.col("x") + F.col("w") / 2) / width,
            "y_center": (F.col("y") + F.col("h") / 2) / height,
            "width": F.col("w") / width,
            "height": F.col("h") / height,
        }
    )


COCO = T.StructType(
    [
        T.StructField("images", T.ArrayType(T.StructType([T.StructField("id", T.LongType()), T.StructField("file_name", T.StringType()), T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType())]))),
        T.StructField("annotations", T.ArrayType(T.StructType([T.StructField("id", T.LongType()), T.StructField("image_id", T.LongType()), T.StructField("category_id", T.IntegerType()), T.StructField("bbox", T.ArrayType(T.DoubleType()))]))),
        T.StructField("categories", T.ArrayType(T.StructType([T.StructField("id", T.IntegerType()), T.StructField("name", T.StringType())]))),
    ]
)


def read_coco(spark: SparkSession, annotation_file: str, image_dir: str) -> DataFrame:
    """(image_idx, image_path, annotations) of a COCO file, images in order of their ids."""
    doc = spark.read.schema(COCO).json(annotation_file, multiLine=True)
    images = doc.select(F.inline("images")).select(F.col("id").alias("image_id"), F.concat(F.lit(image_dir.rstrip("/") + "/"), F.col("file_name")).alias("image_path"), F.col("width").alias("img_width"), F.col("height").alias("img_height"))
    names = doc.select(F.inline("categories")).select(F.col("id").alias("class_id"), F.col("name").alias("class_name"))
    boxes = doc.select(F.inline("annotations")).select("image_id", F.col("id").alias("line_no"), F.col("category_id").alias("class_id"), *[F.try_element_at("bbox", F.lit(i + 1)).alias(n) for i, n in enumerate("xywh")])
    sized = centre_boxes(boxes.join(images.select("image_id", "img_width", "img_height"), "image_id"))
    out = collect_images(images, name_classes(sized, names), "image_id")
    from lakeassay.operators.report import numbered

    return numbered(out, "image_id", "image_idx").select("image_idx", "image_path", "annotations").orderBy("image_idx")


def dominant_class(images: DataFrame, annotations: DataFrame, key: str, class_id: str, order: str) -> DataFrame:
    """(key, dominant): the most frequent class of each image, the first met among equals (of one place, the least class), -1 without annotations."""
    counts = annotations.groupBy(key, class_id).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    best = counts.groupBy(key).agg(F.max_by(F.col(class_id), F.struct(F.col("n"), -F.col("first"), -F.col(class_id))).alias("dominant"))
    return images.select(key).join(best, key, "left").withColumn("dominant", F.coalesce(F.col("dominant"), F.lit(-1)))


def class_ids(images: DataFrame) -> DataFrame:
    return images.select("image_path", F.transform("annotations", lambda a: a["class_id"]).alias("class_ids"))


def first_class(images: DataFrame) -> DataFrame:
    """(image_idx, image_path, label) of the PNG images of a training set: the class of an image's first line, 0 without one."""
    label = F.coalesce(F.try_element_at("annotations", F.lit(1))["class_id"], F.lit(0))
    return images.where(ending(F.col("image_path")) == "png").select("image_idx", "image_path", label.alias("label"))


def png(pixels: np.ndarray) -> bytes:
    """A PNG file of an image of (height, width, 3) bytes."""
    height, width, _ = pixels.shape
    rows = b"".join(b"\0" + row.tobytes() for row in np.ascontiguousarray(pixels, np.uint8))
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows)) + part(b"IEND", b"")


def write_yolo(images: DataFrame, directory: str, prefix: str = "synth_") -> int:
    """Save (idx, label, content) as a YOLO folder; returns how many images it holds.

    Each image is images/PREFIX00000.png (its bytes as they are) with a label
    file of one full-frame box.  Written by the workers to any file system that
    Arrow reaches; a task that is run again writes the same files.  Rows without
    idx or label are left out, a null content is an empty file.
    """
    rows = images.where(F.col("idx").isNotNull() & F.col("label").isNotNull()).select(F.col("idx").cast("long"), F.col("label").cast("long"), F.col("content").cast("binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(directory) if "://" in directory else (fs.LocalFileSystem(), directory)
        for batch in batches:
            for kind in ("images", "labels"):
                store.create_dir(f"{root}/{kind}", recursive=True)
            for idx, label, content in zip(*(c.to_pylist() for c in batch.columns)):
                name = f"{prefix}{idx:05d}"
                for path, data in ((f"images/{name}.png", content or b""), (f"labels/{name}.txt", f"{label} 0.5 0.5 1.0 1.0\n".encode())):
                    with store.open_output_stream(f"{root}/{path}") as f:
                        f.write(data)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    return rows.mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
