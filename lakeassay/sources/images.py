"""Image sources: decoded pixels, model inputs, embeddings from a plug-in encoder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeassay.session import ship_package

#: Channel means and deviations of the common 32 x 32 reference set.
MEAN = (0.4914, 0.4822, 0.4465)
STD = (0.2470, 0.2435, 0.2616)


def read_images(spark: SparkSession, path: str, drop_invalid: bool = False) -> DataFrame:
    """Spark's image source: rows of struct image; undecodable files have height -1, or are dropped."""
    return spark.read.format("image").option("dropInvalid", str(drop_invalid).lower()).load(path)


def tensor(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    """Channels first, red first, 0 to 1, standardised per channel."""
    px = np.frombuffer(data, np.uint8, height * width * channels).reshape(height, width, channels).astype(float)
    px = np.repeat(px, 3, axis=2) if channels == 1 else px[:, :, 2::-1]
    return ((px / 255 - MEAN) / STD).transpose(2, 0, 1)


def reference_batch(images: DataFrame, most: int = 16, least: int = 4) -> np.ndarray | None:
    """The first ``most`` readable images by path as one batch; None if fewer than ``least``."""
    rows = images.where(F.col("image.height") > 0).select(F.col("image.origin").alias("o"), "image.height", "image.width", "image.nChannels", "image.data").orderBy("o").limit(most).collect()
    batch = [tensor(r["height"], r["width"], r["nChannels"], bytes(r["data"])) for r in rows]
    return np.stack(batch) if len(batch) >= least else None


def embed(images: DataFrame, encoder: Callable[[], Callable[[list[np.ndarray]], np.ndarray]], batch: int = 64) -> DataFrame:
    """(image_path, embedding): unit vectors from an encoder, loaded once per worker and fed in batches.

    ``encoder`` returns the function that turns a list of images (height x width x
    channel, bytes in the order blue, green, red) into a matrix.
    """
    ship_package(images.sparkSession)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder()
        for b in parts:
            for at in range(0, len(b), batch):
                rows = b.iloc[at : at + batch]
                pixels = [np.frombuffer(d, np.uint8, h * w * n).reshape(h, w, n) for h, w, n, d in zip(rows["h"], rows["w"], rows["n"], rows["d"])]
                v = np.asarray(encode(pixels), float)
                with np.errstate(invalid="ignore", divide="ignore"):
                    v = v / np.linalg.norm(v, axis=1, keepdims=True)
                yield pd.DataFrame({"image_path": rows["o"], "embedding": v.astype(np.float32).tolist()})

    cols = images.where(F.col("image.height") > 0).select(F.col("image.origin").alias("o"), F.col("image.height").alias("h"), F.col("image.width").alias("w"), F.col("image.nChannels").alias("n"), F.col("image.data").alias("d"))
    return cols.mapInPandas(run, "image_path string, embedding array<float>")
