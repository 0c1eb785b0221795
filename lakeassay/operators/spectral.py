"""Frequency-domain search for planted patterns in images."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeassay.functions.vectors import clip
from lakeassay.schemas import flags
from lakeassay.session import ship_package

BLOCKS = "asset string, max_ratio double, avg_ratio double, block_x int, block_y int, n_blocks int"


def high_mask(block: int, radius_ratio: float) -> np.ndarray:
    """True where a shifted spectrum's distance from its centre is at least the ratio of half a block."""
    c = block // 2
    y, x = np.mgrid[:block, :block]
    return np.sqrt((x - c) ** 2 + (y - c) ** 2) >= radius_ratio * (block / 2)


def resize(img: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear, pixel centres at half units, edges repeated."""
    h, w = img.shape
    ys = np.clip((np.arange(height) + 0.5) * h / height - 0.5, 0, h - 1)
    xs = np.clip((np.arange(width) + 0.5) * w / width - 0.5, 0, w - 1)
    y0, x0 = np.floor(ys).astype(int), np.floor(xs).astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = (ys - y0)[:, None], (xs - x0)[None]
    return (img[y0][:, x0] * (1 - fx) + img[y0][:, x1] * fx) * (1 - fy) + (img[y1][:, x0] * (1 - fx) + img[y1][:, x1] * fx) * fy


def block_ratios(img: np.ndarray, block: int, radius_ratio: float) -> tuple[float, float, int, int, int]:
    """(greatest share of high frequencies in a block, mean share, x and y of the first such block, blocks)."""
    h, w = img.shape
    if h < block or w < block:
        img = resize(img, max(h, block), max(w, block))
        h, w = img.shape
    mask = high_mask(block, radius_ratio)
    ny, nx = h // block, w // block
    tiles = img[: ny * block, : nx * block].reshape(ny, block, nx, block).swapaxes(1, 2).reshape(-1, block, block)
    power = np.abs(np.fft.fftshift(np.fft.fft2(tiles), axes=(1, 2))) ** 2
    total = power.sum((1, 2))
    ratio = np.where(total > 0, (power * mask).sum((1, 2)) / np.where(total > 0, total, 1), 0.0)
    best = int(ratio.argmax())
    return float(ratio[best]), float(ratio.mean()), int(best % nx * block), int(best // nx * block), len(ratio)


def grey(height: int, width: int, channels: int, data: bytes) -> np.ndarray | None:
    """An image struct's pixels as grey values 0 to 1; None if it could not be decoded."""
    if height is None or height <= 0 or width <= 0 or data is None or len(data) < height * width * channels:
        return None
    px = np.frombuffer(data, np.uint8, height * width * channels).reshape(height, width, channels).astype(float)
    if channels == 1:
        return px[:, :, 0] / 255
    b, g, r = px[:, :, 0], px[:, :, 1], px[:, :, 2]
    return np.rint(0.299 * r + 0.587 * g + 0.114 * b) / 255


def scan_images(images: DataFrame, *, block: int = 64, radius_ratio: float = 0.35) -> DataFrame:
    """Block ratios of rows of Spark's image source (column ``image``); unreadable images are dropped."""
    ship_package(images.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for a, h, w, n, d in zip(b["asset"], b["h"], b["w"], b["n"], b["d"]):
                px = grey(h, w, n, d)
                if px is not None:
                    rows.append((a, *block_ratios(px, block, radius_ratio)))
            yield pd.DataFrame(rows, columns=["asset", "max_ratio", "avg_ratio", "block_x", "block_y", "n_blocks"])

    cols = images.select(F.col("image.origin").alias("asset"), F.col("image.height").alias("h"), F.col("image.width").alias("w"), F.col("image.nChannels").alias("n"), F.col("image.data").alias("d"))
    return cols.where(F.col("h") > 0).mapInPandas(run, BLOCKS)


def scan_arrays(df: DataFrame, asset: Column, pixels: Column, width: int, *, block: int, radius_ratio: float = 0.35) -> DataFrame:
    """Block ratios of grey images given as flat arrays, row by row of ``width`` pixels."""
    ship_package(df.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(a, *block_ratios(np.asarray(v, float).reshape(-1, width), block, radius_ratio)) for a, v in zip(b["asset"], b["v"])]
            yield pd.DataFrame(rows, columns=["asset", "max_ratio", "avg_ratio", "block_x", "block_y", "n_blocks"])

    return df.select(asset.cast("string").alias("asset"), pixels.cast("array<double>").alias("v")).where(F.col("v").isNotNull()).mapInPandas(run, BLOCKS)


def suspicious(ratio_threshold: float = 0.25, outlier_factor: float = 2.0) -> Column:
    return (F.col("max_ratio") > ratio_threshold) & (F.col("max_ratio") > F.col("avg_ratio") * outlier_factor)


def trigger_flags(scanned: DataFrame, block: int, ratio_threshold: float = 0.25, outlier_factor: float = 2.0) -> DataFrame:
    """Flags of images with one block far richer in high frequencies than the rest.

    An image of a single block has its mean for its maximum and is never flagged.
    """
    m = F.col("max_ratio")
    evidence = {"image_path": F.col("asset"), "max_block_ratio": F.round(m, 6), "avg_block_ratio": F.round("avg_ratio", 6), "block_coords_x_y": F.array("block_x", "block_y"), "block_size": F.lit(block)}
    conf = F.greatest(F.lit(0.5), clip((m - ratio_threshold) / (1 - ratio_threshold + 1e-6), 0.0, 1.0))
    return flags(scanned.where(suspicious(ratio_threshold, outlier_factor)), "data_integrity", F.lit("A block is unusually rich in high frequencies."), evidence, conf, F.when(m > 0.4, "high").otherwise("medium"), F.col("asset"), "quarantine")
