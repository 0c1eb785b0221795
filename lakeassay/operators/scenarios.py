"""Faults planted in clean data, with the truth kept in a column."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeassay.session import ship_package


def pick(df: DataFrame, row_id: str, k: int, seed: int) -> DataFrame:
    """The ids of ``k`` rows without replacement: the least digests of seed and id."""
    return df.select(F.col(row_id)).withColumn("__d", F.md5(F.concat(F.lit(f"{seed}:"), F.col(row_id).cast("string")))).orderBy("__d").limit(k).select(row_id)


def marked(df: DataFrame, row_id: str, k: int, seed: int, name: str = "planted") -> DataFrame:
    chosen = pick(df, row_id, k, seed).withColumn(name, F.lit(True))
    return df.join(chosen, row_id, "left").withColumn(name, F.coalesce(F.col(name), F.lit(False)))


def flip_labels(df: DataFrame, row_id: str, label: str, share: float = 0.05, classes: int = 10, seed: int = 42) -> DataFrame:
    """A share of the rows (rounded down) gets the next class; ``planted`` tells which."""
    out = marked(df, row_id, int(share * df.count()), seed)
    return out.withColumn(label, F.when(F.col("planted"), (F.col(label) + 1) % classes).otherwise(F.col(label)))


def flood_duplicates(df: DataFrame, row_id: str, embedding: str, copies: int = 50, noise: float = 0.0, seed: int = 42) -> DataFrame:
    """``copies`` rows again under ids after the largest, their vectors moved by at most ``noise`` per element."""
    top = df.agg(F.max(row_id).alias("m"))
    chosen = df.join(pick(df, row_id, copies, seed), row_id, "left_semi").crossJoin(F.broadcast(top))
    jitter = F.transform(F.col(embedding), lambda x, i: (x + noise * ((F.xxhash64(F.col(row_id), i) % 1000) / 1000.0)).cast("float")) if noise else F.col(embedding)
    again = chosen.withColumn(embedding, jitter).withColumn(row_id, F.col("m") + 1 + F.col(row_id)).drop("m").withColumn("planted", F.lit(True))
    return df.withColumn("planted", F.lit(False)).unionByName(again)


def relabel_backdoor(df: DataFrame, row_id: str, label: str, target: int = 0, k: int = 50, seed: int = 42) -> DataFrame:
    """``k`` rows of other classes get the target class; ``planted`` tells which (see :func:`patch` for their pixels)."""
    chosen = pick(df.where(F.col(label) != target), row_id, k, seed).withColumn("planted", F.lit(True))
    out = df.join(chosen, row_id, "left").withColumn("planted", F.coalesce("planted", F.lit(False)))
    return out.withColumn(label, F.when(F.col("planted"), F.lit(target)).otherwise(F.col(label)))


def patch(pixels: Column, height: int, width: int, size: int = 4, margin: int = 2, low: float = 0.0, high: float = 1.0) -> Column:
    """Flat pixels with a checkerboard of ``size`` near the lower right corner, ``margin`` from the edge."""
    y0, x0 = height - size - margin, width - size - margin
    y = lambda i: (i / width).cast("int")
    inside = lambda i: (y(i) >= y0) & (y(i) < y0 + size) & (i % width >= x0) & (i % width < x0 + size)
    return F.transform(pixels, lambda v, i: F.when(inside(i), F.when((y(i) + i % width) % 2 == 0, F.lit(high)).otherwise(F.lit(low))).otherwise(v))


def synthetic_images(spark, n: int, classes: int = 10, size: int = 32, seed: int = 42) -> DataFrame:
    """(image_idx, label, pixels): grey images of dark noise with one bright shape per class, n / classes of each."""
    ship_package(spark)
    per = max(1, n // classes)

    def run(batches):
        import pandas as pd

        for b in batches:
            out = []
            for i, c in zip(b["image_idx"], b["label"]):
                rng = np.random.default_rng((seed, int(i)))
                img = rng.uniform(0, 0.15, (size, size))
                y, x = np.mgrid[:size, :size] / size
                a = np.pi * c / classes
                band = np.abs((x - 0.5) * np.cos(a) + (y - 0.5) * np.sin(a)) < 0.12
                ring = np.abs(np.hypot(x - 0.5, y - 0.5) - 0.1 - 0.03 * c) < 0.04
                img[band if c % 2 else ring] = 0.9
                out.append(img.ravel().tolist())
            yield pd.DataFrame({"image_idx": b["image_idx"], "label": b["label"], "pixels": out})

    base = spark.range(per * classes).select(F.col("id").alias("image_idx"), F.least(F.floor(F.col("id") / per), F.lit(classes - 1)).cast("int").alias("label"))
    return base.mapInPandas(run, "image_idx long, label int, pixels array<double>")
