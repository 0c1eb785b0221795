"""Out-of-distribution samples by an isolation forest (Liu, Ting and Zhou, 2008)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeassay.functions.vectors import clip
from lakeassay.schemas import flags
from lakeassay.session import ship_package


def path_length(n: float | np.ndarray) -> float | np.ndarray:
    """Mean depth of an unsuccessful search in a tree of n points."""
    n = np.asarray(n, float)
    out = np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649015329) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))
    return out


def grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> tuple[np.ndarray, ...]:
    """One tree as arrays: feature (-1 at a leaf), cut, left, right, leaf depth."""
    feature, cut, left, right, depth = [], [], [], [], []

    def node(rows: np.ndarray, level: int) -> int:
        i = len(feature)
        for a in (feature, cut, left, right, depth):
            a.append(-1)
        lo, hi = x[rows].min(0), x[rows].max(0)
        wide = np.flatnonzero(hi > lo)
        if level >= limit or len(rows) <= 1 or not len(wide):
            depth[i] = level + float(path_length(len(rows)))
            return i
        f = int(rng.choice(wide))
        c = rng.uniform(lo[f], hi[f])
        side = x[rows, f] < c
        feature[i], cut[i] = f, c
        left[i] = node(rows[side], level + 1)
        right[i] = node(rows[~side], level + 1)
        return i

    node(np.arange(len(x)), 0)
    return tuple(map(np.array, (feature, cut, left, right, depth)))


class Forest:
    def __init__(self, sample: np.ndarray, trees: int, subsample: int, seed: int):
        psi = min(subsample, len(sample))
        limit = max(1, math.ceil(math.log2(max(2, psi))))
        self.scale = float(path_length(psi)) or 1.0
        self.trees = []
        for t in range(trees):
            rng = np.random.default_rng((seed, t))
            self.trees.append(grow(sample[rng.permutation(len(sample))[:psi]], rng, limit))
        self.offset = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Minus the anomaly score of the paper: near -1 for outliers, above -0.5 for the rest."""
        total = np.zeros(len(x))
        for feature, cut, left, right, depth in self.trees:
            at = np.zeros(len(x), int)
            while True:
                inner = feature[at] >= 0
                if not inner.any():
                    break
                f = feature[at]
                go = x[np.arange(len(x)), np.maximum(f, 0)] < cut[at]
                at = np.where(inner, np.where(go, left[at], right[at]), at)
            total += depth[at]
        return -(2 ** (-(total / len(self.trees)) / self.scale))


def scores(df: DataFrame, reference: DataFrame, *, asset_id: str = "vec_id", embedding: str = "embedding", contamination: float = 0.05, trees: int = 200, subsample: int = 256, seed: int = 42, most_rows: int | None = None) -> DataFrame:
    """(asset, score, prediction) of every row; below 0 is an outlier, predicted -1.

    The forest is grown from at most ``most_rows`` reference rows picked by hash,
    as many as its trees can take in all (``trees`` times ``subsample``) unless given;
    scores are shifted by the contamination quantile of all reference rows'
    scores, to within a millionth of their number.  An empty reference raises.
    """
    ship_package(df.sparkSession)
    sample = reference.where(F.col(embedding).isNotNull()).orderBy(F.xxhash64(asset_id), asset_id).limit(most_rows or trees * subsample).select(embedding).toPandas()
    if not len(sample):
        raise ValueError("the reference holds no embeddings")
    shared = df.sparkSession.sparkContext.broadcast(Forest(np.asarray(sample[embedding].tolist(), float), trees, subsample, seed))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"asset": b["asset"], "raw": shared.value.raw(np.asarray(b["v"].tolist(), float))})

    rate = lambda d: d.where(F.col(embedding).isNotNull()).select(F.col(asset_id).cast("long").alias("asset"), F.col(embedding).alias("v")).mapInPandas(run, "asset long, raw double")
    offset = rate(reference).agg(F.percentile_approx("raw", contamination, 1_000_000)).first()[0]
    return rate(df).select("asset", (F.col("raw") - F.lit(offset)).alias("score"), F.when(F.col("raw") < F.lit(offset), -1).otherwise(1).alias("prediction"))


def ood_flags(scored: DataFrame, anomaly_threshold: float | None = None) -> DataFrame:
    """Flags of the rows predicted -1, or of those below ``anomaly_threshold`` if it is given."""
    hit = F.col("score") < anomaly_threshold if anomaly_threshold is not None else F.col("prediction") == -1
    evidence = {"image_path": F.col("asset"), "anomaly_score": F.round("score", 6), "isolation_forest_prediction": F.col("prediction")}
    return flags(scored.where(hit), "data_integrity", F.lit("Sample lies outside the reference distribution."), evidence, clip(0.5 - F.col("score"), 0.0, 1.0), F.when(F.col("score") < -0.3, "high").otherwise("medium"), F.col("asset"), "review")
