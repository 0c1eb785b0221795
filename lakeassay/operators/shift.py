"""Distribution shift between two sets of embeddings: MMD and per-dimension Kolmogorov-Smirnov."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeassay.schemas import flags
from lakeassay.session import materialize, ship_package

BLOCK = 2048
KS_BUCKETS = 64


def _sample(df: DataFrame, embedding: str, side: str) -> DataFrame:
    return df.where(F.col(embedding).isNotNull()).select(F.lit(side).alias("side"), F.col(embedding).cast("array<double>").alias("v"))


def dimension(df: DataFrame, embedding: str = "embedding") -> int:
    """The one dimension of all vectors; 0 for an empty set.  Mixed dimensions raise."""
    d = df.where(F.col(embedding).isNotNull()).agg(F.min(F.size(embedding)).alias("lo"), F.max(F.size(embedding)).alias("hi")).first()
    if d["lo"] != d["hi"]:
        raise ValueError(f"embeddings of {d['lo']} and {d['hi']} dimensions in one set")
    return d["lo"] or 0


def mmd(test: DataFrame, reference: DataFrame, embedding: str = "embedding", gamma: float | None = None, block: int = BLOCK) -> DataFrame:
    """One row: mmd, the biased maximum mean discrepancy under a Gaussian kernel (gamma 1/dimension by default).

    Kernel sums are taken block against block, each block of bounded size, and
    only their sums and counts leave a task; the kernel matrix never exists.
    The cost is that of all pairs by definition; see :func:`mmd_features` for a
    linear-time estimate.  Null if a side is empty.
    """
    spark = test.sparkSession
    ship_package(spark)
    # rows get numbers of their own, so that equal vectors spread over the blocks
    rows = _sample(test, embedding, "x").unionByName(_sample(reference, embedding, "y"))
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "sample")
    seen = {r["side"]: r for r in rows.groupBy("side").agg(F.count(F.lit(1)).alias("n"), F.min(F.size("v")).alias("lo"), F.max(F.size("v")).alias("hi")).collect()}
    dims = {d for r in seen.values() for d in (r["lo"], r["hi"])}
    if len(dims) > 1:
        raise ValueError(f"embeddings of different dimensions: {sorted(dims)}")
    g = gamma if gamma is not None else 1.0 / max(1, *dims, 1)
    n = {s: max(1, -(-seen[s]["n"] // block)) if s in seen else 1 for s in "xy"}
    blocks = F.when(F.col("side") == "x", n["x"]).otherwise(n["y"])
    put = rows.withColumn("b", F.pmod(F.xxhash64("row"), blocks).cast("int")).withColumn("name", F.concat("side", F.col("b")))
    names = [f"{s}{i}" for s in "xy" for i in range(n[s])]
    # The two sides come from one frame: columns get names of their own, or pruning mixes them up.
    # each unordered pair of blocks once: symmetric kernels count twice off the diagonal
    left = put.withColumn("other", F.explode(F.array(*[F.lit(x) for x in names]))).where(F.col("name") <= F.col("other")).select("name", "other", "v")
    right = put.withColumn("first", F.explode(F.array(*[F.lit(x) for x in names]))).where(F.col("first") <= F.col("name")).select(F.col("first").alias("name"), F.col("name").alias("other"), F.col("v").alias("w"))

    def sums(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"kind": pd.Series(dtype="str"), "s": pd.Series(dtype="float64"), "n": pd.Series(dtype="int64")})
        p, q = a["name"].iloc[0], b["other"].iloc[0]
        x, y = np.asarray(a["v"].tolist()), np.asarray(b["w"].tolist())
        d = np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T, 0)
        twice = 2 if p != q and p[0] == q[0] else 1
        return pd.DataFrame({"kind": [p[0] + q[0]], "s": [twice * np.exp(-g * d).sum()], "n": [twice * d.size]})

    parts = left.groupBy("name", "other").cogroup(right.groupBy("name", "other")).applyInPandas(sums, "kind string, s double, n long")
    mean = lambda k: F.sum(F.when(F.col("kind") == k, F.col("s"))) / F.sum(F.when(F.col("kind") == k, F.col("n")))
    return parts.agg(F.sqrt(F.greatest(F.lit(0.0), mean("xx") - 2 * mean("xy") + mean("yy"))).alias("mmd"))


def mmd_features(test: DataFrame, reference: DataFrame, embedding: str = "embedding", gamma: float | None = None, features: int = 2048, seed: int = 0) -> DataFrame:
    """One row: mmd estimated by random Fourier features, one pass over either side (error about 1/sqrt(features))."""
    ship_package(test.sparkSession)
    dim = dimension(reference, embedding)
    g = gamma if gamma is not None else 1.0 / max(1, dim)
    rng = np.random.default_rng(seed)
    w, b = rng.normal(0, math.sqrt(2 * g), (dim, features)), rng.uniform(0, 2 * math.pi, features)

    def sums(batches):
        for part in batches:
            for side, rows in part.groupby("side"):
                z = math.sqrt(2 / features) * np.cos(np.asarray(rows["v"].tolist()) @ w + b)
                yield pd.DataFrame({"side": [side], "n": [len(rows)], "z": [z.sum(0).tolist()]})

    rows = _sample(test, embedding, "x").unionByName(_sample(reference, embedding, "y"))
    parts = rows.mapInPandas(sums, "side string, n long, z array<double>")
    per = parts.select("side", "n", F.posexplode("z").alias("i", "z")).groupBy("i").agg(*[(F.sum(F.when(F.col("side") == s, F.col("z"))) / F.sum(F.when(F.col("side") == s, F.col("n")))).alias(s) for s in "xy"])
    return per.agg(F.sqrt(F.sum((F.col("x") - F.col("y")) ** 2)).alias("mmd"))


def ks_statistics(test: DataFrame, reference: DataFrame, embedding: str = "embedding") -> DataFrame:
    """(dim, ks, n_test, n_reference): the greatest gap between the two empirical distributions of each dimension.

    Values are counted per dimension first.  Running counts are taken within
    value buckets and offset by the buckets before, so a dimension is not one
    task however many values it has.
    """
    rows = _sample(test, embedding, "x").unionByName(_sample(reference, embedding, "y"))
    points = rows.select("side", F.posexplode("v").alias("dim", "x"))
    counts = points.groupBy("dim", "x").agg(F.count_if(F.col("side") == "x").alias("a"), F.count_if(F.col("side") == "y").alias("b"))
    # cuts between buckets follow the values' quantiles, so that outliers do not crowd the rest into one
    cuts = F.percentile_approx("x", [i / KS_BUCKETS for i in range(1, KS_BUCKETS)], 100 * KS_BUCKETS)
    spans = counts.groupBy("dim").agg(cuts.alias("cuts"), F.sum("a").alias("n_test"), F.sum("b").alias("n_reference"))
    bucket = F.size(F.filter("cuts", lambda c: c < F.col("x")))
    placed = counts.join(spans, "dim").withColumn("bucket", bucket).drop("cuts")
    sums = placed.groupBy("dim", "bucket").agg(F.sum("a").alias("sa"), F.sum("b").alias("sb"))
    upto = Window.partitionBy("dim").orderBy("bucket")
    before = sums.select("dim", "bucket", (F.sum("sa").over(upto) - F.col("sa")).alias("pa"), (F.sum("sb").over(upto) - F.col("sb")).alias("pb"))
    inside = Window.partitionBy("dim", "bucket").orderBy("x")
    gap = F.abs((F.col("pa") + F.sum("a").over(inside)) / F.col("n_test") - (F.col("pb") + F.sum("b").over(inside)) / F.col("n_reference"))
    return placed.join(before, ["dim", "bucket"]).withColumn("gap", gap).groupBy("dim").agg(F.max("gap").alias("ks"), F.first("n_test").alias("n_test"), F.first("n_reference").alias("n_reference"))


def ks_critical(n: int, m: int, alpha: float = 0.05, exact_to: int = 10_000) -> float:
    """The least attainable statistic that is significant at ``alpha``.

    Exact while the root of the product of the sample sizes is at most
    ``exact_to``, by counting lattice paths that stay within a band, one
    antidiagonal at a time; asymptotic beyond.
    """
    if n == 0 or m == 0:
        return float("inf")
    if n * m > exact_to**2:
        return math.sqrt(-math.log(alpha / 2) / 2 * (n + m) / (n * m))
    step = math.gcd(n, m)
    lo, hi = 0, n * m // step + 1

    def tail(k: int) -> float:
        """P(n m D >= k step): one minus the share of paths that keep abs(i m - j n) below it."""
        band = k * step
        first, share = 0, np.ones(1)  # for i from first on; of the paths to (i, d - i)
        for d in range(1, n + m + 1):
            # abs(i m - (d - i) n) < band; both ends stay inside the grid
            low = max(0, d - m, (d * n - band) // (n + m) + 1)
            high = min(n, d, -((-d * n - band) // (n + m)) - 1)
            if low > high:
                return 1.0
            i = np.arange(low, high + 1)
            padded = np.zeros(high - low + 3)  # of i from low - 1 to high + 1
            start, end = max(first, low - 1), min(first + len(share) - 1, high + 1)
            if start <= end:
                padded[start - low + 1 : end - low + 2] = share[start - first : end - first + 1]
            share = padded[:-2] * (i / d) + padded[1:-1] * ((d - i) / d)
            first = low
        return 1 - share[0]

    while hi - lo > 1:
        mid = (lo + hi) // 2
        if tail(mid) < alpha:
            hi = mid
        else:
            lo = mid
    return hi * step / (n * m)


def metrics(test: DataFrame, reference: DataFrame, embedding: str = "embedding", alpha: float = 0.05, asymptotic: bool = False) -> DataFrame:
    """One row: mmd, ks_ratio (share of dimensions whose statistic is significant), n_dims, n_test, n_reference."""
    n, m = (d.where(F.col(embedding).isNotNull()).count() for d in (test, reference))
    critical = math.sqrt(-math.log(alpha / 2) / 2 * (n + m) / max(1, n * m)) if asymptotic else ks_critical(n, m, alpha)
    ks = ks_statistics(test, reference, embedding)
    ratio = ks.agg(F.avg(F.when(F.col("ks") >= critical - 1e-12, 1.0).otherwise(0.0)).alias("ks_ratio"), F.count(F.lit(1)).alias("n_dims"))
    return mmd(test, reference, embedding).crossJoin(ratio).withColumn("n_test", F.lit(n).cast("long")).withColumn("n_reference", F.lit(m).cast("long"))


def shift_flags(measured: DataFrame, mmd_threshold: float = 0.04, ks_ratio_threshold: float = 0.15) -> DataFrame:
    """At most one flag, if either test exceeds its threshold; high if both do."""
    by_mmd, by_ks = F.col("mmd") > mmd_threshold, F.col("ks_ratio") > ks_ratio_threshold
    agree = by_mmd.cast("int") + by_ks.cast("int")
    evidence = {
        "mmd_distance": F.round("mmd", 6),
        "mmd_threshold": F.lit(mmd_threshold),
        "ks_significant_dimensions_ratio": F.round("ks_ratio", 6),
        "ks_ratio_threshold": F.lit(ks_ratio_threshold),
        "calibrated_shift_score": F.round(F.greatest(F.col("mmd") / mmd_threshold, F.col("ks_ratio") / ks_ratio_threshold), 6),
        "agreed_test_statistics_count": agree,
        "access_mode_used": F.lit("black_box"),
    }
    return flags(measured.where(by_mmd | by_ks), "distribution_shift", F.lit("Embeddings differ from the reference."), evidence, 0.4 + 0.25 * agree, F.when(agree == 2, "high").otherwise("medium"), F.lit("dataset"), "review")
