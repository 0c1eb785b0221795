"""Joins that stay balanced when one key holds a large part of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def heavy_keys(df: DataFrame, key: str, fraction: float = 0.02) -> list:
    """Keys that hold more than ``fraction`` of the rows.

    At most ``1 / fraction`` keys can qualify, which bounds what the driver
    receives whatever the size of ``df``.  Null keys never join and are ignored.
    """
    counts = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    top = counts.orderBy(F.col("n").desc()).limit(int(1 / fraction)).collect()
    if not top:
        return []
    total = counts.agg(F.sum("n")).first()[0]
    return [r["k"] for r in top if r["n"] > total * fraction]


def salted_join(left: DataFrame, right: DataFrame, key: str, hot: list, salt_source: Column, salts: int = 32, how: str = "inner") -> DataFrame:
    """Equi-join in which rows of ``left`` with a hot key spread over ``salts`` partitions.

    ``right`` rows of hot keys are repeated once per salt, all others once.
    ``salt_source`` must vary inside a hot key (a row's own identifier).
    """
    if not hot:
        return left.join(right, key, how)
    is_hot = F.col(key).isin(hot)
    salted_left = left.withColumn("__salt", F.when(is_hot, F.pmod(F.xxhash64(salt_source), F.lit(salts)).cast("int")).otherwise(F.lit(0)))
    salted_right = right.withColumn("__salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return salted_left.join(salted_right, [key, "__salt"], how).drop("__salt")
