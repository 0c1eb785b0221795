"""Samples that match target category shares (problem 4).

Acceptance probabilities come from target-to-observed ratios, items are drawn
independently by a hash of their identifier with slight oversampling, and the
counts are then corrected exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 1024


def distinct_items(df: DataFrame, item: str = "annotation_id", category: str = "class_id") -> DataFrame:
    """(item, category) once each; rows without an item are ignored, a null category is kept."""
    return df.where(F.col(item).isNotNull()).select(F.col(item).alias("item"), F.col(category).alias("category")).distinct()


def observe(df: DataFrame, item: str = "annotation_id", category: str = "class_id") -> DataFrame:
    """Distinct items per category, and ``total``: the distinct items of the whole table.

    Items are first made distinct per category and then counted, so a hot
    category is spread by its items.  An item seen under two categories counts
    in each but once in ``total``.
    """
    pairs = distinct_items(df, item, category)
    counts = pairs.groupBy("category").agg(F.count(F.lit(1)).alias("observed"))
    total = pairs.select("item").distinct().agg(F.count(F.lit(1)).alias("total"))
    return counts.crossJoin(F.broadcast(total))


def plan(targets: DataFrame, observed: DataFrame) -> DataFrame:
    """One row per request and category: what is wanted, what there is, what will be taken, the deficit.

    ``needed`` is the larger of share * fraction * total and the minimum;
    ``quota`` the whole number of items drawn, never more than observed.
    Categories that never occur have observed 0.  A request's quota of a null
    category is not defined and such rows are left out.
    """
    wide = targets.where(F.col("class_id").isNotNull()).select("request_id", "class_id", "target_share", "min_rows", "sample_fraction")
    total = observed.agg(F.coalesce(F.max("total"), F.lit(0)).alias("total"))
    counts = observed.where(F.col("category").isNotNull()).select(F.col("category").alias("class_id"), "observed")
    out = wide.join(F.broadcast(total)).join(counts, "class_id", "left").fillna(0, ["observed"])
    share = F.col("target_share") * F.col("sample_fraction") * F.col("total")
    out = out.withColumn("share_rows", F.coalesce(share, F.lit(0.0))).withColumn("floor_rows", F.coalesce(F.col("min_rows"), F.lit(0)))
    out = out.withColumn("wanted", F.greatest(F.round("share_rows").cast("long"), F.col("floor_rows")))
    return out.select(
        "request_id",
        "class_id",
        "target_share",
        "observed",
        "total",
        "share_rows",
        "floor_rows",
        "wanted",
        F.least("wanted", "observed").alias("quota"),
        (F.col("observed") < F.col("share_rows")).alias("misses_share"),
        (F.col("observed") < F.col("floor_rows")).alias("misses_minimum"),
        F.greatest(F.col("wanted") - F.col("observed"), F.lit(0)).alias("deficit"),
    )


def draw(items: DataFrame, planned: DataFrame, seed: int = 0) -> DataFrame:
    """Exactly ``quota`` items of each request and category: request_id, class_id, item.

    An item's number u in [0, 1) is a hash of request, item and seed.  It is
    accepted with probability p = (quota + margin) / observed, the margin being
    six standard deviations, and the accepted are then cut at the quota-th
    smallest u.  The cut is found from counts per bucket of u; only rows of the
    one bucket that straddles it are ranked, so no category is ever gathered in
    one task.  Items beyond p form a last bucket of their own, which is ranked
    only if chance left the accepted short: the result is exact in any case.
    """
    q = planned.where(F.col("quota") > 0).select("request_id", "class_id", "quota", "observed")
    margin = 6 * F.sqrt("quota") + 10
    q = q.withColumn("p", F.least(F.lit(1.0), (F.col("quota") + margin) / F.col("observed")))
    unit = (F.shiftrightunsigned(F.xxhash64("request_id", "item", F.lit(seed)), 11)).cast("double") / F.lit(float(1 << 53))
    pairs = items.where(F.col("category").isNotNull()).join(F.broadcast(q), F.col("category") == F.col("class_id"))
    drawn = pairs.withColumn("u", unit)
    drawn = drawn.select("request_id", "class_id", "item", "quota", "u", F.least(F.floor(F.col("u") / F.col("p") * BUCKETS), F.lit(BUCKETS)).cast("int").alias("bucket"))
    by_bucket = drawn.groupBy("request_id", "class_id", "quota", "bucket").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("request_id", "class_id").orderBy("bucket")
    cut = by_bucket.withColumn("cum", F.sum("n").over(upto)).withColumn("before", F.col("cum") - F.col("n")).where((F.col("before") < F.col("quota")) & (F.col("cum") >= F.col("quota")))
    cut = cut.select("request_id", "class_id", F.col("bucket").alias("cut"), (F.col("quota") - F.col("before")).alias("rest"))
    marked = drawn.join(F.broadcast(cut), ["request_id", "class_id"])
    whole = marked.where(F.col("bucket") < F.col("cut")).select("request_id", "class_id", "item")
    edge = marked.where(F.col("bucket") == F.col("cut")).withColumn("r", F.row_number().over(Window.partitionBy("request_id", "class_id").orderBy("u", "item")))
    return whole.unionByName(edge.where(F.col("r") <= F.col("rest")).select("request_id", "class_id", "item"))


def shares(sample: DataFrame, planned: DataFrame) -> DataFrame:
    """The plan with what was drawn: drawn rows and the share reached of each category."""
    got = sample.groupBy("request_id", "class_id").agg(F.count(F.lit(1)).alias("drawn"))
    size = got.groupBy("request_id").agg(F.sum("drawn").alias("sample_rows"))
    out = planned.join(got, ["request_id", "class_id"], "left").join(size, "request_id", "left").fillna(0, ["drawn", "sample_rows"])
    return out.withColumn("reached_share", F.when(F.col("sample_rows") > 0, F.col("drawn") / F.col("sample_rows")).otherwise(F.lit(0.0)))


def unmet(shared: DataFrame) -> DataFrame:
    """The rows of :func:`shares` whose sample falls short: all there is was drawn, and it is less than the share or the minimum."""
    return shared.where((F.col("drawn") == F.col("observed")) & ((F.col("drawn") < F.col("share_rows")) | (F.col("drawn") < F.col("floor_rows"))))
