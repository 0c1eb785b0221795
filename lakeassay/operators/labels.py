"""Label flips: annotated classes to which an out-of-fold model gives little probability."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeassay.schemas import flags


def folds(df: DataFrame, k: int, label: str = "label", row_id: str = "asset", seed: int = 42) -> DataFrame:
    """Stratified folds in hash order: the i-th row of a label goes to fold i mod k.

    Rows are numbered within hash buckets of a label and offset by the buckets
    before, so a label is not one task.
    """
    h = F.xxhash64(row_id, F.lit(seed))
    rows = df.withColumn("__h", h).withColumn("__b", F.shiftrightunsigned("__h", 52))
    inside = F.row_number().over(Window.partitionBy(label, "__b").orderBy("__h", row_id))
    counts = rows.groupBy(label, "__b").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.withColumn("__base", F.sum("__n").over(Window.partitionBy(label).orderBy("__b")) - F.col("__n")).drop("__n")
    return rows.withColumn("__i", inside).join(before, [label, "__b"]).withColumn("fold", F.pmod(F.col("__base") + F.col("__i") - 1, F.lit(k)).cast("int")).drop("__h", "__b", "__i", "__base")


def annotated_probability(df: DataFrame, *, asset_id: str = "vec_id", embedding: str = "embedding", label: str = "label", n_splits: int = 5, seed: int = 42, unlabelled: int | None = None) -> DataFrame:
    """(asset, label, prob): probability an out-of-fold logistic regression gives the annotated class.

    A class absent from the training folds has probability 0.  If some class has
    but one row, all rows are fitted and scored together.  With fewer than two
    classes nothing can be said and the result is empty.  Rows without embedding
    or label are left out, as are those of the label ``unlabelled`` if it is
    given (by default it counts as a class).
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = df.where(F.col(embedding).isNotNull() & F.col(label).isNotNull()).select(F.col(asset_id).cast("long").alias("asset"), F.col(label).cast("int").alias("label"), array_to_vector(F.col(embedding).cast("array<double>")).alias("features"))
    if unlabelled is not None:
        rows = rows.where(F.col("label") != unlabelled)
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).limit(100_001).collect()}
    empty = "asset long, label int, prob double"
    if len(sizes) < 2:
        return df.sparkSession.createDataFrame([], empty)
    if len(sizes) > 100_000:
        raise ValueError("labels are meant to be classes")
    position = F.create_map(*[F.lit(x) for i, y in enumerate(sorted(sizes)) for x in (y, float(i))])
    rows = rows.withColumn("y", position[F.col("label")])
    k = min(n_splits, min(sizes.values()))
    parts = []
    split = folds(rows, k, row_id="asset", seed=seed).cache() if k >= 2 else rows.withColumn("fold", F.lit(0)).cache()
    for f in range(k) if k >= 2 else [None]:
        train = split if f is None else split.where(F.col("fold") != f)
        test = split if f is None else split.where(F.col("fold") == f)
        n = train.count()
        model = LogisticRegression(labelCol="y", featuresCol="features", family="multinomial", regParam=1.0 / max(1, n), elasticNetParam=0.0, standardization=False, maxIter=1000).fit(train)
        probs = vector_to_array("probability")
        parts.append(model.transform(test).select("asset", "label", F.coalesce(F.try_element_at(probs, (F.col("y") + 1).cast("int")), F.lit(0.0)).alias("prob")))
    return reduce(DataFrame.unionByName, parts)


def any_labelled(df: DataFrame, label: str = "label") -> bool:
    """Whether any row has a label; null and -1 are none."""
    return not df.where(F.col(label) != -1).isEmpty()


def label_flip_flags(scored: DataFrame, threshold: float = 0.1) -> DataFrame:
    p = F.col("prob")
    evidence = {"image_path": F.col("asset"), "annotated_class": F.col("label"), "predicted_probability_for_annotated": F.round(p, 6)}
    return flags(scored.where(p < threshold), "data_integrity", F.lit("Annotated class is improbable."), evidence, 1 - p, F.when(p < 0.01, "high").otherwise("medium"), F.col("asset"), "review")
