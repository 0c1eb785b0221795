"""The finding ("flag") that every detector emits, and its domains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The domains of a flag's enumerated fields, in report order.
MODULES = ("data_integrity", "model_integrity", "provenance", "distribution_shift")
SEVERITIES = ("low", "medium", "high")
DISPOSITIONS = ("accept", "review", "quarantine")
ACCESS_MODES = ("white_box", "black_box")

FLAG = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("module", T.StringType()),
        T.StructField("reason", T.StringType()),
        T.StructField("evidence", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("severity", T.StringType()),
        T.StructField("affected_asset", T.StringType()),
        T.StructField("recommended_disposition", T.StringType()),
    ]
)

ANNOTATION = T.StructType(
    [
        T.StructField("class_id", T.IntegerType()),
        T.StructField("class_name", T.StringType()),
        T.StructField("bbox", T.StructType([T.StructField(c, T.DoubleType()) for c in ("x_center", "y_center", "width", "height")])),
    ]
)


def severity_rank(severity: Column) -> Column:
    """0 for low, 1 for medium, 2 for high; null for anything else."""
    return F.when(severity == "high", 2).when(severity == "medium", 1).when(severity == "low", 0)


def flags(df: DataFrame, module: str, reason: Column, evidence: dict[str, Column], confidence: Column, severity: Column, asset: Column, disposition: str | Column) -> DataFrame:
    """Rows of ``df`` as flags.  The id is a digest of content, so a rerun gives the same ids."""
    body = F.to_json(F.struct(*[c.alias(k) for k, c in evidence.items()]))
    out = df.select(
        F.lit(module).alias("module"),
        reason.alias("reason"),
        body.alias("evidence"),
        confidence.cast("double").alias("confidence"),
        severity.alias("severity"),
        asset.cast("string").alias("affected_asset"),
        (F.lit(disposition) if isinstance(disposition, str) else disposition).alias("recommended_disposition"),
    )
    identity = F.sha2(F.concat_ws("\u0001", "module", "affected_asset", "reason", "evidence"), 256)
    return out.select(F.substring(identity, 1, 32).alias("id"), *[f.name for f in FLAG.fields[1:]])


def info_flag(spark: SparkSession, module: str, reason: str, detail: str) -> DataFrame:
    """One low flag that says a check was skipped or failed."""
    return flags(spark.range(1), module, F.lit(reason), {"detail": F.lit(detail)}, F.lit(0.0), F.lit("low"), F.lit("pipeline"), "accept")


def invalid_flags(df: DataFrame) -> DataFrame:
    """Flags that break the schema's domains: an enumerated value out of its set, or a confidence outside 0 to 1."""
    ok = (
        F.col("module").isin(*MODULES)
        & F.col("severity").isin(*SEVERITIES)
        & F.col("recommended_disposition").isin(*DISPOSITIONS)
        & F.col("confidence").between(0, 1)
        & F.col("affected_asset").isNotNull()
        & F.col("reason").isNotNull()
    )
    return df.where(~F.coalesce(ok, F.lit(False)))
