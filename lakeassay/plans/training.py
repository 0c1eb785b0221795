"""Queries p1 to p5: the general training-data operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeassay.operators import nested, packing, profile, rejects, sampling
from lakeassay.session import scratch_path, table

# --- problem 1 -------------------------------------------------------------------------


def _archive(spark: SparkSession, sf: str) -> str:
    out = scratch_path(spark, "archive")
    packing.pack(table(spark, sf, "label_files"), out)
    return out


def _records(spark: SparkSession, sf: str) -> tuple[DataFrame, bool]:
    """The label records as read back from the packed containers."""
    directory = _archive(spark, sf)
    wide = packing.needs_wide(spark, directory)
    return packing.label_records(packing.checked(packing.members(packing.archive(spark, directory))), wide), wide


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Records that repeat an earlier one of the same image, read back from the packed containers."""
    return packing.repeated_records(_records(spark, sf)[0])


def p1_records(spark: SparkSession, sf: str) -> DataFrame:
    """Each record of each image exactly once, with its first occurrence."""
    records, wide = _records(spark, sf)
    first = packing.first_records(records)
    span = F.lit(packing.LINE_SPAN).cast("decimal(10,0)" if wide else "long")
    file_id = F.floor(F.col("pos") / span).cast("long")
    return first.select(
        "image",
        F.col("cls").alias("class_value"),
        F.col("x").alias("x_center"),
        F.col("y").alias("y_center"),
        F.col("w").alias("width"),
        F.col("h").alias("height"),
        F.col("n_copies"),
        file_id.alias("file_id"),
        (F.col("pos") - file_id * span).cast("int").alias("line_no"),
    )


def p1_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Every stored file as it comes back from the archive: id, path, size, digest, checksum verdict."""
    blocks = packing.archive(spark, _archive(spark, sf))
    return packing.members(blocks).select("file_id", F.col("path").alias("image_path"), F.octet_length("content").cast("long").alias("n_bytes"), F.md5("content").alias("digest"), "sound")


# --- problem 2 -------------------------------------------------------------------------


def _flat(spark: SparkSession, sf: str) -> nested.Flattened:
    return nested.flatten(table(spark, sf, "assurance_reports"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return nested.occurrences(_flat(spark, sf)).select("report_id", "module_no", "flag_no", "evidence_path")


def p2_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Scalars with kind and value, each with its parent flag."""
    return nested.occurrences(_flat(spark, sf)).select("report_id", "module_no", "flag_no", "evidence_path", "kind", "scalar")


def p2_reports(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(spark, sf).reports.select("report_id", "dataset_id", "model_id", "report_ts", "overall_recommendation", "audit_log_ref", F.greatest("n_modules", F.lit(0)).alias("n_modules"))


def p2_modules(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(spark, sf).module_rows.select("report_id", "module_no", "module_name", "coverage_statement", "access_mode_used", "n_flags")


def p2_flags(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(spark, sf).flag_rows.select("report_id", "module_no", "flag_no", "id", "module_name", "reason", "confidence", "severity", "affected_asset", "recommended_disposition")


def p2_objects(spark: SparkSession, sf: str) -> DataFrame:
    """The stored objects, each once, with the number of bridge rows that lead to it and of flags that have it as evidence."""
    flat = _flat(spark, sf)
    up = flat.bridges.where(F.col("child_id").isNotNull()).groupBy(F.col("child_id").alias("node_id")).agg(F.count(F.lit(1)).alias("n_parents"))
    at = flat.flags.where(F.col("root_id").isNotNull()).groupBy(F.col("root_id").alias("node_id")).agg(F.count(F.lit(1)).alias("n_flags"))
    return flat.nodes.join(up, "node_id", "left").join(at, "node_id", "left").fillna(0, ["n_parents", "n_flags"])


# --- problem 3 -------------------------------------------------------------------------


def small_list(df: DataFrame, column: str, most: int = 100_000) -> list:
    """The distinct values of a dimension column; refuses a column that is none."""
    rows = df.where(F.col(column).isNotNull()).select(column).distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{column} has more than {most} values")
    return sorted(r[0] for r in rows)


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return rejects.load_lines(table(spark, sf, "raw_annotations"), small_list(table(spark, sf, "class_names"), "class_id"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return _lines(spark, sf).where(F.col("reason").isNotNull()).select("line_id", "reason")


def p3_loaded(spark: SparkSession, sf: str) -> DataFrame:
    """The readable annotations, typed."""
    return _lines(spark, sf).where(F.col("reason").isNull()).select("line_id", "export_file", "image_path", "class_id", "class_name", "x_center", "y_center", "width", "height")


# --- problem 4 -------------------------------------------------------------------------


def _plan(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    items = table(spark, sf, "object_annotations")
    return items, sampling.plan(table(spark, sf, "class_targets"), sampling.observe(items))


def _drawn(spark: SparkSession, sf: str) -> DataFrame:
    items, planned = _plan(spark, sf)
    return sampling.shares(sampling.draw(sampling.distinct_items(items), planned), planned)


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Targets that the drawn sample does not meet."""
    return sampling.unmet(_drawn(spark, sf)).select("request_id", "class_id")


def p4_sample(spark: SparkSession, sf: str) -> DataFrame:
    """The sample: one row per request and drawn annotation."""
    items, planned = _plan(spark, sf)
    return sampling.draw(sampling.distinct_items(items), planned).select("request_id", "class_id", F.col("item").alias("annotation_id"))


def p4_report(spark: SparkSession, sf: str) -> DataFrame:
    """Per request and class: wanted, drawn, deficit, share reached."""
    return _drawn(spark, sf).select("request_id", "class_id", "target_share", "observed", "wanted", "drawn", "deficit", F.round("reached_share", 6).alias("reached_share"))


# --- problem 5 -------------------------------------------------------------------------

IMAGE_PATH_FORM = r"^ds_[0-9]{4}/images/[^/\\]+\.(?i:jpg|jpeg|png|bmp|tiff|webp)\z"


def annotation_columns(spark: SparkSession, sf: str) -> list[profile.NumericColumn]:
    """The three columns with rules, their buckets from ``column_baseline`` (a fixed small table)."""
    base = table(spark, sf, "column_baseline").orderBy("column_name", "bucket_no").limit(10_000).collect()
    buckets = {n: [(r["lower_bound"], r["upper_bound"], r["expected_share"]) for r in base if r["column_name"] == n] for n in ("x_center", "height", "class_id")}
    classes = small_list(table(spark, sf, "class_names"), "class_id")
    x, h = F.col("bbox.x_center"), F.col("bbox.height")
    return [
        profile.NumericColumn("x_center", "bbox.x_center", ~F.isnan(x) & (x >= 0) & (x <= 1), buckets["x_center"], 1.0),
        profile.NumericColumn("height", "bbox.height", ~F.isnan(h) & (h > 0) & (h <= 1), buckets["height"], 1.0),
        profile.NumericColumn("class_id", "class_id", F.col("class_id").isin(classes), buckets["class_id"], None, check_distinct=False),
    ]


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "object_annotations").select("load_id", "class_id", "bbox", "image_path")
    return profile.issues(rows, "load_id", annotation_columns(spark, sf), "image_path", IMAGE_PATH_FORM)


def p5_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Every column of every load: rows, nulls, distinct values, range."""
    out = profile.standard_profile(table(spark, sf, "object_annotations"), "load_id")
    return out.select("load_id", "column_name", "n_rows", "n_nulls", F.round("null_rate", 6).alias("null_rate"), "n_distinct", F.round("min_number", 6).alias("min_number"), F.round("max_number", 6).alias("max_number"))


def p5_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """Least and greatest value of every column of every load that is no number: texts and times, as text."""
    rows = table(spark, sf, "object_annotations")
    names = [n for n, t in profile.leaves(rows.schema) if not isinstance(t, T.NumericType)]
    return profile.standard_profile(rows, "load_id", names).select("load_id", "column_name", "min_text", "max_text")


def p5_invalid(spark: SparkSession, sf: str) -> DataFrame:
    """Values of class_id and of all four sides of the boxes in each load, and how many of them are invalid."""
    y, w = F.col("bbox.y_center"), F.col("bbox.width")
    rest = [
        profile.NumericColumn("y_center", "bbox.y_center", ~F.isnan(y) & (y >= 0) & (y <= 1)),
        profile.NumericColumn("width", "bbox.width", ~F.isnan(w) & (w > 0) & (w <= 1)),
    ]
    return profile.invalid_counts(table(spark, sf, "object_annotations"), "load_id", [*annotation_columns(spark, sf), *rest])


def _forms(spark: SparkSession, sf: str) -> dict[str, profile.Declared]:
    """The text columns whose form is known beforehand; the others have their induced expressions."""
    names = small_list(table(spark, sf, "class_names"), "class_name")
    return {"image_path": IMAGE_PATH_FORM, "class_name": lambda value: value.isin(names)}


def p5_expressions(spark: SparkSession, sf: str) -> DataFrame:
    """The expressions induced for each text column."""
    out = profile.all_expressions(table(spark, sf, "object_annotations"), "load_id", _forms(spark, sf))
    return out.select("column_name", "level", "expression", "n_values", "n_rows", "gain", "sound")


def p5_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """How well the induced expressions cover each text column in each load, and the change between loads."""
    out = profile.all_coverage(table(spark, sf, "object_annotations"), "load_id", _forms(spark, sf))
    return out.select("load_id", "column_name", "n_values", "n_nonconforming", "n_malformed", "covered", "change")


QUERIES = {f.__name__: f for f in (p1_found, p1_records, p1_roundtrip, p2_found, p2_evidence, p2_reports, p2_modules, p2_flags, p2_objects, p3_found, p3_loaded, p4_found, p4_sample, p4_report, p5_found, p5_profile, p5_ranges, p5_invalid, p5_expressions, p5_coverage)}
