"""Queries p6 to p8 and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeassay.llm import leakage, mixing, toxicity
from lakeassay.session import materialize, scratch_path, table

# --- problem 6 -------------------------------------------------------------------------


def _spans(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.leaked_spans(table(spark, sf, "documents"), table(spark, sf, "eval_items"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.leaked_documents(_spans(spark, sf))


def p6_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Every leaked span with its place and how much of the item it covers."""
    return _spans(spark, sf).withColumn("coverage", F.round("coverage", 6))


def p6_clean(spark: SparkSession, sf: str) -> DataFrame:
    """Every document with its leaked spans cut out."""
    return leakage.remove_spans(table(spark, sf, "documents"), table(spark, sf, "eval_items"))


# --- problem 7 -------------------------------------------------------------------------


def _mix(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Token counts, tokenized once and kept in the shared folder, and the plan."""
    sized = materialize(mixing.sizes(table(spark, sf, "documents")), "sizes")
    return sized, mixing.plan(sized, table(spark, sf, "mix_targets"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    """Targets that a source does not reach in the selected mix."""
    sized, planned = _mix(spark, sf)
    return mixing.unmet(mixing.reached(mixing.select(sized, mixing.ramp(planned)), planned)).select("mix_id", "source")


def p7_mix(spark: SparkSession, sf: str) -> DataFrame:
    """The mixes: every copy of every selected document in training order."""
    sized, planned = _mix(spark, sf)
    return mixing.select(sized, mixing.ramp(planned))


def p7_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Per mix and source: tokens wanted and mixed, the share reached, the copies used."""
    sized, planned = _mix(spark, sf)
    out = mixing.reached(mixing.select(sized, mixing.ramp(planned)), planned)
    return out.select("mix_id", "source", "target_share", "max_repeats", "most_copies", "source_tokens", F.round("wanted", 3).alias("wanted_tokens"), "mixed_tokens", F.round("reached_share", 6).alias("reached_share"), "short")


# --- problem 8 -------------------------------------------------------------------------


#: Where each session keeps the models it has fitted, by session and data.
_MODELS: dict[tuple[str, str], str] = {}


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    """Documents scored by a model fitted once a session and data set, and kept in the shared folder."""
    docs, key = table(spark, sf, "documents"), (spark.sparkContext.applicationId, sf)
    if key not in _MODELS:
        path = scratch_path(spark, "model")
        toxicity.save(toxicity.train(table(spark, sf, "content_labels"), docs), spark, path)
        _MODELS[key] = path
    return toxicity.score(docs, toxicity.load(spark, _MODELS[key]))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf).where("score > 0").select("doc_id")


def p8_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Every document with its score, the passage that decided it and its category."""
    return _scored(spark, sf).select("doc_id", "source", F.round("score", 6).alias("score"), "passage", "category")


def p8_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Rates of flagged documents per source and category."""
    return toxicity.rates(_scored(spark, sf))


QUERIES = {f.__name__: f for f in (p6_found, p6_spans, p6_clean, p7_found, p7_mix, p7_shares, p8_found, p8_scores, p8_rates)}

#: The outcome is the same for any common tokenizer; SQL counts words and marks.
_P7_FOUND = r"""
with d as (
  select nullif(regexp_replace(lower(source), '[^a-z0-9]', '', 'g'), '') as k, len(regexp_extract_all(coalesce(text, ''), '[\p{L}]+|[\p{N}]+|[^\s\p{L}\p{N}]')) as n from documents
), s as (select k, sum(n) as n from d group by k), t as (select sum(n) as n from d)
select mix_id, source from mix_targets cross join t left join s on s.k = regexp_replace(lower(source), '[^a-z0-9]', '', 'g')
where max_repeats * coalesce(s.n, 0) < target_share * budget_fraction * t.n
"""

ORACLES = {"p7_found": _P7_FOUND}
