"""Flags united, counted and judged; reports written as JSON and HTML."""

from __future__ import annotations

import html
import json
from datetime import UTC, datetime
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeassay.schemas import MODULES, SEVERITIES, severity_rank

#: Display names of the modules.
LABELS = {"data_integrity": "Data integrity", "model_integrity": "Model integrity", "provenance": "Provenance", "distribution_shift": "Distribution shift"}


def unite(parts: list[DataFrame]) -> DataFrame:
    """All flags, with the number of the check they come from as ``check_no``."""
    return reduce(DataFrame.unionByName, [p.withColumn("check_no", F.lit(i)) for i, p in enumerate(parts)])


def by_module(flags: DataFrame) -> DataFrame:
    """Flags per module and severity; modules without flags stay, with zeros."""
    counts = flags.groupBy("module").agg(F.count(F.lit(1)).alias("n_flags"), *[F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in SEVERITIES])
    modules = flags.sparkSession.createDataFrame([(m, i) for i, m in enumerate(MODULES)], "module string, module_ord int")
    return modules.join(counts, "module", "left").fillna(0, ["n_flags", *[f"n_{s}" for s in SEVERITIES]]).select("module_ord", "module", "n_flags", *[f"n_{s}" for s in SEVERITIES])


def verdict(flags: DataFrame, checks_executed: int | None = None) -> DataFrame:
    """One row: quarantine if any flag is high, review if any is medium, else accept (no flags included).

    Judged by severity alone.  ``checks_executed`` stands beside it, so that a
    run whose checks all failed can be told from a clean one.
    """
    worst = F.coalesce(F.max(severity_rank(F.col("severity"))), F.lit(0))
    out = flags.agg(worst.alias("worst"), F.count(F.lit(1)).alias("n_flags"))
    out = out.select(F.when(F.col("worst") == 2, "quarantine").when(F.col("worst") == 1, "review").otherwise("accept").alias("overall_recommendation"), "n_flags")
    return out if checks_executed is None else out.withColumn("checks_executed", F.lit(checks_executed))


def explore(flags: DataFrame, severities: list[str] | None = None, modules: list[str] | None = None, order: str = "severity") -> DataFrame:
    """Flags filtered and sorted for display, by severity, confidence or module; ties in order of id."""
    from lakeassay.functions.vectors import format_percent, shorten

    out = flags
    if severities is not None:
        out = out.where(F.col("severity").isin(severities))
    if modules is not None:
        out = out.where(F.col("module").isin(modules))
    keys = {"severity": [severity_rank(F.col("severity")).desc()], "confidence": [F.col("confidence").desc()], "module": [F.col("module").asc()]}[order]
    label = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])
    shown = out.orderBy(*keys, "id")
    return shown.select(label[F.col("module")].alias("module_label"), "severity", format_percent(F.col("confidence")).alias("confidence_text"), shorten(F.col("reason"), 90).alias("reason"), "affected_asset", "recommended_disposition")


def assemble(flags: DataFrame, dataset_id: str, model_id: str, audit_log_ref: str, coverage: dict[str, str], access_mode: str, when: datetime | None = None) -> dict:
    """The report as a dict: ids, time, one result per module in order, verdict.

    Flags are brought to the driver: a report lists findings, which are few; a
    run that flags more than a million assets should read the table instead.
    """
    rows = [r.asDict() for r in flags.orderBy("module", severity_rank(F.col("severity")).desc(), "id").limit(1_000_001).collect()]
    if len(rows) > 1_000_000:
        raise ValueError("too many flags for a report; write the flags as a table")
    results = []
    for m in MODULES:
        own = [{k: (json.loads(r[k]) if k == "evidence" and r[k] else r[k]) for k in ("id", "module", "reason", "evidence", "confidence", "severity", "affected_asset", "recommended_disposition")} for r in rows if r["module"] == m]
        results.append({"module_name": m, "flags": own, "coverage_statement": coverage.get(m, ""), "access_mode_used": access_mode})
    worst = max((SEVERITIES.index(r["severity"]) for r in rows), default=0)
    return {
        "dataset_id": dataset_id,
        "model_id": model_id,
        "timestamp": (when or datetime.now(UTC)).isoformat(),
        "module_results": results,
        "overall_recommendation": ("accept", "review", "quarantine")[worst],
        "audit_log_ref": audit_log_ref,
    }


def render(report: dict) -> str:
    """The report as a page; every value is escaped."""
    e = lambda x: html.escape(str(x), quote=True)
    parts = [
        "<!doctype html><meta charset='utf-8'><title>Assurance report</title>",
        f"<h1>{e(report['dataset_id'])} with {e(report['model_id'])}: {e(report['overall_recommendation'])}</h1>",
        f"<p>{e(report['timestamp'])}, log {e(report['audit_log_ref'])}</p>",
    ]
    for m in report["module_results"]:
        parts.append(f"<h2>{e(LABELS.get(m['module_name'], m['module_name']))} ({e(m['module_name'])})</h2><p>{e(m['coverage_statement'])} {e(m['access_mode_used'])}</p>")
        if m["flags"]:
            cells = "".join(f"<tr><td>{e(f['severity'])}<td>{e(f['affected_asset'])}<td>{e(f['reason'])}<td>{e(round(f['confidence'], 3))}<td>{e(f['recommended_disposition'])}<td><code>{e(json.dumps(f['evidence']))}</code></tr>" for f in m["flags"])
            parts.append(f"<table><tr><th>Severity<th>Asset<th>Reason<th>Confidence<th>Disposition<th>Evidence</tr>{cells}</table>")
        else:
            parts.append("<p>No findings.</p>")
    return "\n".join(parts)


def write(report: dict, directory: str, name: str = "assurance_report") -> tuple[Path, Path]:
    """The report as NAME.json and NAME.html under ``directory``, made with its parents."""
    folder = Path(directory)
    folder.mkdir(parents=True, exist_ok=True)
    as_json, as_html = folder / f"{name}.json", folder / f"{name}.html"
    as_json.write_text(json.dumps(report, indent=2, ensure_ascii=False), encoding="utf-8")
    as_html.write_text(render(report), encoding="utf-8")
    return as_json, as_html


def numbered(df: DataFrame, order: str, name: str = "row_no") -> DataFrame:
    """``df`` with its rows numbered from 0 in the order of a column.

    Numbers come from a range sort and per-partition counts, so no window pulls
    all rows into one task.
    """
    from lakeassay.session import materialize

    sorted_rows = materialize(df.repartitionByRange(order).sortWithinPartitions(order).withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id()), "numbered")
    counts = sorted_rows.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    base = counts.select("__p", (F.sum("__n").over(Window.orderBy("__p")) - F.col("__n")).alias("__base"))
    inside = F.col("__i") - F.col("__p").cast("long") * (1 << 33)
    return sorted_rows.join(F.broadcast(base), "__p").withColumn(name, F.col("__base") + inside).drop("__p", "__i", "__base")
