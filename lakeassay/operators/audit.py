"""The whole audit: every check of every module, each failing by itself, one report."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeassay.operators import labels, models, outliers, provenance, report, shift, similarity, spectral
from lakeassay.schemas import flags, info_flag
from lakeassay.session import materialize


@dataclass
class Inputs:
    """What an audit looks at; checks without their inputs are reported as skipped.

    test and reference: (vec_id, embedding[, label]); images: Spark's image
    source; outputs and baseline: logits and probabilities per sample;
    activations and reference_stats: values and statistics per layer; masks:
    (target_class, l1_norm); chain and signed: provenance tables.
    """

    test: DataFrame | None = None
    reference: DataFrame | None = None
    images: DataFrame | None = None
    outputs: DataFrame | None = None
    baseline: DataFrame | None = None
    activations: DataFrame | None = None
    reference_stats: DataFrame | None = None
    masks: DataFrame | None = None
    chain: DataFrame | None = None
    signed: DataFrame | None = None
    public_key: bytes | None = None
    model_path: str = "model"
    db_path: str = "chain"
    options: dict = field(default_factory=dict)


def checks(i: Inputs) -> list[tuple[str, str, tuple[str, ...], Callable[[], DataFrame]]]:
    """(module, name, needed inputs, the check) in report order."""
    o = i.options
    return [
        ("data_integrity", "near-duplicates", ("test",), lambda: similarity.duplicate_flags(similarity.clusters(i.test, o.get("similarity_threshold", 0.95)))),
        ("data_integrity", "outliers", ("test", "reference"), lambda: outliers.ood_flags(outliers.scores(i.test, i.reference, contamination=o.get("contamination", 0.05)), o.get("anomaly_threshold"))),
        ("data_integrity", "label flips", ("test",), lambda: labels.label_flip_flags(labels.annotated_probability(i.test), o.get("label_threshold", 0.1)) if labels.any_labelled(i.test) else None),
        ("data_integrity", "trigger scan", ("images",), lambda: spectral.trigger_flags(spectral.scan_images(i.images, block=o.get("block_size", 64)), o.get("block_size", 64))),
        ("model_integrity", "trigger masks", ("masks",), lambda: models.anomaly_flags(models.mad_anomalies(i.masks), i.model_path)),
        ("model_integrity", "fingerprint", ("outputs", "baseline"), lambda: models.fingerprint_flags(models.fingerprint(i.outputs, i.baseline), i.model_path)),
        ("model_integrity", "activations", ("activations", "reference_stats"), lambda: models.drift_flags(models.activation_drift(models.activation_stats(i.activations), i.reference_stats), i.model_path)),
        ("provenance", "hash chain", ("chain",), lambda: provenance.chain_flags(provenance.verify_chains(i.chain), i.db_path)),
        ("provenance", "signatures", ("signed", "public_key"), lambda: provenance.signature_flags(provenance.verify_signatures(i.signed, i.public_key))),
        ("distribution_shift", "shift", ("test", "reference"), lambda: shift.shift_flags(shift.metrics(i.test, i.reference), o.get("mmd_threshold", 0.04), o.get("ks_ratio_threshold", 0.15))),
    ]


def run(spark: SparkSession, inputs: Inputs) -> tuple[DataFrame, int]:
    """(flags of all checks, checks that ran to their end).

    Each check is evaluated and stored before the next, so one that fails leaves
    a low flag that says so and takes nothing else with it.
    """
    parts, done = [], 0
    for module, name, needs, check in checks(inputs):
        if any(getattr(inputs, n) is None for n in needs):
            parts.append(info_flag(spark, module, f"Check skipped: {name}.", "no input"))
            continue
        try:
            found = check()
            if found is None:
                parts.append(info_flag(spark, module, f"Check skipped: {name}.", "nothing to check"))
                continue
            parts.append(materialize(found, "flags"))
            done += 1
        except Exception as x:  # noqa: BLE001 - any failure becomes a finding
            detail = f"{type(x).__name__}: {str(x)[:300]}"
            if name == "activations":
                # a model whose activations cannot be read hides what they would show
                evidence = {"error": F.lit(detail), "access_mode_used": F.lit("white_box")}
                parts.append(flags(spark.range(1), module, F.lit("Activations could not be read."), evidence, F.lit(1.0), F.lit("high"), F.lit(inputs.model_path), "review"))
            else:
                parts.append(info_flag(spark, module, f"Check failed: {name}.", detail))
    return report.unite(parts), done


def audit(spark: SparkSession, inputs: Inputs, dataset_id: str, model_id: str, output_dir: str, name: str = "assurance_report") -> dict:
    """Run all checks and write the report; returns it."""
    found, done = run(spark, inputs)
    coverage = {"data_integrity": "Duplicates, outliers, labels and spectra.", "model_integrity": "Outputs, activations and trigger masks.", "provenance": "Hash chain and signatures.", "distribution_shift": "Embeddings against the reference."}
    made = report.assemble(found.drop("check_no"), dataset_id, model_id, inputs.db_path, coverage, "white_box" if inputs.activations is not None else "black_box")
    made["checks_executed"] = done
    report.write(made, output_dir, name)
    return made


#: Exit codes of the command line.
EXIT = {"accept": 0, "review": 1, "quarantine": 1}


def main(args: list[str] | None = None) -> int:
    """Audit tables from the command line; 0 accept, 1 review or quarantine, 2 if it could not run."""
    import argparse

    p = argparse.ArgumentParser(description="Audit tables of embeddings, outputs and logs.")
    for n in ("test", "reference", "images", "outputs", "baseline", "activations", "reference-stats", "masks", "chain", "signed"):
        p.add_argument(f"--{n}", help="path of the table (Parquet; a folder for images)")
    p.add_argument("--public-key", help="hexadecimal Ed25519 public key")
    p.add_argument("--dataset-id", default="dataset")
    p.add_argument("--model-id", default="model")
    p.add_argument("--output", default="audit")
    a = p.parse_args(args)
    try:
        spark = SparkSession.builder.appName("audit").getOrCreate()
        read = lambda x: None if x is None else spark.read.parquet(x)
        inputs = Inputs(
            test=read(a.test), reference=read(a.reference), outputs=read(a.outputs), baseline=read(a.baseline), activations=read(a.activations), reference_stats=read(a.reference_stats), masks=read(a.masks), chain=read(a.chain), signed=read(a.signed),
            images=None if a.images is None else spark.read.format("image").load(a.images), public_key=bytes.fromhex(a.public_key) if a.public_key else None, model_path=a.model_id, db_path=a.chain or "chain",
        )
        made = audit(spark, inputs, a.dataset_id, a.model_id, a.output)
    except Exception as x:  # noqa: BLE001
        print(f"audit could not run: {x}")
        return 2
    print(f"{made['overall_recommendation']}: {sum(len(m['flags']) for m in made['module_results'])} findings, {made['checks_executed']} checks")
    for m in made["module_results"]:
        for f in m["flags"]:
            print(f"  {f['severity']:6} {m['module_name']:18} {f['affected_asset']}: {f['reason'][:70]}")
    return EXIT[made["overall_recommendation"]]


if __name__ == "__main__":
    import sys

    sys.exit(main())
