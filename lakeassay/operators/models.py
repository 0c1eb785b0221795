"""Model checks over tables of logits, activations and trigger masks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeassay.functions.vectors import clip, kl_divergence, relative_difference, softmax
from lakeassay.schemas import flags
from lakeassay.session import ship_package


@dataclass(frozen=True)
class LinearModel:
    """A white-box model: logits = weights @ x + bias.  Any object with these members will do."""

    name: str
    weights: np.ndarray
    bias: np.ndarray
    is_white_box: bool = True

    def logits(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights.T + self.bias

    def gradient(self, x: np.ndarray, d_logits: np.ndarray) -> np.ndarray:
        """Gradient with respect to the input, given that with respect to the logits."""
        return d_logits @ self.weights

    def save(self, path: str) -> None:
        """Write the model where :func:`load_model` reads it, a path ending in .npz."""
        np.savez(path, weights=self.weights, bias=self.bias)


#: Loaders of models by file ending; further kinds register here.
LOADERS: dict[str, Callable[[str], object]] = {}


def load_model(path: str) -> object:
    """A model by the ending of its path: .npz (weights, bias) natively, others by registered loaders.

    Unknown endings raise ValueError.
    """
    ending = path.rpartition(".")[2].lower()
    if ending in LOADERS:
        return LOADERS[ending](path)
    if ending == "npz":
        data = np.load(path)
        return LinearModel(path, data["weights"], data["bias"])
    raise ValueError(f"no loader for model files of kind .{ending}")


def predict(samples: DataFrame, model, features: str = "features", sample_id: str = "sample_id") -> DataFrame:
    """(sample_id, logits) of each sample, in batches on the workers."""
    ship_package(samples.sparkSession)
    shared = samples.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"sample_id": b["sample_id"], "logits": shared.value.logits(np.asarray(b["x"].tolist(), float)).tolist()})

    rows = samples.where(F.col(features).isNotNull()).select(F.col(sample_id).alias("sample_id"), F.col(features).cast("array<double>").alias("x"))
    return rows.mapInPandas(run, "sample_id long, logits array<double>")


def capability_flags(models: DataFrame, check: str) -> DataFrame:
    """One low flag for each model of (model_path, kind, is_white_box) that ``check`` cannot look into.

    Black-box models have no inner values at all, scripted ones none that can be read.
    """
    shut = models.where(~F.col("is_white_box") | (F.col("kind") == "scripted"))
    status = F.when(~F.col("is_white_box"), "unavailable").otherwise("unavailable_for_jit")
    mode = F.when(F.col("is_white_box"), "white_box").otherwise("black_box")
    return flags(shut, "model_integrity", F.lit(f"{check} needs to look into the model."), {"status": status, "access_mode_used": mode}, F.lit(0.0), F.lit("low"), F.col("model_path"), "accept")


def fingerprint(outputs: DataFrame, baseline: DataFrame) -> DataFrame:
    """One row: mean divergence of a model's output distributions from its baseline, and the samples compared.

    outputs: (sample_id, logits); baseline: (sample_id, probs).  Samples that one
    side lacks, or whose shapes differ, raise on evaluation.
    """
    both = outputs.select("sample_id", softmax(F.col("logits")).alias("q")).join(baseline.select("sample_id", F.col("probs").alias("p")), "sample_id", "full")
    bad = F.col("p").isNull() | F.col("q").isNull() | (F.size("p") != F.size("q"))
    kl = F.when(bad, F.raise_error(F.lit("baseline and outputs do not cover the same samples and classes")).cast("double")).otherwise(kl_divergence(F.col("p"), F.col("q")))
    return both.agg(F.avg(kl).alias("kl"), F.count(F.lit(1)).alias("n_samples"))


def fingerprint_flags(measured: DataFrame, model_path: str, threshold: float = 0.1, access_mode: str = "white_box") -> DataFrame:
    kl = F.col("kl")
    evidence = {"kl_divergence": F.round(kl, 6), "threshold": F.lit(threshold), "access_mode_used": F.lit(access_mode)}
    return flags(measured.where(kl > threshold), "model_integrity", F.lit("Outputs differ from the fingerprint."), evidence, clip(kl / (2 * threshold), 0.5, 1.0), F.when(kl > 2 * threshold, "high").otherwise("medium"), F.lit(model_path), "quarantine")


def activation_stats(activations: DataFrame, layer: str = "layer_name", value: str = "value", layer_kind: str | None = None) -> DataFrame:
    """(layer_name, mean, var): mean and population variance of each layer.

    With ``layer_kind`` only layers whose kind mentions Conv2d or Linear count.
    """
    rows = activations
    if layer_kind:
        rows = rows.where(F.col(layer_kind).contains("Conv2d") | F.col(layer_kind).contains("Linear"))
    return rows.groupBy(F.col(layer).alias("layer_name")).agg(F.avg(value).alias("mean"), F.var_pop(value).alias("var"))


def activation_drift(test: DataFrame, reference: DataFrame, threshold: float = 0.25) -> DataFrame:
    """Relative differences of mean and variance per layer; layers without a reference are skipped."""
    ref = reference.select("layer_name", F.col("mean").alias("ref_mean"), F.col("var").alias("ref_var"))
    both = test.select("layer_name", F.col("mean").alias("test_mean"), F.col("var").alias("test_var")).join(ref, "layer_name")
    both = both.withColumn("mean_diff", relative_difference(F.col("test_mean"), F.col("ref_mean"))).withColumn("var_diff", relative_difference(F.col("test_var"), F.col("ref_var")))
    return both.withColumn("drifted", (F.col("mean_diff") > threshold) | (F.col("var_diff") > threshold))


def drift_flags(measured: DataFrame, model_path: str, threshold: float = 0.25) -> DataFrame:
    worst = F.greatest("mean_diff", "var_diff")
    evidence = {k: F.round(k, 6) if k != "layer_name" else F.col(k) for k in ("layer_name", "test_mean", "ref_mean", "test_var", "ref_var", "mean_diff", "var_diff")} | {"access_mode_used": F.lit("white_box")}
    return flags(measured.where("drifted"), "model_integrity", F.lit("Activations of a layer drifted."), evidence, clip(worst / (2 * threshold), 0.5, 1.0), F.when(worst > 2 * threshold, "high").otherwise("medium"), F.lit(model_path), "review")


def mad_anomalies(masks: DataFrame, name: str = "target_class", size: str = "l1_norm") -> DataFrame:
    """Each mask with the set's median, its MAD (0 becomes 1e-6) and a one-sided anomaly index: small masks score high.

    The number of masks is the number of classes, so one-row aggregates are joined back.
    """
    mid = masks.agg(F.median(size).alias("median"))
    spread = masks.crossJoin(F.broadcast(mid)).agg(F.median(F.abs(F.col(size) - F.col("median"))).alias("mad"), F.first("median").alias("median"))
    spread = spread.withColumn("mad", F.when(F.col("mad") == 0, 1e-6).otherwise(F.col("mad")))
    return masks.crossJoin(F.broadcast(spread)).withColumn("anomaly_index", (F.col("median") - F.col(size)) / (1.4826 * F.col("mad"))).select(name, size, "median", "mad", "anomaly_index")


def anomaly_flags(measured: DataFrame, model_path: str, threshold: float = 2.0, access_mode: str = "white_box") -> DataFrame:
    index = F.col("anomaly_index")
    evidence = {"target_class": F.col("target_class"), "anomaly_index": F.round(index, 6), "trigger_l1_norm": F.round("l1_norm", 6), "median_l1_norm": F.round("median", 6), "access_mode_used": F.lit(access_mode)}
    return flags(measured.where(index > threshold), "model_integrity", F.lit("A class is reached by an unusually small change of the input."), evidence, clip((index - threshold) / 2 + 0.5, 0.5, 1.0), F.when(index > 3, "high").otherwise("medium"), F.lit(model_path), "quarantine")


def reconstruct_triggers(spark: SparkSession, model, clean: np.ndarray, n_classes: int, steps: int = 100, cost: float = 0.01, rate: float = 0.1) -> DataFrame:
    """(target_class, l1_norm): size of the smallest mask found that turns clean inputs into each class.

    Gradient descent (Adam) over mask = sigmoid(m), m from -2, and pattern = 2
    tanh(p), on cross-entropy plus ``cost`` times the mask's size.  One class a
    task; model and inputs are shipped once per worker.
    """
    ship_package(spark)
    shared = spark.sparkContext.broadcast((model, np.asarray(clean, float)))

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        net, x = shared.value
        target = int(batch["target_class"].iloc[0])
        size = x.shape[1]
        params = np.concatenate([np.full(size, -2.0), np.zeros(size)])
        first, second = np.zeros_like(params), np.zeros_like(params)
        for t in range(1, steps + 1):
            mask, pattern = 1 / (1 + np.exp(-params[:size])), 2 * np.tanh(params[size:])
            mixed = (1 - mask) * x + mask * pattern
            z = net.logits(mixed)
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[:, target] -= 1
            g = net.gradient(mixed, p / len(x))
            d_mask = (g * (pattern - x)).sum(0) + cost
            d_pattern = (g * mask).sum(0)
            grad = np.concatenate([d_mask * mask * (1 - mask), d_pattern * 2 * (1 - np.tanh(params[size:]) ** 2)])
            first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
            params -= rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
        return pd.DataFrame({"target_class": [target], "l1_norm": [float((1 / (1 + np.exp(-params[:size]))).sum())]})

    classes = spark.range(n_classes).select(F.col("id").cast("int").alias("target_class"))
    return classes.groupBy("target_class").applyInPandas(run, "target_class int, l1_norm double")


def as_column(x: Column | float) -> Column:
    return x if isinstance(x, Column) else F.lit(x)
