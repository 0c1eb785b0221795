"""Queries of the auditing operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeassay.functions.vectors import clip, dot, l2_normalize, norm, rbf, softmax, top_class
from lakeassay.operators import labels, models, outliers, provenance, report, scenarios, shift, similarity, spectral
from lakeassay.session import scratch_path, table
from lakeassay.sources import annotations as ann

#: The similarity above which the driver's random vectors count as near-duplicates.
SIMILAR = 0.45


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings")


def _halves(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(test, reference): odd and even ids."""
    e = _vectors(spark, sf)
    return e.where(F.col("vec_id") % 2 == 1), e.where(F.col("vec_id") % 2 == 0)


def _shifted(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """As above, with 0.1 added to every element of the test half."""
    test, ref = _halves(spark, sf)
    return test.withColumn("embedding", F.transform(F.col("embedding").cast("array<double>"), lambda x: x + 0.1)), ref


# --- annotations -----------------------------------------------------------------------


def yolo_parse(spark, sf):
    """Label texts read as annotations, unreadable numbers as null, with class names."""
    files = table(spark, sf, "label_files").select(F.col("file_id").cast("string").alias("stem"), F.col("content").alias("value"))
    out = ann.name_classes(ann.parse_lines(files, lenient=True), table(spark, sf, "class_names"))
    return out.select(F.col("stem").cast("long").alias("file_id"), "line_no", "class_id", "class_name", "x_center", "y_center", "width", "height")


def image_listing(spark, sf):
    """Paths with an image's ending, and their stems."""
    p = F.col("image_path")
    return table(spark, sf, "object_annotations").select("image_path").distinct().where(ann.ending(p).isin(*ann.IMAGE_ENDINGS)).select("image_path", ann.ending(p).alias("ending"), ann.stem(p).alias("stem"))


def _yolo_folder(spark, sf) -> DataFrame:
    """A YOLO folder of one image for each supplier, written and read back."""
    import numpy as np

    folder, dot = scratch_path(spark, "yolo"), ann.png(np.zeros((1, 1, 3), np.uint8))
    rows = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("idx"), F.col("s_nationkey").alias("label"), F.lit(dot).alias("content"))
    ann.write_yolo(rows, folder)
    names = table(spark, sf, "nation").select(F.col("n_nationkey").cast("int").alias("class_id"), F.col("n_name").alias("class_name"))
    return ann.read_yolo(spark, f"{folder}/images", f"{folder}/labels", names)


def yolo_folder(spark, sf):
    """Images in path order with their annotations, from a folder of files."""
    a = F.col("annotations")[0]
    return _yolo_folder(spark, sf).select("image_idx", F.regexp_extract("image_path", "[^/]*$", 0).alias("image"), F.size("annotations").alias("n_annotations"), a["class_id"].alias("class_id"), a["class_name"].alias("class_name"), a["bbox"]["x_center"].alias("x_center"), a["bbox"]["height"].alias("height"))


def training_labels(spark, sf):
    """The label of each training image: the class of its first line."""
    return ann.first_class(_yolo_folder(spark, sf)).select("image_idx", "label")


def coco_file(spark, sf):
    """A COCO file of one image a supplier, two boxes on every third, none on every seventh; read back."""
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").cast("int").alias("c"))
    images = s.select(F.struct(F.col("k").alias("id"), F.format_string("img_%d.jpg", "k").alias("file_name"), (F.lit(100) + F.col("k") % 7).cast("int").alias("width"), F.lit(200).alias("height")).alias("x"))
    box = F.array(F.lit(10.0), F.lit(20.0), (F.col("k") % 50).cast("double"), F.lit(40.0))
    boxes = s.where("k % 7 <> 0").select("k", "c", box.alias("b"), F.explode(F.when(F.col("k") % 3 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("n"))
    boxes = boxes.select(F.struct((F.col("k") * 2 + F.col("n")).alias("id"), F.col("k").alias("image_id"), (F.col("c") + F.col("n")).cast("int").alias("category_id"), F.col("b").alias("bbox")).alias("x"))
    names = table(spark, sf, "nation").select(F.struct(F.col("n_nationkey").cast("int").alias("id"), F.col("n_name").alias("name")).alias("x"))
    parts = [d.agg(F.collect_list("x").alias(n)) for n, d in (("images", images), ("annotations", boxes), ("categories", names))]
    path = scratch_path(spark, "coco")
    parts[0].crossJoin(parts[1]).crossJoin(parts[2]).select(F.to_json(F.struct("images", "annotations", "categories")).alias("value")).coalesce(1).write.text(path)
    a = F.col("a")
    read = ann.read_coco(spark, path, "root/").select("image_idx", "image_path", F.explode_outer("annotations").alias("a"))
    return read.select("image_idx", "image_path", a["class_id"].alias("class_id"), a["class_name"].alias("class_name"), F.round(a["bbox"]["x_center"], 6).alias("x_center"), F.round(a["bbox"]["width"], 6).alias("width"), F.round(a["bbox"]["y_center"], 6).alias("y_center"))


def coco_normalise(spark, sf):
    """Pixel boxes of line items in pictures of the size of their part, as centres and sizes."""
    li = table(spark, sf, "lineitem")
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), (F.col("p_size") * 10).alias("img_width"), (F.col("p_size") * 20).alias("img_height"))
    boxes = li.join(part, "l_partkey", "left").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("x"), (F.col("l_quantity") / 2).alias("y"), (F.col("l_discount") * 100).alias("w"), (F.col("l_tax") * 100).alias("h"), "img_width", "img_height")
    return ann.centre_boxes(boxes).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_boxes"), *[F.round(F.sum(c) + 1e-9, 4).alias(c) for c in ("x_center", "y_center", "width", "height")])


def dominant_label(spark, sf):
    """The dominant class of each order's items, the first met among equals, -1 without items."""
    items = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_suppkey") % 10).cast("int").alias("class_id"), "l_linenumber")
    return ann.dominant_class(table(spark, sf, "orders"), items, "o_orderkey", "class_id", "l_linenumber")


def class_names_join(spark, sf):
    """Names of annotated classes, null for a class without one."""
    rows = table(spark, sf, "object_annotations").where(F.col("class_id").isNotNull()).groupBy("class_id").agg(F.count(F.lit(1)).alias("n"))
    return ann.name_classes(rows, table(spark, sf, "class_names")).select("class_id", "class_name", "n")


# --- vectors and duplicates ------------------------------------------------------------


def vector_functions(spark, sf):
    """Norm, inner product with the reversed vector, kernel, softmax maximum, top class, clipped first element."""
    v, r = F.col("embedding"), F.reverse("embedding")
    return _vectors(spark, sf).select(
        "vec_id",
        F.round(norm(l2_normalize(v)), 5).alias("unit_norm"),
        F.round(dot(v, r), 5).alias("inner"),
        F.round(rbf(v, r, 1 / 64), 5).alias("kernel"),
        F.round(F.array_max(softmax(F.slice(v, 1, 10))), 5).alias("top_probability"),
        top_class(F.slice(v, 1, 10)).cast("int").alias("top_class"),
        F.round(clip(v[0].cast("double"), -0.1, 0.1), 5).alias("clipped"),
    )


def duplicate_members(spark, sf):
    """Every vector with its cluster, its links and its best similarity."""
    out = similarity.membership(_vectors(spark, sf), SIMILAR)
    return out.select(F.col("asset").alias("vec_id"), "cluster", F.col("n_links").cast("long").alias("n_links"), F.round("max_similarity", 5).alias("max_similarity"))


def duplicate_clusters(spark, sf):
    return similarity.clusters(_vectors(spark, sf), SIMILAR).select("cluster", "cluster_size", F.round("max_similarity", 5).alias("max_similarity"))


def knn_topk(spark, sf):
    """Five nearest neighbours of every vector whose id is divisible by 50, among all vectors."""
    e = _vectors(spark, sf)
    return similarity.nearest(e, e.where(F.col("vec_id") % 50 == 0), 5).select("query", "neighbour", F.round("sim", 5).alias("sim"), "rank")


def exact_content_duplicates(spark, sf):
    return provenance.content_duplicates(table(spark, sf, "documents"), "text", "doc_id")


# --- distribution shift ----------------------------------------------------------------


def ks_per_dim(spark, sf):
    return shift.ks_statistics(*_halves(spark, sf)).select("dim", F.round("ks", 6).alias("ks"), "n_test", "n_reference")


def _metrics(pair):
    return shift.metrics(*pair, asymptotic=True).select(F.round("mmd", 5).alias("mmd"), F.round("ks_ratio", 6).alias("ks_ratio"), "n_dims", "n_test", "n_reference")


def shift_metrics(spark, sf):
    """Flagship: has the odd half drifted from the even one?"""
    out = _metrics(_halves(spark, sf))
    drifted = (F.col("mmd") > 0.04) | (F.col("ks_ratio") > 0.15)
    return out.withColumn("verdict", F.when(drifted, "review").otherwise("accept"))


def shift_injected(spark, sf):
    """The same with a shift planted; both tests agree."""
    return _metrics(_shifted(spark, sf))


def shift_flag(spark, sf):
    out = shift.shift_flags(shift.metrics(*_shifted(spark, sf), asymptotic=True))
    return out.select("module", F.round("confidence", 4).alias("confidence"), "severity", "affected_asset", "recommended_disposition")


# --- models ----------------------------------------------------------------------------


def _logits(e: DataFrame, first: int) -> DataFrame:
    return e.select(F.col("vec_id").alias("sample_id"), F.slice(F.transform(F.col("embedding").cast("array<double>"), lambda x: x * 10), first, 10).alias("logits"))


def softmax_kl(spark, sf):
    """Divergence of the second ten dimensions' distribution from the first ten's."""
    e = _vectors(spark, sf)
    base = _logits(e, 1).select("sample_id", softmax(F.col("logits")).alias("probs"))
    return models.fingerprint(_logits(e, 11), base).select(F.round("kl", 5).alias("kl"), "n_samples")


def _layers(spark, sf) -> DataFrame:
    ev = table(spark, sf, "events")
    middle = ev.select(F.lit(0).alias("k"), "event_id").groupBy("k").agg(F.max("event_id").alias("top")).select((F.col("top") / 2).alias("half"))
    early = ev.crossJoin(F.broadcast(middle)).withColumn("side", F.when(F.col("event_id") <= F.col("half"), "reference").otherwise("test"))
    drift = F.when((F.col("side") == "test") & (F.col("event_type") == "error"), 3.0).otherwise(1.0)
    return early.select("side", F.col("event_type").alias("layer_name"), (F.col("value") * drift).alias("value"))


def activation_drift(spark, sf):
    """Mean and variance of event values per type, late against early half, one type scaled up."""
    rows = _layers(spark, sf)
    out = models.activation_drift(models.activation_stats(rows.where("side = 'test'")), models.activation_stats(rows.where("side = 'reference'")))
    return out.select("layer_name", *[F.round(c, 4).alias(c) for c in ("test_mean", "ref_mean", "test_var", "ref_var", "mean_diff", "var_diff")], "drifted")


def _masks(spark, sf) -> DataFrame:
    size = F.aggregate(F.transform(F.col("embedding").cast("array<double>"), F.abs), F.lit(0.0), lambda a, x: a + x)
    rows = _vectors(spark, sf).groupBy(F.col("label").alias("target_class")).agg(F.avg(size).alias("l1_norm"))
    return rows.withColumn("l1_norm", F.when(F.col("target_class") == 0, F.col("l1_norm") / 4).otherwise(F.col("l1_norm")))


def mad_anomaly(spark, sf):
    """Anomaly index of each class's mask size, class 0 made small."""
    out = models.mad_anomalies(_masks(spark, sf))
    return out.select("target_class", F.round("l1_norm", 5).alias("l1_norm"), F.round("median", 5).alias("median"), F.round("mad", 5).alias("mad"), F.round("anomaly_index", 2).alias("anomaly_index"), (F.col("anomaly_index") > 2).alias("flagged"))


def capability_gate(spark, sf):
    """Models that a white-box check cannot look into, one finding each."""
    rows = table(spark, sf, "supplier").select(F.col("s_name").alias("model_path"), F.when(F.col("s_suppkey") % 3 == 0, "scripted").otherwise("plain").alias("kind"), (F.col("s_suppkey") % 2 == 0).alias("is_white_box"))
    out = models.capability_flags(rows, "The activation check")
    return out.select("affected_asset", "severity", F.get_json_object("evidence", "$.status").alias("status"))


# --- provenance ------------------------------------------------------------------------


def _chain(spark, sf, only: int | None = None) -> DataFrame:
    """The events of each user (or of one) as a chain."""
    ev = table(spark, sf, "events")
    ev = ev if only is None else ev.where(F.col("user_id") == only)
    body = F.to_json(F.struct("event_id", "event_type"))
    return provenance.build_chains(ev.select(F.col("user_id").alias("chain_id"), F.col("event_id").alias("seq"), body.alias("payload"), F.lit("2024-01-01T00:00:00+00:00").alias("timestamp")))


def chain_build(spark, sf):
    return provenance.heads(_chain(spark, sf))


def chain_verify(spark, sf):
    return provenance.verify_chains(_chain(spark, sf))


def chain_tamper(spark, sf):
    """Verification after every 97th event's payload was rewritten."""
    c = _chain(spark, sf)
    return provenance.verify_chains(c.withColumn("payload", F.when(F.col("seq") % 97 == 5, F.concat("payload", F.lit(" "))).otherwise(F.col("payload"))))


def chain_audit(spark, sf):
    """Records whose own hash or link fails after tampering with every 97th hash."""
    c = _chain(spark, sf)
    bad = c.withColumn("record_hash", F.when(F.col("seq") % 97 == 5, F.sha2(F.col("record_hash"), 256)).otherwise(F.col("record_hash")))
    return provenance.check_links(bad).where("not self_ok or not link_ok").select("chain_id", "seq", "self_ok", "link_ok")


def chain_lookup(spark, sf):
    return provenance.lookup(_chain(spark, sf, 8), 8, 0).select("chain_id", "seq", F.get_json_object("payload", "$.event_type").alias("event_type"), "prev_hash")


def signature_gate(spark, sf):
    """Documents' digests as signatures, some blank, odd or not hexadecimal: which can be checked at all."""
    d, h = table(spark, sf, "documents"), F.sha2(F.coalesce("text", F.lit("")), 256)
    i = F.col("doc_id") % 7
    sig = F.when(i == 0, F.lit("")).when(i == 1, F.concat(h, F.lit("a"))).when(i == 2, F.concat(F.lit("zz"), h)).otherwise(h)
    rows = d.select(F.col("doc_id").alias("record_index"), sig.alias("signature"))
    return rows.select("record_index", F.when(provenance.missing(F.col("signature")), "missing").when(~provenance.is_hex(F.col("signature")), "bad").otherwise("checkable").alias("state"))


# --- spectra ---------------------------------------------------------------------------


def _pictures(spark, sf) -> DataFrame:
    """Vectors as 8 x 8 pictures of 0.4 to 0.6, every 25th with a planted checkerboard."""
    px = F.transform(F.col("embedding").cast("array<double>"), lambda x: 0.5 + x / 10)
    planted = scenarios.patch(px, 8, 8, size=4, margin=0)
    return _vectors(spark, sf).select(F.col("vec_id").cast("string").alias("asset"), F.when(F.col("vec_id") % 25 == 0, planted).otherwise(px).alias("pixels"))


def _scanned(spark, sf) -> DataFrame:
    return spectral.scan_arrays(_pictures(spark, sf), F.col("asset"), F.col("pixels"), 8, block=4)


def block_spectrum(spark, sf):
    return _scanned(spark, sf).select("asset", F.round("max_ratio", 5).alias("max_ratio"), F.round("avg_ratio", 5).alias("avg_ratio"), "n_blocks")


def trigger_scan(spark, sf):
    """Pictures flagged for one block rich in high frequencies."""
    out = spectral.trigger_flags(_scanned(spark, sf), 4, 0.25, 2.0)
    return out.select("affected_asset", "severity", F.round("confidence", 4).alias("confidence"), F.get_json_object("evidence", "$.block_coords_x_y").alias("block"))


# --- planted faults --------------------------------------------------------------------


def label_flip_inject(spark, sf):
    return scenarios.flip_labels(_vectors(spark, sf).select("vec_id", "label"), "vec_id", "label")


def dup_flood(spark, sf):
    """Fifty vectors added again; only ids and labels are shown."""
    return scenarios.flood_duplicates(_vectors(spark, sf), "vec_id", "embedding").select("vec_id", "label", "planted")


def backdoor_relabel(spark, sf):
    return scenarios.relabel_backdoor(_vectors(spark, sf).select("vec_id", "label"), "vec_id", "label")


# --- learned detectors (no SQL) --------------------------------------------------------


def ood_flags(spark, sf):
    """Odd vectors outside the distribution of even ones, every 40th moved far away."""
    test, ref = _halves(spark, sf)
    far = F.transform(F.col("embedding"), lambda x: F.when(F.col("vec_id") % 40 == 1, x + 1.0).otherwise(x).cast("float"))
    return outliers.ood_flags(outliers.scores(test.withColumn("embedding", far), ref)).drop("id")


def label_flip_flags(spark, sf):
    return labels.label_flip_flags(labels.annotated_probability(_vectors(spark, sf)), 0.02).drop("id")


def trigger_reconstruct(spark, sf):
    """Smallest trigger mask of each class of a linear model fitted to class means, class 0 made easy."""
    import numpy as np

    means = _vectors(spark, sf).select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x")).groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v")).orderBy("label").collect()
    w = np.array([[p["x"] for p in r["v"]] for r in means]) * 20
    w[0, :4] += 6
    clean = np.array([r["embedding"] for r in _vectors(spark, sf).orderBy("vec_id").limit(16).collect()])
    net = models.LinearModel("class-means", w, np.zeros(len(w)))
    return models.mad_anomalies(models.reconstruct_triggers(spark, net, clean, len(w)))


def sign_verify(spark, sf):
    """Every document's digest signed and checked, every 11th altered after signing."""
    import hashlib

    from lakeassay.operators import ed25519
    from lakeassay.session import ship_package

    ship_package(spark)
    secret = hashlib.sha256(b"a key for tests").digest()

    @F.pandas_udf("string")
    def sign(bundle):
        import json

        return bundle.map(lambda b: provenance.sign_bundle(json.loads(b), secret).hex())

    d = table(spark, sf, "documents")
    rows = d.select(F.col("doc_id").alias("record_index"), F.to_json(F.struct(F.sha2(F.coalesce("text", F.lit("")), 256).alias("input_hash"))).alias("bundle"))
    signed = rows.withColumn("signature", sign("bundle")).withColumn("bundle", F.when(F.col("record_index") % 11 == 0, F.lit('{"input_hash": "changed"}')).otherwise(F.col("bundle")))
    return provenance.verify_signatures(signed, ed25519.public_key(secret))


# --- roll-up ---------------------------------------------------------------------------


def _all_flags(spark, sf) -> DataFrame:
    masks = models.anomaly_flags(models.mad_anomalies(_masks(spark, sf)), "model")
    rows = _layers(spark, sf)
    drift = models.drift_flags(models.activation_drift(models.activation_stats(rows.where("side = 'test'")), models.activation_stats(rows.where("side = 'reference'"))), "model")
    return report.unite([spectral.trigger_flags(_scanned(spark, sf), 4, 0.25, 2.0), masks, drift, shift.shift_flags(shift.metrics(*_shifted(spark, sf), asymptotic=True))])


def flags_union(spark, sf):
    return _all_flags(spark, sf).groupBy("check_no", "module", "severity", "recommended_disposition").agg(F.count(F.lit(1)).alias("n"))


def severity_rollup(spark, sf):
    return report.by_module(_all_flags(spark, sf))


def overall_verdict(spark, sf):
    return report.verdict(_all_flags(spark, sf), 4)


def flags_explorer(spark, sf):
    """High flags, as shown to a reader."""
    return report.explore(_all_flags(spark, sf), severities=["high"], modules=["model_integrity", "distribution_shift"]).select("module_label", "severity", "affected_asset", "recommended_disposition")


QUERIES = {
    f.__name__: f
    for f in (
        yolo_folder, training_labels, coco_file, yolo_parse, image_listing, coco_normalise, dominant_label, class_names_join, vector_functions, duplicate_members, duplicate_clusters, knn_topk, exact_content_duplicates, ks_per_dim, shift_metrics, shift_injected, shift_flag, softmax_kl, activation_drift, mad_anomaly,
        capability_gate, chain_build, chain_verify, chain_tamper, chain_audit, chain_lookup, signature_gate, block_spectrum, trigger_scan, label_flip_inject, dup_flood, backdoor_relabel, ood_flags, label_flip_flags, trigger_reconstruct, sign_verify, flags_union, severity_rollup, overall_verdict, flags_explorer,
    )
}
