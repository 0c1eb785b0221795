"""The auditing operators on small fixtures."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeassay.functions import vectors as V
from lakeassay.operators import audit, ed25519, labels, models, outliers, provenance, report, scenarios, shift, similarity, spectral
from lakeassay.schemas import FLAG, info_flag, invalid_flags
from lakeassay.sources import annotations as ann
from lakeassay.sources import images as img
from lakeassay.streaming.chain import append_stream


def frame(spark, matrix, start=0, label=None):
    data = [(start + i, [float(x) for x in v], None if label is None else int(label[i])) for i, v in enumerate(matrix)]
    return spark.createDataFrame(data, "vec_id long, embedding array<float>, label int")


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<double>, z array<double>")
    r = df.select(V.l2_normalize(F.col("a")), V.l2_normalize(F.col("z")), V.l2_normalize(F.col("z"), guard=False), V.dot(F.col("a"), F.col("a")), V.softmax(F.col("a")), V.shorten(F.lit("abcdef"), 3), V.format_percent(F.lit(0.256))).first()
    assert r[0] == [0.6, 0.8] and r[1] == [0, 0] and all(map(math.isnan, r[2])) and r[3] == 25 and abs(sum(r[4]) - 1) < 1e-12 and r[5] == "abc…" and r[6] == "26%"


def brute_clusters(x, t):
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    s = u @ u.T
    root = list(range(len(x)))
    for _ in x:
        for i in range(len(x)):
            for j in range(len(x)):
                if i != j and s[i, j] >= t:
                    root[i] = root[j] = min(root[i], root[j])
    return root


@pytest.mark.parametrize("block", [8, 2048])
def test_duplicates_against_brute_force(spark, block, monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(12, 6))
    x = np.vstack([base[rng.integers(0, 12, 50)] + rng.normal(0, 0.05, (50, 6)), np.repeat(base[:1], 20, axis=0), np.zeros((2, 6))]).astype(np.float32)
    classes, _ = similarity.unit_classes(frame(spark, x), "vec_id", "embedding")
    found = similarity.links(classes, 0.97, block=block, pivots=5)
    ids = [r["id"] for r in classes.collect()]
    u = x / np.maximum(np.linalg.norm(x.astype(float), axis=1, keepdims=True), 1e-12)
    want = {(a, b) for a in ids for b in ids if a < b and u[a] @ u[b] >= 0.97}
    assert {(r.src, r.dst) for r in found.collect()} == want
    member = {r.asset: r.cluster for r in similarity.membership(frame(spark, x), 0.97).collect()}
    root = brute_clusters(x.astype(float), 0.97)
    nonzero = range(70)
    assert [member[i] for i in nonzero] == [root[i] for i in nonzero]


def test_long_chain_of_links(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 999)], "src long, dst long")
    roots = {r.id: r.root for r in similarity.components(edges).collect()}
    assert set(roots[i] for i in range(301)) == {0} and roots[1000] == roots[999] == 999
    assert similarity.components(edges.limit(0)).count() == 0


def test_nearest(spark):
    x = np.random.default_rng(1).normal(size=(60, 5)).astype(np.float32)
    df = frame(spark, x)
    got = {(r.query, r["rank"]): r.neighbour for r in similarity.nearest(df, df.where("vec_id % 7 = 0"), 3, block=16).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(0, 60, 7):
        s = u[q].astype(float) @ u.T.astype(float)
        s[q] = -9
        assert [got[q, k] for k in (1, 2, 3)] == np.argsort(-s, kind="stable")[:3].tolist()


def test_shift_detects_and_passes(spark):
    rng = np.random.default_rng(42)
    ref, same, moved = rng.normal(0, 0.5, (50, 16)), rng.normal(0, 0.5, (30, 16)), rng.normal(0.8, 0.5, (30, 16))
    ok = shift.shift_flags(shift.metrics(frame(spark, same), frame(spark, ref)), 0.2, 0.25)
    bad = shift.shift_flags(shift.metrics(frame(spark, moved), frame(spark, ref)), 0.2, 0.25).collect()
    assert ok.count() == 0 and len(bad) == 1 and bad[0].confidence > 0.85 and bad[0].severity == "high"
    exact = shift.mmd(frame(spark, moved), frame(spark, ref), block=7).first()[0]
    k = lambda a, b: np.exp(-((a[:, None] - b[None]) ** 2).sum(2) / 16).mean()
    a, b = (np.float32(z).astype(float) for z in (moved, ref))
    assert abs(exact - math.sqrt(k(a, a) - 2 * k(a, b) + k(b, b))) < 1e-9
    about = shift.mmd_features(frame(spark, moved), frame(spark, ref)).first()[0]
    assert abs(about - exact) < 0.1
    with pytest.raises(ValueError):
        shift.mmd(frame(spark, same[:, :4]), frame(spark, ref))


def test_ks_critical_values():
    assert abs(shift.ks_critical(250, 250) - 0.124) < 1e-9
    # by counting all arrangements of 3 and 3: D = 1 has probability 2/20
    assert shift.ks_critical(3, 3, 0.11) == 1.0


def test_ks_with_ties(spark):
    a, b = np.array([[0.0], [0.0], [1.0], [5.0]]), np.array([[0.0], [2.0], [2.0]])
    r = shift.ks_statistics(frame(spark, a), frame(spark, b)).first()
    assert abs(r.ks - (0.75 - 1 / 3)) < 1e-12


def test_outliers(spark):
    rng = np.random.default_rng(42)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    ref = unit(rng.normal(0, 0.5, (50, 16)))
    test = np.vstack([unit(rng.normal(0, 0.5, (4, 16))), np.full((1, 16), 10.0)])
    scored = outliers.scores(frame(spark, test), frame(spark, ref), contamination=0.1)
    assert "4" in {r.affected_asset for r in outliers.ood_flags(scored).collect()}
    with pytest.raises(ValueError):
        outliers.scores(frame(spark, test), frame(spark, ref).limit(0))


def test_label_flips(spark):
    rng = np.random.default_rng(42)
    x = np.vstack([rng.normal(2, 0.5, (10, 8)), rng.normal(-2, 0.5, (10, 8))])
    y = [0] * 10 + [1] * 10
    y[2] = 1
    assert {r.affected_asset for r in labels.label_flip_flags(labels.annotated_probability(frame(spark, x, label=y), n_splits=3), 0.15).collect()} == {"2"}
    assert labels.annotated_probability(frame(spark, x, label=[1] * 20)).count() == 0


def test_trigger_scan():
    plain = np.full((128, 128), 128 / 255)
    patched = plain.copy()
    y, x = np.mgrid[:32, :32]
    patched[64:96, 64:96] = (y + x) % 2
    assert spectral.block_ratios(plain, 32, 0.25)[0] < 1e-9
    most, mean, bx, by, n = spectral.block_ratios(patched, 32, 0.25)
    assert (bx, by, n) == (64, 64, 16) and most > 0.2 and most > 1.5 * mean
    assert spectral.block_ratios(plain[:20, :20], 64, 0.35)[4] == 1


def test_image_source(spark, tmp_path):
    # a minimal bitmap: 2 x 1 pixels, blue and white
    head = b"BM" + (62).to_bytes(4, "little") + bytes(4) + (54).to_bytes(4, "little")
    info = (40).to_bytes(4, "little") + (2).to_bytes(4, "little") + (1).to_bytes(4, "little") + (1).to_bytes(2, "little") + (24).to_bytes(2, "little") + bytes(4) + (8).to_bytes(4, "little") + bytes(16)
    (tmp_path / "a.bmp").write_bytes(head + info + bytes([255, 0, 0, 255, 255, 255, 0, 0]))
    (tmp_path / "b.png").write_bytes(b"no image")
    (tmp_path / "c.jpg").write_bytes(b"")
    (tmp_path / "d.tif").write_bytes(b"")
    read = img.read_images(spark, str(tmp_path))
    assert img.reference_batch(read, least=1).shape == (1, 3, 1, 2) and img.reference_batch(read) is None
    assert spectral.scan_images(read, block=2).count() == 1
    e = img.embed(read, lambda: lambda px: np.array([[p.mean(), 1.0] for p in px])).first()
    assert abs(sum(v * v for v in e.embedding) - 1) < 1e-6
    assert [r.image_path[-5:] for r in ann.list_images(spark, str(tmp_path)).collect()] == ["a.bmp", "b.png", "c.jpg"]


def test_yolo_and_coco(spark, tmp_path):
    (tmp_path / "images").mkdir()
    (tmp_path / "labels").mkdir()
    for n in ("x.png", "y.jpg"):
        (tmp_path / "images" / n).write_bytes(b"")
    (tmp_path / "labels" / "x.txt").write_text("0 0.5 0.5 1 1\n1 0.2 0.2 0.1 0.1 7\n3 1 1\n")
    names = spark.createDataFrame([(0, "zero")], "class_id int, class_name string")
    got = ann.read_yolo(spark, str(tmp_path / "images"), str(tmp_path / "labels"), names).collect()
    assert [(a.class_id, a.class_name) for a in got[0].annotations] == [(0, "zero"), (1, None)] and got[1].annotations == []
    doc = {"images": [{"id": 5, "file_name": "b", "width": 100, "height": 100}, {"id": 2, "file_name": "a"}], "categories": [{"id": 1, "name": "c"}], "annotations": [{"id": 1, "image_id": 5, "category_id": 1, "bbox": [10, 20, 30, 40]}, {"id": 2, "image_id": 5, "category_id": 1}]}
    (tmp_path / "coco.json").write_text(json.dumps(doc))
    got = ann.read_coco(spark, str(tmp_path / "coco.json"), "/d").collect()
    assert [(r.image_idx, r.image_path, len(r.annotations)) for r in got] == [(0, "/d/a", 0), (1, "/d/b", 2)]
    box = got[1].annotations[0].bbox
    assert max(abs(a - b) for a, b in zip(box, (0.25, 0.40, 0.30, 0.40))) < 1e-9 and got[1].annotations[1].bbox is None


def test_dominant_class(spark):
    images = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    boxes = spark.createDataFrame([(1, 5, 0), (1, 4, 1), (1, 4, 2), (1, 5, 3), (2, 9, 0)], "k int, c int, n int")
    assert {tuple(r) for r in ann.dominant_class(images, boxes, "k", "c", "n").collect()} == {(1, 5), (2, 9), (3, -1)}


def test_fingerprint_and_drift(spark):
    z = np.random.default_rng(0).normal(size=(16, 10))
    out = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(z)], "sample_id long, logits array<double>")
    base = out.select("sample_id", V.softmax(F.col("logits")).alias("probs"))
    assert models.fingerprint_flags(models.fingerprint(out, base), "m").count() == 0
    turned = base.withColumn("probs", F.reverse("probs"))
    assert models.fingerprint_flags(models.fingerprint(out, turned), "m").count() == 1
    with pytest.raises(Exception, match="baseline"):
        models.fingerprint(out, base.where("sample_id > 0")).collect()
    stats = spark.createDataFrame([("conv", 1.0, 2.0), ("fc", 0.0, 0.0)], "layer_name string, mean double, var double")
    off = stats.withColumn("mean", F.when(F.col("layer_name") == "conv", F.col("mean") + 10).otherwise(F.col("mean")))
    assert models.drift_flags(models.activation_drift(stats, stats), "m").count() == 0
    assert [json.loads(r.evidence)["layer_name"] for r in models.drift_flags(models.activation_drift(stats, off), "m").collect()] == ["conv"]
    gate = spark.createDataFrame([("a", "plain", False), ("b", "scripted", True), ("c", "plain", True)], "model_path string, kind string, is_white_box boolean")
    assert {(r.affected_asset, r.severity) for r in models.capability_flags(gate, "x").collect()} == {("a", "low"), ("b", "low")}
    flat = spark.createDataFrame([(i, 5.0) for i in range(4)], "target_class int, l1_norm double")
    assert models.mad_anomalies(flat).first().mad == 1e-6


def test_trigger_reconstruction(spark):
    rng = np.random.default_rng(0)
    w = rng.normal(0, 0.3, (5, 30))
    w[0, :2] += 8
    net = models.LinearModel("m", w, np.zeros(5))
    found = models.mad_anomalies(models.reconstruct_triggers(spark, net, rng.normal(size=(16, 30)), 5, steps=60))
    assert min(found.collect(), key=lambda r: r.l1_norm).target_class == 0
    x = spark.createDataFrame([(1, [0.0] * 30)], "sample_id long, features array<double>")
    assert models.predict(x, net).first().logits == [0.0] * 5


def test_load_model(tmp_path):
    np.savez(tmp_path / "m.npz", weights=np.ones((2, 3)), bias=np.zeros(2))
    assert models.load_model(str(tmp_path / "m.npz")).logits(np.ones((1, 3))).tolist() == [[3.0, 3.0]]
    with pytest.raises(ValueError):
        models.load_model("m.xyz")


def test_ed25519_vectors():
    # RFC 8032, 7.1, tests 1 and 2
    for secret, public, message, signature in (
        ("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60", "d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a", "", "e5564300c360ac729086e2cc806e828a84877f1eb8e5d974d873e065224901555fb8821590a33bacc61e39701cf9b46bd25bf5f0595bbe24655141438e7a100b"),
        ("4ccd089b28ff96da9db6c346ec114e0f5b8a319f35aba624da8cf6ed4fb8a6fb", "3d4017c3e843895a92b70aa74d1b7ebc9c982ccf2ec4968cc0cd55f12af4660c", "72", "92a009a9f0d4cab8720e820b5f642540a2b27b5416503f8fb3762223ebdb69da085ac1e43e15996e458f3613d0f11d8c387b2eaeb4302aeeb00d291612bb0c00"),
    ):
        s, p, m, g = map(bytes.fromhex, (secret, public, message, signature))
        assert ed25519.public_key(s) == p and ed25519.sign(s, m) == g and ed25519.verify(p, m, g)
        assert not ed25519.verify(p, m + b"x", g) and not ed25519.verify(p, m, g[:-1] + bytes([g[-1] ^ 1])) and not ed25519.verify(p, m, b"")


def test_bundles_and_signatures(spark):
    secret, public = ed25519.generate()
    b = provenance.make_bundle("a" * 64, "b" * 64, provenance.hash_config({"y": 1, "x": 2}), {"k": [1, None]})
    g = provenance.sign_bundle(b, secret)
    assert provenance.verify_bundle(b, g, public)
    for k, v in (("output", 1), ("input_hash", "c"), ("timestamp", "now")):
        assert not provenance.verify_bundle(b | {k: v}, g, public)
    text = json.dumps(b)
    data = [(0, text, g.hex()), (1, text, "zz"), (2, text, None), (3, "", g.hex()), (4, "{no json", g.hex()), (5, text, g.hex()[:-2]), (6, text, g.hex()[1:])]
    checked = provenance.verify_signatures(spark.createDataFrame(data, "record_index int, bundle string, signature string"), public)
    assert [r.state for r in checked.orderBy("record_index").collect()] == ["ok", "bad", "missing", "missing", "bad", "bad", "bad"]
    assert sorted(r.severity for r in provenance.signature_flags(checked).collect()) == ["high"] * 4 + ["medium"] * 2


def test_hashing(spark, tmp_path):
    (tmp_path / "f").write_bytes(b"abc")
    want = "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    assert provenance.hash_file(str(tmp_path / "f")) == provenance.hash_config(str(tmp_path / "f")) == want
    assert provenance.file_hashes(spark, str(tmp_path)).first().sha256 == want
    assert provenance.hash_config({"a": 1, "b": 2}) == provenance.hash_config({"b": 2, "a": 1})


def test_chain_log(spark, tmp_path):
    log = provenance.ChainLog(spark, f"file://{tmp_path}/log")
    assert log.verify() == (True, None) and len(log) == 0 and log.get(1) is None
    assert log.append([{"b": 1, "a": "é\"\\"}]) == 1 and log.append([{"n": 2}, {"n": 3}]) == 3
    assert log.verify() == (True, None) and len(log) == 3 and log.get(2)["payload"] == {"n": 2}
    t = log.table()
    broken = t.withColumn("payload", F.when(F.col("seq") == 2, F.lit("{}")).otherwise(F.col("payload")))
    v = provenance.verify_chains(broken).first()
    assert (v.valid, v.broken_seq) == (False, 2)
    # a record that was hashed anew betrays itself by its successor
    h = provenance.record_hash(F.col("payload"), F.col("prev_hash"), F.col("timestamp"))
    forged = broken.withColumn("record_hash", F.when(F.col("seq") == 2, h).otherwise(F.col("record_hash")))
    assert provenance.verify_chains(forged).first().broken_seq == 3
    assert provenance.verify_chains(t.where("seq < 3")).first().valid
    assert provenance.chain_flags(provenance.verify_chains(broken), "db").first().severity == "high"


def test_long_chain_across_runs(spark):
    rows = spark.range(1, 41).select(F.lit(1).alias("chain_id"), (F.col("id") * 3).alias("seq"), F.concat(F.lit("p"), F.col("id")).alias("payload"), F.lit("t").alias("timestamp"))
    c = provenance.build_chains(rows)
    assert provenance.check_links(c, run=7).where("not self_ok or not link_ok").count() == 0
    bad = c.withColumn("prev_hash", F.when(F.col("seq") == 63, F.lit("0")).otherwise(F.col("prev_hash")))
    assert [r.seq for r in provenance.check_links(bad, run=7).where("not link_ok").collect()] == [63]


def test_streaming_chain(spark, tmp_path):
    schema = "chain_id long, seq long, payload string, timestamp string"
    source, path = str(tmp_path / "in"), f"file://{tmp_path}/chain"
    for at in (1, 4):
        spark.createDataFrame([(c, s, f"p{s}", "t") for c in (1, 2) for s in range(at, at + 3)], schema).coalesce(1).write.mode("append").parquet(source)
        q = append_stream(spark.readStream.schema(schema).parquet(source), path, str(tmp_path / "cp"), {"availableNow": True})
        q.awaitTermination()
    v = provenance.verify_chains(spark.read.parquet(path))
    assert sorted((r.chain_id, r.n_records, r.valid) for r in v.collect()) == [(1, 6, True), (2, 6, True)]


def test_scenarios(spark):
    df = spark.createDataFrame([(i, i % 10, [float(i)]) for i in range(100)], "id long, label int, v array<float>")
    f = scenarios.flip_labels(df, "id", "label")
    assert f.where("planted").count() == 5 and f.where("planted and label = (id % 10 + 1) % 10").count() == 5
    d = scenarios.flood_duplicates(df, "id", "v", 7, noise=1e-3)
    assert d.count() == 107 and d.select("id").distinct().count() == 107
    b = scenarios.relabel_backdoor(df, "id", "label", k=20)
    assert b.where("label = 0").count() == 30
    px = spark.createDataFrame([([0.5] * 64,)], "p array<double>").select(scenarios.patch(F.col("p"), 8, 8)).first()[0]
    assert sum(x != 0.5 for x in px) == 16 and px[8 * 2 + 2] != 0.5 and px[0] == 0.5
    assert scenarios.synthetic_images(spark, 20).groupBy("label").count().where("count = 2").count() == 10


def _flag(spark, *severities):
    data = [(str(i), "provenance", "<b>reason</b>", '{"k":1}', 0.5, s, "a<sset", "review") for i, s in enumerate(severities)]
    return spark.createDataFrame(data, FLAG)


@pytest.mark.parametrize(("severities", "want"), [((), "accept"), (("low",), "accept"), (("medium",), "review"), (("low", "high"), "quarantine"), (("medium", "high"), "quarantine")])
def test_verdict(spark, severities, want):
    assert report.verdict(_flag(spark, *severities)).first().overall_recommendation == want


def test_report_files(spark, tmp_path):
    made = report.assemble(_flag(spark, "medium", "low"), "ds", "model", "log", {}, "black_box")
    as_json, as_html = report.write(made, str(tmp_path / "new" / "dir"))
    assert json.loads(as_json.read_text())["overall_recommendation"] == "review"
    page = as_html.read_text()
    assert "provenance" in page and "<b>reason" not in page and "a&lt;sset" in page
    assert {r.module: r.n_flags for r in report.by_module(_flag(spark, "low")).collect()}["provenance"] == 1
    assert invalid_flags(_flag(spark, "low", "urgent")).count() == 1 and invalid_flags(info_flag(spark, "provenance", "r", "d")).count() == 0
    assert report.explore(_flag(spark, "low", "high", "medium")).first().severity == "high"
    assert [r.n for r in report.numbered(spark.range(50).select((F.col("id") * 7 % 50).alias("k")), "k", "n").orderBy("k").collect()] == list(range(50))


def test_audit(spark, tmp_path):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, 8))
    x[1] = x[0]
    chain = provenance.build_chains(spark.createDataFrame([(0, 1, "p", "t"), (0, 2, "q", "t")], "chain_id long, seq long, payload string, timestamp string")).withColumn("payload", F.lit("changed"))
    broken = spark.createDataFrame([(1,)], "nothing int")
    made = audit.audit(spark, audit.Inputs(test=frame(spark, x, label=rng.integers(0, 2, 40)), chain=chain, masks=broken), "d", "m", str(tmp_path))
    flags = [f for m in made["module_results"] for f in m["flags"]]
    assert [m["module_name"] for m in made["module_results"]] == ["data_integrity", "model_integrity", "provenance", "distribution_shift"]
    assert made["overall_recommendation"] == "quarantine" and made["checks_executed"] == 3
    assert any("failed" in f["reason"] for f in flags) and any("skipped" in f["reason"] for f in flags)
    assert any(f["module"] == "provenance" and f["severity"] == "high" for f in flags)
    assert audit.EXIT[made["overall_recommendation"]] == 1


def test_ks_critical_is_exact_beyond_2000_rows():
    from math import comb

    n = 2500
    tail = lambda k: 2 * sum((-1) ** (j + 1) * comb(2 * n, n + j * k) for j in range(1, n // k + 1)) / comb(2 * n, n)
    k = round(shift.ks_critical(n, n) * n)
    assert tail(k) < 0.05 <= tail(k - 1)
    assert shift.ks_critical(n, n) == k / n


def test_chains_of_any_text(spark):
    """Built in Python, verified in the JVM: every control character, quotes, other scripts, nulls."""
    import hashlib
    import json

    texts = [chr(c) for c in range(1, 160)] + ['"\\\\/<>&', "Prüfung ß", "\u2028\u2029", "\U0001f600 a", "漢字", "", None]
    rows = [(1, i, t, None if i == 3 else f"t{t or ''}") for i, t in enumerate(texts)]
    c = provenance.build_chains(spark.createDataFrame(rows, "chain_id long, seq long, payload string, timestamp string"))
    v = provenance.verify_chains(c).first()
    assert (v.n_records, v.valid, v.broken_seq) == (len(texts), True, None)
    prev = "0" * 64
    for r in c.orderBy("seq").collect():
        form = json.dumps({"prev_hash": prev, "payload": r.payload, "timestamp": r.timestamp}, sort_keys=True, separators=(",", ":"))
        prev = hashlib.sha256(form.encode()).hexdigest()
        assert r.record_hash == prev


def test_two_chains_in_one_folder(spark, tmp_path):
    one, two = (provenance.ChainLog(spark, f"file://{tmp_path}/log", k) for k in (1, 2))
    assert (one.append([{"a": 1}, {"a": 2}]), two.append([{"b": 1}]), one.append([{"a": 3}])) == (2, 1, 3)
    assert (len(one), len(two)) == (3, 1) and two.get(1)["payload"] == {"b": 1} and two.get(1)["prev_hash"] == provenance.GENESIS
    assert one.verify() == two.verify() == (True, None)


def test_late_stream_records_are_kept_apart(spark, tmp_path):
    schema = "chain_id long, seq long, payload string, timestamp string"
    source, path = str(tmp_path / "in"), f"file://{tmp_path}/chain"
    for rows in ([(1, 1, "a", "t"), (1, 5, "b", "t")], [(1, 5, "b", "t"), (1, 3, "late", "t"), (1, 6, "c", "t")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        append_stream(spark.readStream.schema(schema).parquet(source), path, str(tmp_path / "cp"), {"availableNow": True}).awaitTermination()
    assert [r.seq for r in spark.read.parquet(path).orderBy("seq").collect()] == [1, 5, 6]
    assert [(r.seq, r.payload) for r in spark.read.parquet(path + "_late").collect()] == [(3, "late")]
    assert provenance.verify_chains(spark.read.parquet(path)).first().valid


def test_a_third_of_equal_vectors(spark):
    """Equal vectors are one class, however many, and fill no single block; zeros of either sign are equal."""
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(size=(60, 4)), np.tile([1.0, 0.0, 2.0, 0.0], (30, 1)), np.tile([1.0, -0.0, 2.0, -0.0], (3, 1))]).astype(np.float32)
    got = {r.asset: r for r in similarity.membership(frame(spark, x), 0.999999).collect()}
    assert len(got) == 93 and {(got[i].cluster, got[i].n_copies) for i in range(60, 93)} == {(60, 33)}
    y = rng.normal(size=(40, 4)).astype(np.float32)
    both = np.vstack([x, y]).astype(float)
    k = np.exp(-((both[:, None] - both[None]) ** 2).sum(2) / 4)
    a, b = slice(0, 93), slice(93, None)
    want = math.sqrt(k[a, a].mean() - 2 * k[a, b].mean() + k[b, b].mean())
    assert abs(shift.mmd(frame(spark, x), frame(spark, y), block=16).first().mmd - want) < 1e-9


def test_ks_with_one_extreme_value(spark):
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=(300, 2)).astype(np.float32), rng.normal(0.3, 1, size=(200, 2)).astype(np.float32)
    x[0, 0] = 1e30
    got = {r.dim: r.ks for r in shift.ks_statistics(frame(spark, x), frame(spark, y)).collect()}
    for d in (0, 1):
        grid = np.concatenate([x[:, d], y[:, d]])
        want = max(abs((x[:, d] <= v).mean() - (y[:, d] <= v).mean()) for v in grid)
        assert abs(got[d] - want) < 1e-12


def test_key_files(tmp_path):
    from lakeassay.operators import ed25519

    secret, public = ed25519.generate()
    path = str(tmp_path / "key.pem")
    ed25519.save_key(secret, path)
    assert ed25519.load_key(path) == secret and (tmp_path / "key.pem").stat().st_mode & 0o77 == 0
    assert ed25519.verify(public, b"m", ed25519.sign(ed25519.load_key(path), b"m"))
    for text in ("", "no key", "-----BEGIN PRIVATE KEY-----\nAAAA\n-----END PRIVATE KEY-----\n"):
        (tmp_path / "other.pem").write_text(text)
        with pytest.raises(ValueError):
            ed25519.load_key(str(tmp_path / "other.pem"))


def test_yolo_folder_round_trip(spark, tmp_path):
    dot = ann.png(np.full((2, 3, 3), 7, np.uint8))
    rows = spark.createDataFrame([(0, 4, dot, "x"), (1, 0, None, "x"), (None, 1, dot, "x"), (12, 3, dot, "x")], "idx long, label int, content binary, stem string")
    assert ann.write_yolo(rows, str(tmp_path)) == 3 and ann.write_yolo(rows.limit(0), str(tmp_path)) == 0
    for root in (str(tmp_path), f"file://{tmp_path}"):
        got = ann.read_yolo(spark, f"{root}/images", f"{root}/labels").collect()
        assert [(r.image_idx, r.image_path[-15:], r.annotations[0].class_id, r.annotations[0].bbox.width) for r in got] == [(0, "synth_00000.png", 4, 1.0), (1, "synth_00001.png", 0, 1.0), (2, "synth_00012.png", 3, 1.0)]
    (tmp_path / "labels" / "synth_00012.txt").unlink()
    (tmp_path / "images" / "b.jpg").write_bytes(b"")
    read = ann.read_yolo(spark, f"{tmp_path}/images", f"{tmp_path}/labels")
    assert sorted(r.label for r in ann.first_class(read).collect()) == [0, 0, 4]
    seen = spark.read.format("image").load(f"{tmp_path}/images/synth_00000.png").select("image.width", "image.height", "image.data").first()
    assert (seen.width, seen.height, bytes(seen.data)) == (3, 2, bytes([7] * 18))


def test_models_and_gates(spark, tmp_path):
    from lakeassay.operators import labels, models

    made = models.LinearModel("m", np.eye(2), np.ones(2))
    made.save(str(tmp_path / "m.npz"))
    assert (models.load_model(str(tmp_path / "m.npz")).weights == np.eye(2)).all()
    assert not labels.any_labelled(frame(spark, np.ones((3, 2)), label=[-1, -1, -1])) and labels.any_labelled(frame(spark, np.ones((3, 2)), label=[-1, 0, -1]))
    broken = spark.createDataFrame([(1,)], "other int")
    found, done = audit.run(spark, audit.Inputs(test=frame(spark, np.ones((3, 2)), label=[-1, -1, -1]), activations=broken, reference_stats=broken, model_path="net"))
    rows = {(r.reason, r.severity, r.confidence, r.affected_asset) for r in found.collect()}
    assert ("Activations could not be read.", "high", 1.0, "net") in rows and ("Check skipped: label flips.", "low", 0.0, "pipeline") in rows and done == 1
