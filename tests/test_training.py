"""The general training-data operators against brute force and on awkward input."""

import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeassay.operators import nested, packing, profile, rejects, sampling
from lakeassay.session import scratch_path

FILES = "file_id long, image_path string, content string, path string, block_id int"


def test_archive_round_trip(spark):
    texts = ["a\nb", "", None, "ü" * 5000, "same", "same", "x" * 3_000_000]
    df = spark.createDataFrame([(i, f"p{i % 3}", t, "clash", 7) for i, t in enumerate(texts)], FILES)
    out = scratch_path(spark, "t")
    packing.pack(df, out, block_bytes=4000)
    back = {r["file_id"]: r for r in packing.members(packing.archive(spark, out)).collect()}
    assert len(back) == len(texts) and all(r["sound"] for r in back.values())
    assert {i: (None if r["content"] is None else bytes(r["content"]).decode()) for i, r in back.items()} == dict(enumerate(texts))
    assert {r["file_id"] for r in packing.lookup(spark, out, ["p1"]).collect()} == {1, 4}


def test_archive_of_nothing(spark):
    out = scratch_path(spark, "t")
    packing.pack(spark.createDataFrame([], FILES), out)
    assert packing.index(spark, out).count() == 0
    assert packing.repeated_records(packing.label_records(packing.members(packing.archive(spark, out)))).count() == 0


@pytest.mark.parametrize(
    ("path", "same"),
    [("a/b.png", "a/b.png"), ("./a//b.png", "a/b.png"), (".\\a\\b.png", "a/b.png"), ("a/x/../b.png", "a/b.png"), ("../a/./b.png", "a/b.png"), ("/a/b.PNG", "a/b.PNG"), ("a..b/c.png", "a..b/c.png"), (None, None)],
)
def test_canonical_path(spark, path, same):
    df = spark.createDataFrame([(path,)], "p string")
    assert df.select(packing.canonical_path(F.col("p"))).first()[0] == same


def _repeats(files):
    seen, out = set(), set()
    for file_id, image, content in sorted(files, key=lambda f: f[0]):
        for n, line in enumerate((content or "").split("\n"), 1):
            t = line.split()
            if len(t) >= 5 and image is not None:
                try:
                    key = (image, *map(float, t[:5]))
                except ValueError:
                    key = (image, *t[:5])
                if key in seen:
                    out.add((file_id, n))
                seen.add(key)
    return out


@pytest.mark.parametrize("wide", [False, True])
def test_repeated_records(spark, wide):
    rng = random.Random(4)
    forms = ["1 .5 0.5 1e0 1", "1 0.50 .5 1.0 1.000", "1\t0.5  .5\t1 1 extra", "1 .5 .5 1", "x y z a b", "x y z a b", "", "  2 0 0 0 0 \r", "2 -0.0 0 0 0"]
    # one image holds most of the records
    files = [(i, None if i % 17 == 3 else "hot" if i % 3 else f"img{i % 5}", "\n".join(rng.choices(forms, k=rng.randint(0, 6)))) for i in range(120)]
    df = spark.createDataFrame(files, "file_id long, path string, content string")
    records = packing.label_records(df, wide)
    assert {tuple(r) for r in packing.repeated_records(records).collect()} == _repeats(files)
    first = packing.first_records(records)
    assert first.agg(F.sum("n_copies")).first()[0] - first.count() == len(_repeats(files))


REPORT = (
    "report_id long, received_at timestamp, extra string, module_results array<struct<module_name:string, flags:array<struct<id:string, module_name:string, reason:string, evidence:string, confidence:double, "
    "severity:string, affected_asset:string, recommended_disposition:string>>, coverage_statement:string, access_mode_used:string>>"
)


def _paths(value, path=""):
    if isinstance(value, dict):
        for k, v in value.items():
            yield from _paths(v, f"{path}.{k}" if path else k)
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from _paths(v, f"{path}[{i}]")
    elif value is not None:
        yield path


def test_nested_reports(spark):
    from datetime import datetime

    inner = {"a": {"b": [1, None, {"c": ""}]}, "t": '{"not": "decoded"}', "n": None, "e": [], "f": 1e400}
    texts = [json.dumps(inner), json.dumps(json.dumps(inner)), json.dumps(json.dumps(json.dumps([inner, inner]))), "", "null", "3", '"text"', None, "{broken", "[[[[1]]]]", json.dumps(dict(reversed(inner.items())))]
    flag = lambda e: ("i", "m", "r", e, 0.5, "low", "a", "accept")
    modules = [("m", [flag(t) for t in texts], None, None), None, ("m", None, "c", "x"), ("m", [None, flag('{"k":true}')], None, None)]
    when = [datetime(2025, 1, 1), datetime(2025, 1, 2)]
    data = [(1, when[0], "x", modules), (1, when[1], "x", modules), (2, when[0], None, None), (3, None, None, []), (None, when[0], None, modules)]
    flat = nested.flatten(spark.createDataFrame(data, REPORT))
    got = sorted((r.report_id, r.module_no, r.flag_no, r.evidence_path) for r in nested.occurrences(flat).collect())
    want = []
    for m, module in enumerate(modules):
        for f, x in enumerate((module or (0, None))[1] or []):
            v = x[3] if x else None
            while isinstance(v, str):
                try:
                    v = json.loads(v)
                except ValueError:
                    v = None
            if isinstance(v, dict | list):
                want += [(1, m, f, p) for p in _paths(v)]
    assert got == sorted(want)
    assert flat.reports.count() == 3
    assert [r.n_flags for r in flat.modules.orderBy("module_no").collect()] == [len(texts), 0, 0, 2]
    # the same object under another member order and in a list is stored once
    assert flat.nodes.count() == flat.nodes.select("node_id").distinct().count()
    roots = {r.flag_no: r.root_id for r in flat.flags.where("module_no = 0").collect()}
    assert roots[0] == roots[1] == roots[10] and roots[3] is roots[4] is roots[5] is None


def test_nested_empty(spark):
    assert nested.occurrences(nested.flatten(spark.createDataFrame([], REPORT))).count() == 0


LINES = [
    "p,0,n,0.5,.5,0.5,.5", 'p,1,"a, ""b""",1,.5,1.,.5', 'p, 1 ,"x\ny", 0.25 ,.5,+1e-1,oops', '"p","1",,"0","","1",""', "", None, "p;1;n;.5;.5;.5;.5", "p,1,n,.5,.5,.5", "p,1,n,.5,.5,.5,.5,", 'p,1,"open,.5,.5,.5,.5',
    'p,1,a "q" b,.5,.5,.5,.5', 'p, "1",n,.5,.5,.5,.5', "p,9,n,.5,.5,.5,.5", "p,1.0,n,.5,.5,.5,.5", "p,３,n,.5,.5,.5,.5", "p,99999999999999999999,n,.5,.5,.5,.5", "p,1,n,NaN,.5,.5,.5", "p,1,n,0x1p-1,.5,.5,.5", "p,1,n,1e400,.5,.5,.5",
    "p,1,n,.5,.5,0,.5", "p,1,n,.5,.5,−0.5,.5", "p,1,n,.5,.5,1d,.5", 'p,1,"a"b,.5,.5,.5,.5', '"', '""', ",,,,,,", "p,1,n,.5,.5,.5,.5\r", 'p,1,"' + "z" * 3000 + '",.5,.5,.5,.5', "p,01,n,.5,.5,.5,.5",
]


def test_rejects_match_the_grammar(spark):
    rng = random.Random(2)
    data = [(i, rng.choice(["f1", "f2", None]), raw) for i, raw in enumerate(LINES * 30)]
    rng.shuffle(data)
    df = spark.createDataFrame(data, "line_id long, export_file string, raw_line string").withColumn("reason", F.lit("clash"))
    got = {r.line_id: r.reason for r in rejects.load_lines(df, [0, 1], lines_per_read=200).collect()}
    want = {i: "column_count" if raw is None else rejects.structure(raw) or rejects._value_fault(raw, frozenset([0, 1])) for i, _, raw in data}
    assert got == want
    assert len(set(want.values())) == 6


def test_rejects_typed_values(spark):
    df = spark.createDataFrame([(1, "f", 'p, 1 ,"x\ny", 0.25 ,.5,+1e-1,oops')], "line_id long, export_file string, raw_line string")
    r = rejects.load_lines(df, [1]).first()
    assert (r.reason, r.class_id, r.class_name, r.x_center, r.y_center, r.width, r.height) == (None, 1, "x\ny", 0.25, 0.5, 0.1, None)
    assert rejects.load_lines(df.limit(0), [1]).count() == 0


def _targets(spark, data):
    return spark.createDataFrame(data, "request_id int, class_id int, target_share double, min_rows long, sample_fraction double")


def test_sampling_is_exact(spark):
    ids = [(i, 0 if i % 3 == 0 else 1 if i % 10 else 2, 9) for i in range(6000)]
    rows = spark.createDataFrame(ids + ids[:500] + [(7000, None, 9), (None, 1, 9)], "annotation_id long, class_id int, category int")
    planned = sampling.plan(_targets(spark, [(1, 0, 0.5, 1, 0.1), (1, 1, 0.4, 1, 0.1), (1, 2, 0.1, 900, 0.1), (1, 8, 0.1, 0, 0.1), (2, 0, 0.9, 0, 1.0), (2, None, 0.1, 1, 1.0)]), sampling.observe(rows))
    plan = {(r.request_id, r.class_id): r for r in planned.collect()}
    assert plan[1, 0].total == 6001 and plan[1, 0].wanted == 300 and plan[1, 2].wanted == 900 and plan[1, 8].misses_share and plan[2, 0].misses_share and not plan[1, 1].misses_share
    drawn = sampling.draw(sampling.distinct_items(rows), planned)
    counts = {(r.request_id, r.class_id): (r["n"], r["d"]) for r in drawn.groupBy("request_id", "class_id").agg(F.count("item").alias("n"), F.countDistinct("item").alias("d")).collect()}
    assert counts == {k: (p.quota, p.quota) for k, p in plan.items() if p.quota}
    assert sampling.draw(sampling.distinct_items(rows.limit(0)), planned).count() == 0


def test_sampling_of_nothing(spark):
    rows = spark.createDataFrame([], "annotation_id long, class_id int")
    r = sampling.plan(_targets(spark, [(1, 0, 0.5, 3, 0.1)]), sampling.observe(rows)).first()
    assert (r.observed, r.deficit, r.misses_minimum) == (0, 3, True)


def test_profile_and_expressions(spark):
    schema = T.StructType([T.StructField("load", T.LongType()), T.StructField("s", T.StringType()), T.StructField("b", T.StructType([T.StructField("x", T.DoubleType())]))])
    data = [(1, f"id_{i:03d}.png", (i / 100,)) for i in range(100)] + [(2, "odd value!", (float("nan"),)), (2, None, None), (2, "id_001.png", (0.5,)), (None, "id_002.png", (2.0,))]
    df = spark.createDataFrame(data, schema)
    p = {(r.load_id, r.column_name): r for r in profile.standard_profile(df, "load").collect()}
    assert (p[1, "x"].n_distinct, p[1, "x"].min_number, p[2, "x"].n_nulls, p[2, "x"].n_distinct, p[2, "x"].max_number, p[None, "s"].n_rows) == (100, 0.0, 1, 2, 0.5, 1)
    induced = profile.induce_expressions(df, "s", "load", r"^id_[0-9]{3}\.png$")
    assert [(r.expression, r.n_values, r.sound) for r in induced.collect()] == [(r"id_\d\d\d\.png", 100, True)]
    c = {r.load_id: r for r in profile.coverage(df, "load", "s", induced, r"^id_[0-9]{3}\.png$").collect()}
    assert (c[1].n_nonconforming, c[2].n_values, c[2].n_nonconforming, c[2].n_malformed) == (0, 2, 1, 1)


def test_issues(spark):
    rng = random.Random(1)
    data = [(1, rng.random(), "a1") for _ in range(400)] + [(2, 0.5, "a1" if i % 2 else "??") for i in range(400)] + [(3, None, "a1")] * 10 + [(4, 7.0, None)] * 5
    df = spark.createDataFrame(data, "load long, x double, s string")
    x = F.col("x")
    col = profile.NumericColumn("x", "x", ~F.isnan(x) & (x >= 0) & (x <= 1), [(i / 2, i / 2 + 0.5, 0.5) for i in range(2)], 1.0)
    got = {tuple(r) for r in profile.issues(df, "load", [col], "s", r"^[a-z][0-9]$").collect()}
    assert got == {(2, "x", "distribution"), (2, "x", "distinct"), (2, "s", "pattern"), (3, "x", "nulls"), (4, "x", "range")}
    assert profile.issues(df.limit(0), "load", [col], "s", "^a$").count() == 0


def test_every_column_is_profiled(spark, sf):
    from lakeassay.plans import catalog

    rows = spark.read.parquet(f"{sf}/object_annotations.parquet").cache()
    texts = {"image_path", "dataset_id", "class_name", "annotator"}
    assert {r.column_name for r in catalog.QUERIES["p5_expressions"](spark, sf).collect()} == texts
    cover = {(r.load_id, r.column_name): r for r in catalog.QUERIES["p5_coverage"](spark, sf).collect()}
    assert {c for _, c in cover} == texts
    names = [r[0] for r in spark.read.parquet(f"{sf}/class_names.parquet").select("class_name").collect()]
    strange = F.col("class_name").isNotNull() & ~F.col("class_name").isin(names)
    want = {r.load_id: (r.n, r.bad) for r in rows.groupBy("load_id").agg(F.count("class_name").alias("n"), F.count_if(strange).alias("bad")).collect()}
    assert sum(bad for _, bad in want.values()) > 0
    assert {k: (r.n_values, r.n_malformed) for (k, c), r in cover.items() if c == "class_name"} == {k: v for k, v in want.items() if v[0]}
    times = texts | {"annotated_at", "loaded_at"}
    ends = rows.groupBy("load_id").agg(*[f(F.col(c).cast("string")).alias(f"{c}_{k}") for c in times for k, f in (("min", F.min), ("max", F.max))]).collect()
    got = {(r.load_id, r.column_name): (r.min_text, r.max_text) for r in catalog.QUERIES["p5_ranges"](spark, sf).collect()}
    assert got == {(r.load_id, c): (r[f"{c}_min"], r[f"{c}_max"]) for r in ends for c in times}
    rows.unpersist()


def test_invalid_counts_of_all_sides(spark, tmp_path):
    from lakeassay.plans import catalog

    nan = float("nan")
    box = "struct<x_center:double, y_center:double, width:double, height:double>"
    data = [(1, 0, (0.5, 1.5, 0.0, 0.5)), (1, 9, (nan, nan, nan, 2.0)), (1, None, None), (1, 0, (0.0, 1.0, 1.0, 1.0)), (2, 0, (None, -0.1, None, 0.1))]
    spark.createDataFrame(data, f"load_id long, class_id int, bbox {box}").write.parquet(f"{tmp_path}/object_annotations.parquet")
    spark.createDataFrame([(0, "a")], "class_id int, class_name string").write.parquet(f"{tmp_path}/class_names.parquet")
    spark.createDataFrame([], "column_name string, bucket_no int, lower_bound double, upper_bound double, expected_share double").write.parquet(f"{tmp_path}/column_baseline.parquet")
    got = {tuple(r) for r in catalog.QUERIES["p5_invalid"](spark, str(tmp_path)).collect()}
    one = {(1, "x_center", 3, 1), (1, "y_center", 3, 2), (1, "width", 3, 2), (1, "height", 3, 1), (1, "class_id", 3, 1)}
    two = {(2, "x_center", 0, 0), (2, "y_center", 1, 1), (2, "width", 0, 0), (2, "height", 1, 0), (2, "class_id", 1, 0)}
    assert got == one | two


def test_lookup_over_very_many_blocks(spark):
    n = (1 << 16) + 1000
    out = scratch_path(spark, "t")
    entry = F.struct(F.col("id").alias("file_id"), F.lit("p").alias("path"), F.lit(0).cast("long").alias("offset"), F.lit(1).cast("long").alias("length"), F.crc32(F.lit(b"x")).alias("crc32"))
    spark.range(n).select(F.col("id").alias("block_id"), F.array(entry).alias("entries"), F.lit(b"x").alias("payload")).write.parquet(out)
    assert packing.archive(spark, out).count() == n
    assert packing.lookup(spark, out, ["p"]).count() == n
    assert packing.lookup(spark, out, ["q"]).count() == 0


def test_cells_of_a_control_character(spark):
    """A cell that is the reader's null marker is a text like any other."""
    rows = [(1, "f", "\x01,1,a,0.5,0.5,0.5,0.5"), (2, "f", '"\x01",1,\x01,0.5,\x01,0.5,0.5'), (3, "f", "a.jpg,\x01,a,0.5,0.5,0.5,0.5"), (4, "f", "a.jpg,1,a,0.5,0.5,\x01,0.5")]
    got = rejects.load_lines(spark.createDataFrame(rows, "line_id long, export_file string, raw_line string"), [1]).orderBy("line_id").collect()
    assert [(r.reason, r.image_path, r.class_name, r.y_center) for r in got] == [(None, "\x01", "a", 0.5), (None, "\x01", "\x01", None), ("class_id", None, None, None), ("width", None, None, None)]


def test_shortfalls_come_from_the_drawn_sample(spark):
    items = spark.createDataFrame([(i, 1 if i < 90 else 2) for i in range(100)], "annotation_id long, class_id int")
    targets = spark.createDataFrame([(1, 1, 0.5, 5, 1.0), (1, 2, 0.104, 0, 1.0), (1, 3, 0.0, 1, 1.0), (2, 2, 0.1, 10, 1.0), (2, 3, 0.0, 0, 1.0), (3, 2, None, 11, None)], "request_id int, class_id int, target_share double, min_rows long, sample_fraction double")
    planned = sampling.plan(targets, sampling.observe(items))
    shared = sampling.shares(sampling.draw(sampling.distinct_items(items), planned), planned)
    assert sorted((r.request_id, r.class_id) for r in sampling.unmet(shared).collect()) == [(1, 2), (1, 3), (3, 2)]


def test_expression_levels_mix(spark):
    """Many names of one make are one general expression, a few of one form a special one, odd values none."""
    rng = random.Random(4)
    names = {"".join(rng.choices("abcdefghij", k=rng.randint(4, 60))) + "-" + "7" * rng.randint(1, 9) for _ in range(300)}
    values = [*names, *(f"Report of shift {i:02d}, gate seven" for i in range(20)), "?? !"]
    df = spark.createDataFrame([(1, v) for v in values], "load long, s string")
    got = {r.expression: (r.level, r.n_values) for r in profile.induce_expressions(df, "s", "load").collect()}
    assert got == {r"[A-Za-z]+-\d+": ("runs", len(names)), r"Report of shift \d\d\, gate seven": ("fixed", 20)}
    cover = profile.described_coverage(df, "load", "s").first()
    assert (cover.n_values, cover.n_nonconforming) == (len(values), 1)
    judged = profile.described_coverage(df, "load", "s", "^Report").first()
    assert judged.n_malformed == len(names) + 1


def test_json_of_any_depth(spark):
    """The parser for deep texts reads what the standard one reads, and evidence of any depth keeps its scalars."""
    rng = random.Random(3)

    def made(depth):
        kind = rng.randrange(8 if depth else 5)
        if kind < 5:
            return [None, True, rng.randint(-50, 50), 1.5e-7, "q\u2028\"\\\n é"][kind]
        return [made(depth - 1) for _ in range(rng.randrange(4))] if kind < 7 else {rng.choice(["a", "b", ""]): made(depth - 1) for _ in range(rng.randrange(4))}

    def read(text, how):
        try:
            return how(text)
        except ValueError:
            return "no JSON"

    texts = [json.dumps(made(5), indent=rng.choice([None, 1]), ensure_ascii=bool(i % 2)) for i in range(200)]
    texts += ["".join(rng.choices('{}[]:,"a1 ', k=rng.randint(1, 8))) for _ in range(3000)] + ["", " ", "[1,]", '{"a":1,}', "[1 2]", "01", "-", "NaN", "[Infinity]", '"a\nb"', "[1]]", '{"a":1,"a":2}', "tru"]
    number = nested._Number
    for t in texts:
        assert read(t, nested.parse) == read(t, lambda x: json.loads(x, parse_float=number, parse_int=number, parse_constant=number)), t
    n = 5000
    deep = '{"k":' * n + '"low"' + "}" * n
    wrapped = "x"
    for _ in range(9):
        wrapped = json.dumps({"w": wrapped} if wrapped == "x" else wrapped)
    flag = [("i", "m", "r", t, 0.5, "low", "a", "accept") for t in (deep, "[" * n + "7" + "]" * n, wrapped, "[" * n)]
    flat = nested.flatten(spark.createDataFrame([(1, None, "x", [("m", flag, None, None)] * 2)], REPORT))
    got = {(r.module_no, r.flag_no): (r.evidence_path, r.scalar) for r in nested.occurrences(flat).collect()}
    assert got == {(m, f): x for m in (0, 1) for f, x in enumerate([(".".join("k" * n), "low"), ("[0]" * n, "7"), ("w", "x")])}
    assert flat.flag_objects.count() == 4 and flat.module_objects.collect()[0].n_occurrences == 2
    assert flat.flags.select("node_id").distinct().join(flat.flag_objects, "node_id").count() == 4


def test_a_damaged_member_is_an_error(spark):
    out = scratch_path(spark, "t")
    packing.pack(spark.createDataFrame([(i, f"p{i}", f"text {i}", "c", 7) for i in range(5)], FILES), out)
    blocks = packing.archive(spark, out)
    assert packing.checked(packing.members(blocks)).where("length(content) = 6").count() == 5
    harmed = blocks.withColumn("payload", F.encode(F.translate(F.decode("payload", "UTF-8"), "3", "8"), "UTF-8"))
    assert packing.members(harmed).where("not sound").count() == 1
    with pytest.raises(Exception, match="checksum of member 3 does not hold"):
        packing.checked(packing.members(harmed)).where("length(content) = 6").count()
