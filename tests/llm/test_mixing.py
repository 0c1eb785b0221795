"""Mixing sources: plan, selection, schedule."""

import pytest
from pyspark.sql import functions as F

from lakeassay.llm import mixing


@pytest.fixture(scope="module")
def sized(spark):
    data = [(i, "a" if i % 3 else "b", 5 + i % 7) for i in range(900)] + [(1000, None, 400), (1001, "c", 0), (1002, "a", 30)]
    return spark.createDataFrame(data, "doc_id long, source_key string, n_tokens long").cache()


TARGETS = "mix_id int, source string, target_share double, max_repeats int, budget_fraction double"


def test_source_spellings(spark):
    df = spark.createDataFrame([(s,) for s in ("Chat Logs", "CHAT-LOGS", " chat_logs", "Chatlogs", "chat.logs", "..", None)], "s string")
    assert [r[0] for r in df.select(mixing.source_key(F.col("s"))).collect()] == ["chatlogs"] * 5 + [None, None]


def test_plan_and_selection(spark, sized, monkeypatch):
    monkeypatch.setattr(mixing, "ROWS_PER_BUCKET", 50)
    targets = spark.createDataFrame([(1, "A", 0.5, 1, 0.4), (1, "b ", 0.5, 3, 2.0), (1, "none", 0.1, 2, 0.4), (2, "a", 1.0, 5, 2.0), (2, "C", 0.1, 9, 1.0)], TARGETS)
    planned = mixing.plan(sized, targets)
    p = {(r.mix_id, r.source): r for r in planned.collect()}
    total = sum(r.n_tokens for r in sized.collect())
    assert p[1, "A"].total_tokens == total and not p[1, "A"].short and p[1, "none"].short and p[2, "C"].short
    assert p[1, "b "].short == (3 * p[1, "b "].source_tokens < total)
    picked = mixing.select(sized, mixing.ramp(planned)).collect()
    for key, row in p.items():
        own = [r for r in picked if (r.mix_id, r.source) == key]
        tokens = sum(r.n_tokens for r in own)
        if row.demand == 0:
            assert not own
            continue
        assert row.demand <= tokens < row.demand + 40
        assert len({(r.doc_id, r.copy_no) for r in own}) == len(own) and max(r.copy_no for r in own) < row.max_repeats
        # copies of a document come in order, and earlier passes are complete
        assert all((r.doc_id, r.copy_no - 1) in {(x.doc_id, x.copy_no) for x in own} for r in own if r.copy_no)
    order = [(r.mix_id, r.position) for r in picked]
    assert order == sorted(order) and all(0 <= r.position < 1 for r in picked)
    shares = {(r.mix_id, r.source): r for r in mixing.reached(mixing.select(sized, mixing.ramp(planned)), planned).collect()}
    assert abs(sum(r.reached_share for k, r in shares.items() if k[0] == 1) - 1) < 1e-9


def test_schedule_follows_its_weights(spark):
    df = spark.range(0, 1000).select((F.col("id") / 1000).alias("f"))
    for w0, w1 in ((1.5, 0.5), (0.5, 1.5), (1.0, 1.0)):
        t = [r[0] for r in df.select(mixing.position(F.col("f"), F.lit(w0), F.lit(w1))).collect()]
        first = sum(x < 0.5 for x in t) / 1000
        assert t == sorted(t) and abs(first - (w0 + (w1 - w0) / 4) / 2) < 0.002


def test_sizes(spark):
    docs = spark.createDataFrame([(1, "hello world", "S"), (2, None, None), (3, "", "s"), (4, "<|endoftext|> x", "s"), (5, "word " * 300_000, "s")], "doc_id long, text string, source string").withColumn("n_tokens", F.lit(1))
    got = {r.doc_id: r.n_tokens for r in mixing.sizes(docs).collect()}
    enc = mixing.tokenizer(None)
    assert got == {1: 2, 2: 0, 3: 0, 4: len(enc.encode_ordinary("<|endoftext|> x")), 5: len(enc.encode_ordinary("word " * 300_000))}
    assert mixing.sizes(docs.limit(0)).count() == 0


def test_empty_tables(spark, sized):
    targets = spark.createDataFrame([(1, "a", 0.5, 1, 0.4)], TARGETS)
    r = mixing.plan(sized.limit(0), targets).first()
    assert r.demand == 0 and not r.short
    assert mixing.select(sized.limit(0), mixing.ramp(mixing.plan(sized.limit(0), targets))).count() == 0
    assert mixing.select(sized, mixing.ramp(mixing.plan(sized, targets.limit(0)))).count() == 0


def test_schedules_of_ones_own(spark):
    """Positions follow the inverse of the integral of piecewise linear weights."""
    import numpy as np

    sized = spark.createDataFrame([(i, "a" if i % 2 else "b", 1) for i in range(4000)], "doc_id long, source_key string, n_tokens long")
    targets = spark.createDataFrame([(1, s, 0.5, 1, 0.8) for s in ("a", "b")], "mix_id int, source string, target_share double, max_repeats int, budget_fraction double")
    knots = spark.createDataFrame([(1, "a", 0.25, 0.0), (1, "a", 0.5, 4.0), (1, "a", 0.5, 2.0), (1, "a", 0.75, 0.0), (1, "a", 7.0, 9.0), (1, "b", None, 1.0), (2, "b", 0.1, 1.0)], "mix_id int, source string, at double, weight double")
    plan = mixing.plan(sized, targets)
    rows = mixing.select(sized, mixing.schedule(plan, knots)).collect()
    a, b = (sorted(r.position for r in rows if r.source == s) for s in "ab")
    assert len(a) == len(b) == 1600
    grid = np.linspace(0, 1, 100_001)
    mass = np.concatenate([[0], np.cumsum(np.interp(grid[1:], [0, 0.25, 0.5, 0.75, 1], [0, 0, 4, 0, 0]))])
    want = np.interp(np.arange(1600) / 1600, mass / mass[-1], grid)
    assert np.abs(np.array(a)[1:] - want[1:]).max() < 0.002 and np.abs(np.array(b) - np.arange(1600) / 1600).max() < 1e-9
    assert mixing.select(sized, mixing.schedule(plan, knots.limit(0))).count() == 3200
