"""Scoring of abusive, hateful and sexual language."""

import numpy as np
import pytest

from lakeassay.llm import toxicity as X


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("You  USELESS\nthing!", " you useles thing "),
        ("you uuuseeeless th​ing", " you useles thing "),
        ("you U.S.E.L.E.S.S thing", " you useles thing "),
        ("уоu ｕｓｅｌｅｓｓ thіng", " you useles thing "),
        ("y0u us3l3ss 7h1ng", " you useles thing "),
        ("you use-less thing", " you useles thing "),
        ("use**ss 12.5 and 7", " use**s 0 and 0 "),
        ("", "  "),
    ],
)
def test_canonical(text, want):
    assert X.canonical(text) == want


def test_kernel_is_that_of_shared_subsequences():
    """Landmark kernels against a count over explicit features."""
    texts = [" abcab xyz ", " ab*ab xyq ", " hello abc "]
    codes = [X.codes(t) for t in texts]

    def explicit(c):
        out = {}
        for h, sound, w in X.features(c):
            for f in h[sound]:
                out[f] = out.get(f, 0) + w
        return out

    marks = X.Landmarks(codes, 3)
    long = np.concatenate([x for c in codes for x in (c, np.zeros(8, np.int64))])
    ends = np.cumsum([len(c) + 8 for c in codes])
    raw = marks._raw(long, np.concatenate([[0], ends[:-1]]), ends - 8)
    phi = [explicit(c) for c in codes]
    want = [[sum(v * q.get(f, 0) for f, v in p.items()) for q in phi] for p in phi]
    assert np.allclose(raw, want, rtol=1e-5)


def test_folded_table_decides_like_the_kernel():
    texts = [" you are a fool and a liar ", " the box is near the gate "]
    codes = [X.codes(t) for t in texts]
    marks = X.Landmarks(codes, 2)
    w = np.array([0.7, -0.3])[: marks.root.shape[1]]
    long = np.concatenate([x for c in codes for x in (c, np.zeros(8, np.int64))])
    starts, ends = np.array([0, len(codes[0]) + 8]), np.array([len(codes[0]), len(long) - 8])
    table = marks.fold(w)
    assert np.allclose(marks.map(long, starts, ends) @ w, [X.position_sums(c, table).sum() for c in codes], atol=1e-4)


def test_svm_separates():
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(1, 0.5, (50, 3)), rng.normal(-1, 0.5, (60, 3))])
    y = np.array([1.0] * 50 + [-1.0] * 60)
    w = X.solve_svm(x, y, np.ones(110))
    assert ((x @ w[:-1] + w[-1] > 0) == (y > 0)).mean() > 0.97


@pytest.fixture(scope="module")
def model(spark, sf):
    return X.train(spark.read.parquet(sf + "/content_labels.parquet").where("sample_id % 4 <> 0"), spark.read.parquet(sf + "/documents.parquet"))


def test_held_out_accuracy(spark, sf, model):
    """A quarter of the labels is held out; a few of them are labelled wrongly."""
    held = spark.read.parquet(sf + "/content_labels.parquet").where("sample_id % 4 = 0").collect()
    right = [(s[0] > 0) == (r.category != "none") for s, r in zip(model.scores([r.sample_text for r in held]), held)]
    assert np.mean(right) > 0.9


def test_disguises_keep_the_score(model):
    plain, *masked = ["Shut your mouth, you idiot, nobody asked for your boxes", "SHUT YOUR MOUTH, YOU I D I O T, nobody asked for your boxes!!!", "shut yоur mоuth, you id-iot, nobody asked for your boxes", "shut your m*uth, you iiidiot, nobody a5ked for your boxes"]
    assert model.scores([plain])[0][0] > 0
    assert all(s[0] > 0 for s in model.scores(masked))
    assert model.scores(["The night reviewer will drop the grainy training split."])[0][0] < 0


def test_long_and_empty_texts(spark, model):
    bad = "Shut your mouth, you idiot, nobody asked for your boxes"
    docs = spark.createDataFrame([(1, None, "s"), (2, "", "S"), (3, " .", None), (4, "box at the gate. " * 40_000 + bad, "s"), (5, bad, "s"), (5, bad, "s")], "doc_id long, text string, source string")
    got = X.score(docs, model)
    assert [(r.doc_id, r.score is not None and r.score > 0) for r in got.orderBy("doc_id").collect()] == [(1, False), (2, False), (3, False), (4, True), (5, True), (5, True)]
    rates = {r.source_key: (r.n_documents, r.n_flagged) for r in X.rates(got).collect()}
    assert rates == {"s": (5, 3), None: (1, 0)}
    assert X.score(docs.limit(0), model).count() == 0
    assert model.scores([bad]) == model.scores([bad, None, "x" * 70_000])[:1]


def test_letters_spelt_out_with_any_marks():
    for spelt in ("c/o/w/a/r/d", "c+o+w+a+r+d", "c,o,w,a,r,d", "c  o  w  a  r  d", "c, o, w, a, r, d"):
        assert X.canonical(f"you are a  / {spelt}!") == " you are a coward "
