"""Leakage of evaluation items: reading, automaton, operator."""

import random

import pytest

from lakeassay.llm.leakage import build, leaked_documents, leaked_spans, remove_spans, spans
from lakeassay.llm.text import word_places, words

PLAIN = "The Müller trial of thirty-four pictures kept one für cœur façade showing"


@pytest.mark.parametrize(
    "text",
    [
        PLAIN.upper(),
        "The <b>Mül</b>ler trial&nbsp;of thirty&#45;four pictures kept one f&uuml;r c&oelig;ur fa&ccedil;ade showing",
        "The M\\u00fcller trial of thirty-four pictures kept one f\\u00fcr c\\u0153ur fa\\u00e7ade\\nshowing",
        "The Müller tri­al of thirty-four pic​tures kept one für c⁠œur façade showing",
        "Тhе Mullеr triаl оf thirty-four pictures kept one fur coeur facade showing",
        "Ｔｈｅ Ｍüｌｌｅｒ ｔｒｉａｌ of thirty-four pictures kept one für cœur façade ｓｈｏｗｉｎｇ",
        "The | Müller | trial | of | thirty-four | pictures | kept | one | für | cœur | façade | showing |",
        "_The_ **Müller** `trial` of thirty_four pictures, kept: [one](http://x.y/z_(w)) für cœur “façade” sho**wi**ng",
        "> The Müller trial of thirty-\n> four pic-\n> tures kept one für cœur façade sho-\r\nwing",
        "The Mueller trial of thirty%2Dfour pictures kept one f%C3%BCr coeur fa=C3=A7ade show=\ning",
    ],
)
def test_spellings_read_alike(text):
    known = set(words(PLAIN)).__contains__
    assert words(text, known) == words(PLAIN)


def test_words_of_nothing():
    assert words(None) == words("") == words(" \n- ") == []


def brute(docs, items, least):
    grams = {}
    for i, texts in items:
        for t in texts:
            for k in range(len(t) - least + 1):
                grams.setdefault(tuple(t[k : k + least]), set()).add(i)
    return {(d, i) for d, t in docs for k in range(len(t) - least + 1) for i in grams.get(tuple(t[k : k + least]), ())}


@pytest.mark.parametrize("seed", range(6))
def test_automaton_against_brute_force(seed):
    rng = random.Random(seed)
    letters = "ab" if seed % 2 else "abcde"
    items = [(i // 2, [rng.choices(letters, k=rng.randint(0, 14)), rng.choices(letters, k=rng.randint(0, 9))]) for i in range(12)]
    items.append((99, items[0][1]))
    docs = [(d, rng.choices(letters + "x", k=rng.randint(0, 60))) for d in range(60)]
    a = build(items, 4)
    got = {(d, s[0]) for d, t in docs for s in spans(a, t)}
    assert got == brute(docs, items, 4)


def test_span_places():
    a = build([(1, [list("abcdefgh")])], 3)
    assert spans(a, list("xxabcdxxcdefgh")) == [(1, 2, 4, 0.5), (1, 8, 6, 0.75)]


def test_word_places():
    text = "One <b>two</b>&nbsp;three_four, fi-\n> ve"
    assert [text[a:b] for a, b in word_places(text)][-1] == "fi-\n> ve"
    assert len(word_places(text)) == len(words(text)) == 5


def frames(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id long")
    return d, spark.createDataFrame(items, "item_id long, passage string, question string, text string")


def test_operator_on_awkward_rows(spark):
    p = " ".join(f"w{i}" for i in range(20))
    q = " ".join(f"q{i}" for i in range(12))
    docs = [(1, f"x {p} y", 0), (2, " ".join(p.split()[:11]), 0), (3, None, 0), (4, "", 0), (5, q, 0), (5, q, 0), (6, "z " * 200_000 + q, 0), (None, q, 0)]
    items = [(1, p, None, "clash"), (2, p, q, None), (3, "short one", "", None), (None, q, q, None)]
    d, e = frames(spark, docs, items)
    want = sorted([(1, 1), (1, 2), (5, 2), (6, 2), (None, 2)], key=repr)
    for most in (500_000, 25):  # one automaton, several
        got = leaked_documents(leaked_spans(d, e, most_words=most)).collect()
        assert sorted(map(tuple, got), key=repr) == want
    assert leaked_spans(d, e.limit(0)).count() == 0 and leaked_spans(d.limit(0), e).count() == 0
    assert leaked_documents(leaked_spans(d, e), least_coverage=0.9).count() == 5  # whole passages and whole questions
    clean = {r.doc_id: r for r in remove_spans(d, e).where("doc_id in (1, 2, 3)").collect()}
    assert clean[1].clean_text.split() == ["x", "y"] and clean[1].n_removed_words == 20 and clean[2].n_spans == 0 and clean[3].clean_text is None


def test_coverage_is_that_of_the_text_and_either_limit_cuts(spark):
    p, q = " ".join(f"w{i}" for i in range(40)), " ".join(f"q{i}" for i in range(8))
    d, e = frames(spark, [(1, f"a {q} b", 0), (2, "c " + " ".join(p.split()[:14]), 0), (3, "d " + " ".join(p.split()[:9]), 0)], [(1, p, q, None)])
    found = {r.doc_id: (r.n_words, round(r.coverage, 3)) for r in leaked_spans(d, e, least=5).collect()}
    assert found == {1: (8, 1.0), 2: (14, 0.35), 3: (9, 0.225)}

    def kept(**limits):
        return {r.doc_id: len(r.clean_text.split()) for r in remove_spans(d, e, **limits).collect()}

    assert kept() == {1: 10, 2: 1, 3: 10}
    assert kept(least_coverage=0.9, shortest=5) == {1: 2, 2: 1, 3: 10}


def test_words_keep_their_places_in_long_uneven_texts():
    from lakeassay.llm.text import word_places, words

    text = " ".join(f"word{i} a&#98;c{i} so-\ncalled{i} <b>x</b>y{i}" for i in range(20_000))
    places = word_places(text)
    assert len(places) == len(words(text)) and places == sorted(places)
    assert text[slice(*places[-1])].endswith("y19999")
