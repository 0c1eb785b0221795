"""Evaluation texts that leak into training text (problem 6).

A generalised suffix automaton of all items is streamed over each document's
words; the longest match ending at each word gives the leaked spans.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeassay.llm.text import word_places, words
from lakeassay.session import ship_package

SPANS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("item_id", T.LongType()),
        T.StructField("first_word", T.IntegerType()),
        T.StructField("n_words", T.IntegerType()),
        T.StructField("coverage", T.DoubleType()),
    ]
)


@dataclass
class Automaton:
    """Generalised suffix automaton over word numbers, with the items' texts behind each state.

    ``step`` maps state * vocabulary + word to the next state.  ``held`` gives,
    for states whose longest text has at least ``least`` words, the texts that
    contain the last ``least`` words; ``texts`` their items and words.
    """

    vocabulary: dict[str, int]
    step: dict[int, int]
    link: list[int]
    longest: list[int]
    held: dict[int, tuple[int, ...]]
    texts: list[tuple[int, int]]
    least: int


def build(items: list[tuple[int, list[list[str]]]], least: int) -> Automaton:
    """The automaton of (item_id, texts as words); equal texts of several items count for each."""
    vocabulary: dict[str, int] = {}
    for _, texts in items:
        for text in texts:
            for w in text:
                vocabulary.setdefault(w, len(vocabulary))
    v = max(1, len(vocabulary))
    trans: list[dict[int, int]] = [{}]
    link, longest = [-1], [0]
    owners: list[set[int]] = [set()]

    def split(p: int, q: int, w: int) -> int:
        clone = len(trans)
        trans.append(dict(trans[q]))
        link.append(link[q])
        longest.append(longest[p] + 1)
        owners.append(set())
        link[q] = clone
        while p != -1 and trans[p].get(w) == q:
            trans[p][w] = clone
            p = link[p]
        return clone

    def extend(last: int, w: int) -> int:
        q = trans[last].get(w)
        if q is not None:
            return q if longest[q] == longest[last] + 1 else split(last, q, w)
        new = len(trans)
        trans.append({})
        link.append(-1)
        longest.append(longest[last] + 1)
        owners.append(set())
        p = last
        while p != -1 and w not in trans[p]:
            trans[p][w] = new
            p = link[p]
        if p == -1:
            link[new] = 0
        else:
            q = trans[p][w]
            link[new] = q if longest[q] == longest[p] + 1 else split(p, q, w)
        return new

    numbered: list[tuple[int, int]] = []
    for item, texts in items:
        for text in texts:
            last = 0
            for w in text:
                last = extend(last, vocabulary[w])
                owners[last].add(len(numbered))
            numbered.append((item, len(text)))
    # A text that ends in a state also ends in every shorter suffix of it.
    for s in sorted(range(1, len(trans)), key=longest.__getitem__, reverse=True):
        if link[s] > 0:
            owners[link[s]] |= owners[s]
    held: dict[int, tuple[int, ...]] = {}
    for s in range(1, len(trans)):
        if longest[s] >= least:
            t = s
            while link[t] >= 0 and longest[link[t]] >= least:
                t = link[t]
            held[s] = tuple(sorted(owners[t]))
    step = {s * v + w: t for s, ts in enumerate(trans) for w, t in ts.items()}
    return Automaton(vocabulary, step, link, longest, held, numbered, least)


def spans(a: Automaton, text: list[str]) -> list[tuple[int, int, int, float]]:
    """(item_id, first word, words, coverage) of each maximal run of words shared with a text of an item.

    Runs of at least ``least`` words count; coverage is that of the text shared
    with.  A run shared with several texts of an item counts once, with the best
    coverage.  Words outside the items' vocabulary
    reset the automaton, so only stretches of known words are streamed.
    """
    flags = bytes(map(a.vocabulary.__contains__, text))
    need = b"\x01" * a.least
    at = flags.find(need)
    if at < 0:
        return []
    v = max(1, len(a.vocabulary))
    open_runs: dict[int, list[int]] = {}
    out: dict[tuple[int, int, int], float] = {}

    def close(number: int) -> None:
        first, last = open_runs.pop(number)
        item, size = a.texts[number]
        run = (item, first, last - first + 1)
        out[run] = max(out.get(run, 0.0), min(1.0, run[2] / size))

    while at >= 0:
        end = flags.find(b"\x00", at)
        end = len(flags) if end < 0 else end
        state = length = 0
        for i in range(at, end):
            w = a.vocabulary[text[i]]
            nxt = a.step.get(state * v + w)
            while nxt is None and state:
                state = a.link[state]
                length = a.longest[state]
                nxt = a.step.get(state * v + w)
            if nxt is None:
                length = 0
                continue
            state, length = nxt, length + 1
            if length >= a.least:
                # a match shorter than the state's longest text may belong to a suffix of it
                t = state
                while a.longest[a.link[t]] >= length:
                    t = a.link[t]
                for number in a.held[t]:
                    run = open_runs.get(number)
                    if run and run[1] == i - 1:
                        run[1] = i
                    else:
                        if run:
                            close(number)
                        open_runs[number] = [i - a.least + 1, i]
        at = flags.find(need, end)
    for number in list(open_runs):
        close(number)
    return sorted((*run, coverage) for run, coverage in out.items())


def automata(items: DataFrame, item_id: str, texts: list[str], least: int, most_words: int) -> Iterator[Automaton]:
    """Automata of at most ``most_words`` words each (a longer single item gets one of its own)."""
    part: list[tuple[int, list[list[str]]]] = []
    n = 0
    for row in items.where(F.col(item_id).isNotNull()).select(F.col(item_id).cast("long").alias("i"), F.array(*texts).alias("t")).toLocalIterator():
        found = [w for w in (words(t) for t in row["t"]) if len(w) >= least]
        size = sum(map(len, found))
        if part and n + size > most_words:
            yield build(part, least)
            part, n = [], 0
        if found:
            part.append((row["i"], found))
            n += size
    if part:
        yield build(part, least)


def leaked_spans(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_texts: tuple[str, ...] = ("passage", "question"), least: int = 12, most_words: int = 500_000) -> DataFrame:
    """Every span of at least ``least`` words that a document shares with a text of an item.

    Columns: doc_id, item_id, first_word, n_words, coverage (of the text it is
    shared with).  Documents are read in one pass and never shuffled.  What is
    broadcast is an automaton of at most ``most_words`` item words; larger item
    sets make several passes.  Null or empty texts leak nothing, items whose
    texts are shorter than ``least`` words cannot be matched, repeated documents
    are reported each.
    """
    spark = docs.sparkSession
    ship_package(spark)
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where(F.length("text") > 0)
    out = None
    for a in automata(items, item_id, list(item_texts), least, most_words):
        shared = spark.sparkContext.broadcast(a)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            from pyspark.sql.pandas.types import to_arrow_schema

            own, schema = shared.value, to_arrow_schema(SPANS)
            known = own.vocabulary.__contains__
            for batch in batches:
                rows = []
                for doc, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    rows += [(doc, *s) for s in spans(own, words(body, known))]
                columns = zip(*rows) if rows else [[] for _ in schema]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        found = source.mapInArrow(run, SPANS)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], SPANS)


def leaked_documents(found: DataFrame, least_coverage: float | None = None) -> DataFrame:
    """(doc_id, item_id) pairs of the spans, optionally only of those that cover enough of the item."""
    if least_coverage is not None:
        found = found.where(F.col("coverage") >= least_coverage)
    return found.select("doc_id", "item_id").distinct()


CLEANED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("clean_text", T.StringType()), T.StructField("n_spans", T.IntegerType()), T.StructField("n_removed_words", T.IntegerType())])


def cut(text: str, found: list[tuple[int, int, int, float]], places: list[tuple[int, int]]) -> tuple[str, int, int]:
    """(text without the spans, spans cut after merging, words cut)."""
    merged: list[list[int]] = []
    for first, last in sorted((s[1], s[1] + s[2] - 1) for s in found):
        if merged and first <= merged[-1][1] + 1:
            merged[-1][1] = max(merged[-1][1], last)
        else:
            merged.append([first, last])
    parts, at = [], 0
    for first, last in merged:
        parts.append(text[at : places[first][0]])
        at = places[last][1]
    parts.append(text[at:])
    return "".join(parts), len(merged), sum(b - a + 1 for a, b in merged)


def remove_spans(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_texts: tuple[str, ...] = ("passage", "question"), least: int = 12, least_coverage: float | None = None, shortest: int | None = None, most_words: int = 500_000) -> DataFrame:
    """Every document once, with spans cut out that have ``least`` words or cover ``least_coverage`` of an item's text.

    Spans of fewer than ``shortest`` words (``least``, unless given) are never
    cut, whatever they cover.

    Columns: doc_id, clean_text, n_spans (after merging overlaps), n_removed_words.
    Documents without such spans, null and empty ones included, come out as they
    are.  Item sets larger than ``most_words`` are cut one automaton after the other.
    """
    spark = docs.sparkSession
    ship_package(spark)
    out = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("clean_text"), F.lit(0).alias("n_spans"), F.lit(0).alias("n_removed_words"))
    for a in automata(items, item_id, list(item_texts), min(least, shortest or least), most_words):
        shared = spark.sparkContext.broadcast(a)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            from pyspark.sql.pandas.types import to_arrow_schema

            own, schema = shared.value, to_arrow_schema(CLEANED)
            known = own.vocabulary.__contains__
            for batch in batches:
                rows = []
                for doc, body, n_spans, n_words in zip(*(c.to_pylist() for c in batch.columns)):
                    found = [s for s in spans(own, words(body, known)) if s[2] >= least or (least_coverage is not None and s[3] >= least_coverage)]
                    if found:
                        body, more, cut_words = cut(body, found, word_places(body, known))
                        n_spans, n_words = n_spans + more, n_words + cut_words
                    rows.append((doc, body, n_spans, n_words))
                columns = zip(*rows) if rows else [[] for _ in schema]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        out = out.mapInArrow(run, CLEANED)
    return out
