"""Scores for abusive, hateful and sexually explicit language (problem 8).

A support vector machine over a gap-weighted subsequence string kernel with
Nystroem landmarks, trained on labelled sentences.  Texts are compared by
windows of characters; a window's kernel features are the subsequences of a few
characters that span little more than their own length, weighted down per gap,
so inserted, masked and repeated characters cost little.  As the decision is
linear in those features, landmarks and support weights fold into one table of
feature weights, and a document is scored by sums over positions.

Labels seldom show every kind of remark.  Abusive remarks come together, so
phrases that stand beside known remarks far more often than elsewhere, counted
over all documents, are remarks of kinds without a label; the machine is fitted
again with them (:func:`phrases`).
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeassay.llm.text import FOLD, unescape
from lakeassay.session import materialize, ship_package

SCORES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("source", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("at", T.IntegerType()),
        T.StructField("passage", T.StringType()),
        T.StructField("category", T.StringType()),
    ]
)

#: Categories that the rates tell apart.
CATEGORIES = ("abusive", "hateful", "sexual")
#: Characters of a window and the step between windows when training.
WINDOW = 44
STEP = 4
#: Bits of a feature's number.
BITS = 20
#: Weight of a subsequence per character it skips.
DECAY = 0.6
#: (characters, most characters spanned) of the subsequences.
ORDERS = ((3, 4), (5, 6))

_WORD_HYPHEN = re.compile(r"-(?<=[^\W\d_]-)(?=[^\W\d_]|[*@])")
#: Letters one or two blanks (or marks, blanks by then) apart, and a cheap sign of them.
_APART = re.compile(r"(?<![a-z0-9*@])[a-z](?: {1,2}[a-z]){2,}(?![a-z0-9*@])")
_SINGLE = re.compile(r" [a-z] {1,2}[a-z] ")
_DIGITS = re.compile(r"[0-9]+")
_REPEAT = re.compile(r"([a-z])\1+")
#: Digits that stand for letters inside a word.
_LEET = str.maketrans("0134578", "oieastb")


class _Keep(dict):
    """As the folding of words, with masking characters kept as ``*``."""

    def __missing__(self, point: int) -> str:
        out = FOLD[point]
        self[point] = out
        return out


_TABLE = _Keep({ord("*"): "*", ord("@"): "*", ord("$"): "s", ord("|"): " ", 1: ""})


def canonical(text: str) -> str:
    """Lower-case letters, blanks, ``0`` for numbers and ``*`` for masked characters.

    Undoes escapes, look-alikes, letters spelt out one by one, hyphens put into
    words, digits for letters, and runs of one letter.
    """
    t = unescape(text.replace("**", "\x02*")) if "*" in text else unescape(text)
    t = " " + _WORD_HYPHEN.sub("", t.replace("\x02", "*")).translate(_TABLE) + " "
    if _SINGLE.search(t):
        t = _APART.sub(lambda m: m.group().replace(" ", ""), t)
    out: list[str] = []
    for w in t.split():
        if not w.isalpha() and (w := _unmixed(w)) == "0" and out and out[-1] == "0":
            continue
        out.append(w)
    return _single(" " + " ".join(out) + " ")


def _unmixed(word: str) -> str:
    """A word with digits for letters read as letters; ``0`` for a number."""
    if not _DIGITS.search(word):
        return word
    return _DIGITS.sub("0", word.translate(_LEET) if _DIGITS.sub("", word) else word)


def _single(text: str) -> str:
    """Runs of one letter as that letter."""
    if not text.isascii():
        return _REPEAT.sub(r"\1", text)
    raw = np.frombuffer(text.encode(), np.uint8)
    keep = np.ones(len(raw), bool)
    np.not_equal(raw[1:], raw[:-1], out=keep[1:])
    return raw[keep | (raw < 97)].tobytes().decode()


def codes(text: str) -> np.ndarray:
    """Character numbers of a canonical text: 0 for masked, 1-26 letters, 27 blank, 28 number, 29 other."""
    raw = np.frombuffer(text.encode("latin-1", "replace"), np.uint8)
    return _CODE[raw]


_CODE = np.full(256, 29, np.int64)
_CODE[ord("*")] = 0
_CODE[97:123] = np.arange(1, 27)
_CODE[32] = 27
_CODE[48:58] = 28


def patterns() -> list[tuple[tuple[int, ...], float]]:
    """Offsets and weight of every subsequence shape."""
    from itertools import combinations

    out = []
    for n, span in ORDERS:
        for rest in combinations(range(1, span), n - 1):
            out.append(((0, *rest), DECAY ** (rest[-1] + 1 - n)))
    return out


PATTERNS = patterns()


def features(c: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """(feature numbers, which positions hold one, weight) for each shape, by start position."""
    n = len(c)
    c = c.astype(np.uint32)
    letter = c != 0
    masked = not letter.all()
    for offsets, weight in PATTERNS:
        m = n - offsets[-1]
        if m <= 0:
            continue
        h = np.full(m, len(offsets), np.uint32)
        sound = np.ones(m, bool)
        for o in offsets:
            h *= 31
            h += c[o : o + m]
            if masked:
                sound &= letter[o : o + m]
        h *= np.uint32(0x9E3779B1)
        yield (h >> np.uint32(32 - BITS)).astype(np.intp), sound, weight


def position_sums(c: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Weight of the features that start at each position."""
    out = np.zeros(len(c), np.float32)
    for h, sound, weight in features(c):
        part = table[h]
        part *= np.float32(weight)
        part *= sound
        out[: len(h)] += part
    return out


#: Part of the margin that a document's best window must clear: of its many windows
#: some would pass the bare boundary by chance.
MARGIN = 0.3
#: Characters scored in one go.
CHUNK = 1 << 18


@dataclass
class Model:
    """Feature weights (landmarks and support weights folded together), bias, threshold.

    ``kinds`` holds for each category a table and a bias that tell it from the others.
    """

    table: np.ndarray
    bias: float
    threshold: float = MARGIN
    kinds: dict[str, tuple[np.ndarray, float]] = field(default_factory=dict)
    #: Out-of-fold scores of the labelled sentences, and which of them were believed.
    held: np.ndarray = field(default_factory=lambda: np.zeros(0))
    kept: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))

    def sums(self, canons: list[str]) -> Iterator[np.ndarray]:
        """Score of the window at each position of each canonical text; the texts are read as one long array."""
        gap = "*" * 8
        for part in _parts(canons, CHUNK):
            values = np.concatenate([[0.0], np.cumsum(position_sums(codes(gap.join(part) + gap), self.table), dtype=np.float64)])
            at = 0
            for c in part:
                size = min(WINDOW, len(c))
                yield values[at + size : at + len(c) + 1] - values[at : at + len(c) - size + 1] + self.bias
                at += len(c) + len(gap)

    def kind(self, passage: str) -> str | None:
        """The likeliest category of a flagged window; None without categories."""
        c = codes(passage)
        found = {k: float(position_sums(c, table).sum()) + bias for k, (table, bias) in self.kinds.items()}
        return max(sorted(found), key=found.__getitem__) if found else None

    def scores(self, texts: list[str | None]) -> list[tuple[float | None, int, str]]:
        """Highest window score of each text less the threshold, where it is, and that window; None for an empty text.

        Texts are scored whole, many short ones at a time.
        """
        canons = [c if (c := canonical(t) if t else "").strip() else "" for t in texts]
        out: list[tuple[float | None, int, str]] = []
        for c, sums in zip(canons, self.sums(canons)):
            i = int(sums.argmax())
            out.append((float(sums[i]) - self.threshold, i, c[i : i + WINDOW]) if c else (None, -1, ""))
        return out


def _parts(canons: list[str], most: int) -> Iterator[list[str]]:
    """The texts in order, in parts of little more than ``most`` characters or one longer text."""
    part: list[str] = []
    size = 0
    for c in canons:
        part.append(c)
        size += len(c)
        if size > most:
            yield part
            part, size = [], 0
    if part:
        yield part


def solve_svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, start: np.ndarray | None = None, rounds: int = 25) -> np.ndarray:
    """Weights of a linear SVM (squared hinge, last weight the bias) by Newton steps in the primal."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1]) if start is None else start
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-3
    before = None
    for _ in range(rounds):
        inside = y * (x @ w) < 1
        if before is not None and (inside == before).all():
            break
        before = inside
        xs = x[inside] * cost[inside, None]
        w = np.linalg.solve(ridge + xs.T @ x[inside], xs.T @ y[inside])
    return w


class Landmarks:
    """Nystroem features of windows against landmark windows."""

    def __init__(self, windows: list[np.ndarray], rank: int):
        self.hashed = [[(h[sound], weight) for h, sound, weight in features(c)] for c in windows]
        self.windows = windows
        found = np.concatenate([h for part in self.hashed for h, _ in part])
        owner = np.repeat(np.arange(len(windows)), [sum(len(h) for h, _ in part) for part in self.hashed])
        weight = np.concatenate([np.full(len(h), w) for part in self.hashed for h, w in part])
        order = np.argsort(found, kind="stable")
        #: The landmarks' features, and where each one's landmarks stand in owner and weight.
        self.known, counts = np.unique(found, return_counts=True)
        self.pointer = np.concatenate([[0], np.cumsum(counts)])
        self.owner, self.weight = owner[order], weight[order]
        k = self._gram()
        self.norms = np.sqrt(np.maximum(np.diag(k), 1e-9))
        k = k / self.norms / self.norms[:, None]
        values, vectors = np.linalg.eigh((k + k.T) / 2)
        keep = (values > 1e-4 * values[-1]) & (np.arange(len(values)) >= len(values) - rank)
        self.root = vectors[:, keep] / np.sqrt(values[keep])

    def _gram(self) -> np.ndarray:
        gap = np.zeros(8, np.int64)
        ends = np.cumsum([len(c) + len(gap) for c in self.windows])
        starts = np.concatenate([[0], ends[:-1]])
        return self._raw(np.concatenate([x for c in self.windows for x in (c, gap)]), starts, ends - len(gap))

    def _raw(self, c: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Kernel values of windows [start, end) of one long array against every landmark.

        Goes from each feature of a window to the landmarks that hold it, some
        dozens of windows at a time.
        """
        m = len(self.hashed)
        number, place, weight = [], [], []
        for h, sound, w in features(c):
            i = np.searchsorted(self.known, h)
            at = np.flatnonzero(sound & (self.known[np.minimum(i, len(self.known) - 1)] == h))  # others add nothing
            number.append(i[at])
            place.append(at)
            weight.append(np.full(len(at), w))
        order = np.argsort(np.concatenate(place), kind="stable")
        number, place, weight = np.concatenate(number)[order], np.concatenate(place)[order], np.concatenate(weight)[order]
        first, last = np.searchsorted(place, starts), np.searchsorted(place, ends)
        out = np.zeros((len(starts), m), np.float32)
        for lo in range(0, len(starts), 64):
            f, n = first[lo : lo + 64], (last - first)[lo : lo + 64]
            row = np.repeat(np.arange(len(f)), n)
            entry = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(f, n)
            held = self.pointer[number[entry] + 1] - self.pointer[number[entry]]
            again = np.repeat(np.arange(len(entry)), held)
            post = np.arange(held.sum()) - np.repeat(np.cumsum(held) - held, held) + np.repeat(self.pointer[number[entry]], held)
            sums = np.bincount(row[again] * m + self.owner[post], weights=weight[entry][again] * self.weight[post], minlength=len(f) * m)
            out[lo : lo + 64] = sums.reshape(len(f), m)
        return out

    def map(self, c: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Features of the windows [start, end) of one long array of character numbers."""
        raw = self._raw(c, starts, ends)
        raw /= (self.norms * self.norms.mean()).astype(np.float32)
        return (raw @ self.root.astype(np.float32)).astype(np.float64)

    def fold(self, w: np.ndarray) -> np.ndarray:
        """The table of feature weights that gives the same decision."""
        beta = self.root @ w / self.norms / self.norms.mean()
        table = np.zeros(1 << BITS)
        for j, b in enumerate(beta):
            for h, weight in self.hashed[j]:
                np.add.at(table, h, weight * b)
        return table.astype(np.float32)


def _windows(samples: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One long array of the samples with gaps between, and start, end and sample of every training window."""
    gap = np.zeros(8, np.int64)
    starts, ends, owner, parts, at = [], [], [], [], 0
    for i, c in enumerate(samples):
        last = max(0, len(c) - WINDOW)
        for s in sorted({*range(0, last + 1, STEP), last}):
            starts.append(at + s)
            ends.append(at + min(s + WINDOW, len(c)))
            owner.append(i)
        parts += [c, gap]
        at += len(c) + len(gap)
    return np.concatenate(parts), np.array(starts), np.array(ends), np.array(owner)


#: Weight of a flagged sample, and most weight of all background windows together.
FLAGGED_WEIGHT = 8.0
BACKGROUND_WEIGHT = 4000.0


def _train(x: np.ndarray, owner: np.ndarray, y: np.ndarray, use: np.ndarray, rounds: int, top: int) -> np.ndarray:
    """Multiple-instance SVM: of a flagged sample only its best windows count as flagged, found in turns.

    Samples of y = 0 are unlabelled background and count as unflagged, save for
    the windows that the last turn took for flagged beyond doubt.
    """
    negative = np.flatnonzero(use[owner] & (y[owner] < 0))
    background = np.flatnonzero(use[owner] & (y[owner] == 0))
    bags = [np.flatnonzero(owner == i) for i in np.flatnonzero(use & (y > 0))]
    if not bags:
        return np.append(np.zeros(x.shape[1]), -1.0)
    chosen, plain = bags, background
    w = np.zeros(x.shape[1] + 1)
    each = min(1.0, BACKGROUND_WEIGHT / max(1, len(background)))
    for _ in range(rounds):
        flagged = np.concatenate(chosen)
        rows = np.concatenate([flagged, negative, plain])
        sign = np.concatenate([np.ones(len(flagged)), -np.ones(len(negative) + len(plain))])
        weight = np.concatenate([*(np.full(len(b), FLAGGED_WEIGHT / len(b)) for b in chosen), np.ones(len(negative)), np.full(len(plain), each)])
        w = solve_svm(x[rows], sign, weight, w)
        s = x @ w[:-1] + w[-1]
        chosen = [b[np.argsort(-s[b])[:top]] for b in bags]
        plain = background[s[background] < 0.5]
    return w


def fit(texts: list[str], categories: list[str | None], background: list[str] | None = None, more: list[str] | None = None, *, before: Model | None = None, landmarks: int = 1500, rank: int = 400, folds: int = 3, rounds: int = 4, top: int = 4, seed: int = 7) -> Model:
    """A model from labelled sentences, some of which may be labelled wrongly; category None is harmless.

    ``background`` are canonical windows of the corpus, nearly all harmless,
    that show what plain text looks like; their weight as a whole is fixed.
    ``more`` are canonical stretches taken for flagged.  Out-of-fold scores tell
    wrong labels, which lie far on the other side and are left out of the final
    fit; a model fitted ``before`` from the same sentences lends its finding.
    """
    background, more = background or [], more or []
    samples = [codes(canonical(t)) for t in texts] + [codes(c) for c in more] + [codes(c) for c in background]
    y = np.concatenate([[-1.0 if c is None else 1.0 for c in categories], np.ones(len(more)), np.zeros(len(background))])
    if not samples:
        return Model(np.zeros(1 << BITS, np.float32), -1.0)
    long, starts, ends, owner = _windows(samples)
    rng = np.random.default_rng(seed)
    # Landmarks: windows that lie side by side in the labelled sentences, then windows of the background.
    apart = np.flatnonzero(((starts - starts[np.searchsorted(owner, owner)]) % (WINDOW // STEP * STEP) == 0) & (y[owner] != 0))
    plain = rng.permutation(np.flatnonzero(y[owner] == 0))[: landmarks // 5]
    picked = np.concatenate([rng.permutation(apart)[: landmarks - len(plain)], plain])
    marks = Landmarks([long[starts[i] : ends[i]] for i in picked], rank)
    # windows that are alike, as of repeated sentences, are mapped once
    alike: dict[bytes, int] = {}
    which = np.array([alike.setdefault(long[a:b].tobytes(), len(alike)) for a, b in zip(starts, ends)])
    once = np.unique(which, return_index=True)[1]
    x = marks.map(long, starts[once], ends[once])[which]
    n = len(texts)
    if before is None:
        fold = np.concatenate([rng.permutation(n) % folds, np.full(len(y) - n, -1)])
        held = np.zeros(len(y))
        for f in range(folds):
            w = _train(x, owner, y, fold != f, rounds, top)
            best = np.full(len(y), -np.inf)
            np.maximum.at(best, owner, x @ w[:-1] + w[-1])
            held[fold == f] = best[fold == f]
        held, kept = held[:n], y[:n] * held[:n] > -0.5
    else:
        held, kept = before.held, before.kept
    w = _train(x, owner, y, np.concatenate([kept, np.ones(len(y) - n, bool)]), rounds, top)
    model = Model(marks.fold(w[:-1]), float(w[-1]), MARGIN, {}, held, kept)
    # Categories against one another, by the windows that made their sentences flagged.
    strong = np.flatnonzero((owner < n) & np.append(kept, False)[np.minimum(owner, n)] & (y[owner] > 0) & (x @ w[:-1] + w[-1] > 0))
    names = np.array([c or "" for c in categories])[owner[strong]]
    for kind in sorted(set(names)):
        own = names == kind
        v = solve_svm(x[strong], np.where(own, 1.0, -1.0), np.where(own, 1.0 / own.sum(), 1.0 / max(1, (~own).sum())) * len(own) / 2)
        model.kinds[kind] = (marks.fold(v[:-1]), float(v[-1]))
    return model


def _small(rows: DataFrame, most: int, order: str) -> list:
    """At most ``most`` rows, picked by the hash of a column."""
    return rows.orderBy(F.xxhash64(order), order).limit(most).collect()


def background(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", most: int = 8000, seed: int = 0) -> list[str]:
    """At most ``most`` windows, two each of the ``most`` / 2 documents whose hashed id is lowest, at every size.

    Fewer documents give fewer windows.
    """
    ship_package(docs.sparkSession)
    rank = F.xxhash64(F.lit(seed), F.col(doc_id))
    last = docs.select(rank.alias("r")).orderBy("r").limit(max(1, most // 2)).agg(F.max("r")).first()[0]
    picked = docs.where(rank <= F.lit(last)).select(F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t in batch.column(0).to_pylist():
                c = canonical(t) if t else ""
                if len(c) > WINDOW:
                    h = zlib.crc32(c.encode())
                    out += [c[s : s + WINDOW] for s in sorted({h % (len(c) - WINDOW), h // 7 % (len(c) - WINDOW)})]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["window"])

    return [r["window"] for r in picked.mapInArrow(run, "window string").orderBy(F.xxhash64("window"), "window").limit(most).collect()]


#: Characters from a known remark within which a phrase stands beside it.
REACH = 3 * WINDOW
#: Fewest documents in which a phrase stands beside known remarks.
LEAST_BESIDE = 3
#: Least share of its documents in which it does so, by the lower Wilson bound at two deviations.
LEAST_SHARE = 0.1
#: Fewest characters of a phrase; shorter ones are turns that introduce or close any sentence.
LEAST_PHRASE = 24
#: Bounds of the sample of phrases: word triples counted, phrases kept, examples of each.
MOST_TRIPLES = 200_000
MOST_PHRASES = 400
EXAMPLES = 4


def _words(c: str) -> tuple[list[str], list[int]]:
    """Words of a canonical text (one blank apart) and where they start."""
    ws = c.split()
    starts = np.cumsum([1, *(len(w) + 1 for w in ws)])[:-1] if ws else []
    return ws, [int(s) for s in starts]


def around(c: str, scores: np.ndarray) -> tuple[list[str], list[str], list[str]] | None:
    """Word triples beside, overlapping with and away from the windows that score above 0; None without such."""
    hot = np.flatnonzero(scores > 0)
    if not len(hot):
        return None
    edge = np.zeros(len(c) + 1, np.int64)
    zone = np.zeros(len(c) + 1, np.int64)
    for e, reach in ((edge, 0), (zone, REACH)):
        np.add.at(e, np.maximum(hot - reach, 0), 1)
        np.add.at(e, np.minimum(hot + WINDOW + reach, len(c)), -1)
    inside, near = np.concatenate([[0], np.cumsum(np.cumsum(edge) > 0)]), np.cumsum(zone) > 0
    ws, starts = _words(c)
    kind: dict[str, int] = {}
    for i in range(len(ws) - 2):
        a, b = starts[i], starts[i + 2] + len(ws[i + 2])
        g = " ".join(ws[i : i + 3])
        kind[g] = max(kind.get(g, 0), 2 if inside[b] > inside[a] else 1 if near[a] and near[b - 1] else 0)
    return [g for g, k in kind.items() if k == 1], [g for g, k in kind.items() if k == 2], [g for g, k in kind.items() if k == 0]


def stretches(c: str, counts: dict[str, int]) -> list[tuple[str, str]]:
    """(phrase, stretch around it) for each run of words in ``counts``, whose numbers of documents are alike."""
    ws, starts = _words(c)
    found = [counts.get(" ".join(ws[i : i + 3]), 0) for i in range(len(ws) - 2)]
    out, i = [], 0
    while i < len(found):
        if not found[i]:
            i += 1
            continue
        k, low, high = i, found[i], found[i]
        while k + 1 < len(found) and found[k + 1] and max(high, found[k + 1]) <= 2 * min(low, found[k + 1]):
            k += 1
            low, high = min(low, found[k]), max(high, found[k])
        a, b = starts[i], starts[k + 2] + len(ws[k + 2])
        if b - a >= LEAST_PHRASE:
            mid = (a + b) // 2
            out.append((c[a:b], c[max(0, mid - WINDOW) : mid + WINDOW] if b - a < 2 * WINDOW else c[a:b]))
        i = k + 1
    return out


def phrases(docs: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text") -> list[str]:
    """Stretches of the corpus around phrases that stand beside known remarks far more often than elsewhere.

    Two passes over all documents.  The first keeps those in which ``model``
    finds a remark and counts word triples beside it (in distinct texts); the
    second counts, over all documents, the triples found more often beside
    remarks than away from them in the same texts.  A triple is kept if
    LEAST_SHARE of its documents have it beside a remark; one that overlaps with
    remarks in most of its documents belongs to them.  Runs of kept triples are
    phrases.  The result is a sample with the bounds named above, those with
    most support first; it grows no further with the corpus.
    """
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)
    rows = docs.select(F.col(text).alias("text")).where(F.length("text") > 0)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        kinds = [pa.string(), *[pa.list_(pa.string())] * 3]
        for batch in batches:
            out = []
            canons = [canonical(t) for t in batch.column(0).to_pylist()]
            for c, sums in zip(canons, own.sums(canons)):
                found = around(c, sums)
                if found:
                    out.append((c, *found))
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out) if out else [[]] * 4, kinds)], names=["canon", "beside", "within", "away"])

    found = materialize(rows.mapInArrow(find, "canon string, beside array<string>, within array<string>, away array<string>"), "remarks")
    alone = found.groupBy(F.xxhash64("canon").alias("h")).agg(*(F.first(c).alias(c) for c in found.columns))
    kinds = ("beside", "within", "away")
    seen = reduce(DataFrame.unionByName, [alone.select(F.explode(c).alias("g"), F.lit(c).alias("k")) for c in kinds])
    counts = seen.groupBy("g").agg(*(F.count_if(F.col("k") == c).alias(c) for c in kinds))
    top = counts.where((F.col("beside") >= LEAST_BESIDE) & (F.col("beside") > F.col("away"))).orderBy(F.desc("beside"), "g").limit(MOST_TRIPLES).collect()
    if not top:
        return []
    number = spark.sparkContext.broadcast({r["g"]: i for i, r in enumerate(top)})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = number.value
        n = np.zeros(len(own), np.int64)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                ws = canonical(t).split()
                for g in {f"{a} {b} {c}" for a, b, c in zip(ws, ws[1:], ws[2:])} & own.keys():
                    n[own[g]] += 1
        i = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(n[i])], names=["i", "n"])

    total = np.zeros(len(top), np.int64)
    for r in rows.mapInArrow(count, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect():
        total[r["i"]] = r["n"]
    near, within = np.array([r["beside"] for r in top], float), np.array([r["within"] for r in top])
    n = np.maximum(total - within, near)
    share = near / n
    low = (share + 2 / n - 2 * np.sqrt(share * (1 - share) / n + 1 / n**2)) / (1 + 4 / n)
    kept = spark.sparkContext.broadcast({top[i]["g"]: int(total[i]) for i in np.flatnonzero((low >= LEAST_SHARE) & (2 * within <= total))})

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = kept.value
        for batch in batches:
            out = [s for c in batch.column(0).to_pylist() for s in stretches(c, own)]
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.string()) for v in (zip(*out) if out else [[]] * 2)], names=["phrase", "stretch"])

    parts = found.select("canon").mapInArrow(read, "phrase string, stretch string").groupBy("phrase", F.pmod(F.xxhash64("stretch"), F.lit(EXAMPLES)).alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("stretch").alias("stretch"))
    best = parts.groupBy("phrase").agg(F.sum("n").alias("n"), F.sort_array(F.collect_list("stretch")).alias("s")).where(F.col("n") >= LEAST_BESIDE)
    return [s for r in best.orderBy(F.desc("n"), "phrase").limit(MOST_PHRASES).collect() for s in r["s"]]


def train(labels: DataFrame, docs: DataFrame, *, sample_text: str = "sample_text", category: str = "category", harmless: str = "none", doc_id: str = "doc_id", text: str = "text", most_labels: int = 2000, most_windows: int = 8000, turns: int = 1) -> Model:
    """A model from labelled sentences, fitted again ``turns`` times with the phrases found beside known remarks.

    Bounds of what is fitted, whatever the size of the tables: ``most_labels``
    labelled rows (picked by hash), ``most_windows`` windows of the corpus, and
    the sample of :func:`phrases`.  Rows without text or category are left out.
    """
    known = labels.where((F.length(sample_text) > 0) & F.col(category).isNotNull()).select(F.col(sample_text).alias("t"), F.when(F.col(category) != harmless, F.col(category)).alias("c"))
    rows = _small(known, most_labels, "t")
    texts, categories = [r["t"] for r in rows], [r["c"] for r in rows]
    plain = background(docs, doc_id=doc_id, text=text, most=most_windows)
    model = first = fit(texts, categories, plain)
    more: dict[str, None] = {}
    for _ in range(turns):
        found = dict.fromkeys(phrases(docs, model, doc_id=doc_id, text=text)).keys() - more.keys()
        more |= dict.fromkeys(sorted(found))
        if not found:
            break
        model = fit(texts, categories, plain, list(more), before=first)
    return model


def save(model: Model, spark: SparkSession, path: str) -> None:
    """Write a model as one row of Parquet at ``path``, a folder that all executors share or any other."""
    spark.createDataFrame([(bytearray(pickle.dumps(model)),)], "model binary").coalesce(1).write.parquet(path)


def load(spark: SparkSession, path: str) -> Model:
    """The model of :func:`save`; only for files of one's own, as it is a pickle."""
    return pickle.loads(spark.read.parquet(path).first()[0])


def score(docs: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Every document: doc_id, source, score (above 0: flagged), at, passage (the window that decided), category.

    Null and empty texts have a null score; documents not flagged have no category.  Documents are scored where they are
    read; the model is a table of fixed size.
    """
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema, own = to_arrow_schema(SCORES), shared.value
        for batch in batches:
            found = own.scores(batch.column(2).to_pylist())
            rows = [(*f, own.kind(f[2]) if f[0] is not None and f[0] > 0 else None) for f in found]
            columns = zip(*rows) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, schema.field(i).type) for i, c in enumerate(columns, 2))], schema=schema)

    return rows.mapInArrow(run, SCORES)


def rates(scored: DataFrame) -> DataFrame:
    """Per source, its spellings united: documents, flagged documents, rate, mean score, and flagged documents and rate per category."""
    from lakeassay.llm.mixing import source_key

    counts = [F.count_if((F.col("score") > 0) & (F.col("category") == k)).alias(f"n_{k}") for k in CATEGORIES]
    out = scored.groupBy(source_key(F.col("source")).alias("source_key")).agg(F.count(F.lit(1)).alias("n_documents"), F.count_if(F.col("score") > 0).alias("n_flagged"), F.avg("score").alias("mean_score"), *counts)
    return out.withColumn("rate", F.col("n_flagged") / F.col("n_documents")).withColumns({f"rate_{k}": F.col(f"n_{k}") / F.col("n_documents") for k in CATEGORIES})
