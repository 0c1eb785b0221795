"""Text as a person reads it: one folding for every operator on words.

``fold`` maps characters (case, accents, width, look-alikes, invisible ones);
``words`` also undoes escapes, markup and line-end hyphens and returns words.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable, Iterator
from urllib.parse import unquote

#: Letters of other scripts that look like a Latin one, and Latin
#: letters that decompose into none.
LOOK_ALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "п": "n", "о": "o", "р": "p", "ԛ": "q", "г": "r", "ѕ": "s", "т": "t", "υ": "u", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "χ": "x", "γ": "y",
    "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ð": "d", "þ": "th", "æ": "ae", "œ": "oe", "ħ": "h", "ŧ": "t", "ɑ": "a", "ɡ": "g",
}

#: Joins the halves of a word that a line end divides; see :func:`words`.
BREAK = "\x01"


class _Fold(dict):
    """Code point to folded text, filled as characters turn up."""

    def __missing__(self, point: int) -> str:
        ch = chr(point)
        out = ""
        if unicodedata.category(ch) not in ("Cf", "Mn", "Me"):
            for c in unicodedata.normalize("NFD", unicodedata.normalize("NFKC", ch).casefold()):
                c = LOOK_ALIKES.get(c, c)
                if unicodedata.category(c[0]) in ("Mn", "Me", "Cf"):
                    continue
                out += c if c.isalnum() else " "
        self[point] = out
        return out


FOLD = _Fold({ord(BREAK): BREAK})

INLINE_TAGS = {"a", "abbr", "b", "big", "bdi", "bdo", "code", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "s", "small", "span", "strike", "strong", "sub", "sup", "tt", "u", "var", "wbr"}

_TAG = re.compile(r"<!--.*?-->|<(/?)([a-zA-Z][a-zA-Z0-9]*)(?:\s[^<>]*)?/?>", re.S)
_LINE_END = re.compile("(?<=[^\\W_])(?:[-\u2010\u00ad]|&shy;)[ \\t]*\\r?\\n[ \\t>|*#]*(?=[^\\W_])")
_SOFT_END = re.compile(r"=\r?\n")
_QUOTED = re.compile(r"(?:=[0-9A-F]{2})+")
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_COMMAND = re.compile(r"\\[a-zA-Z]{3,}\*?\{")
_UNICODE = re.compile(r"(?:\\+u[0-9a-fA-F]{4})+|\\+x[0-9a-fA-F]{2}")
_BLANK = re.compile(r"\\+[nrtfbv]")
_LINK = re.compile(r"\]\((?:[^()\s]|\([^()\s]*\))*(?:\s+\"[^\"]*\")?\)")
_INNER = re.compile(r"(?<=[^\W_])[*`~]+(?=[^\W_])")


def _escape(m: re.Match) -> str:
    units = re.findall(r"u([0-9a-fA-F]{4})|x([0-9a-fA-F]{2})", m.group())
    return "".join(chr(int(a or b, 16)) for a, b in units).encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def _bytes(m: re.Match) -> str:
    try:
        return bytes.fromhex(m.group().replace("=", "")).decode()
    except ValueError:
        return " "


def _tag(m: re.Match) -> str:
    return "" if (m.group(2) or "").lower() in INLINE_TAGS else " "


def unescape(text: str) -> str:
    """``text`` without escapes and markup; plain text passes through the cheap tests unchanged."""
    if "=" in text:
        text = _QUOTED.sub(_bytes, _SOFT_END.sub("", text))
    if "%" in text:
        text = _PERCENT.sub(lambda m: unquote(m.group(), errors="replace"), text)
    if "\\" in text:
        text = _BLANK.sub(" ", _UNICODE.sub(_escape, _COMMAND.sub(" ", text)))
    if "\n" in text:
        text = _LINE_END.sub(BREAK, text)
    for _ in range(2):
        if "&" in text:
            text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(_tag, text)
    if "](" in text:
        text = _LINK.sub(" ", text)
    if "*" in text or "`" in text or "~" in text:
        text = _INNER.sub("", text)
    return text


def fold(text: str) -> str:
    """Letters and digits folded, everything else a blank.

    German digraphs for umlauts fold like the umlaut itself (ae, oe, ue to a, o, u).
    """
    return text.translate(FOLD).replace("ae", "a").replace("oe", "o").replace("ue", "u")


def words(text: str | None, known: Callable[[str], bool] | None = None) -> list[str]:
    """The words of a text, in order; none for null.

    A word divided at a line end is joined, unless ``known`` has both halves but
    not the whole (a compound divided at its hyphen).
    """
    if not text:
        return []
    out = fold(unescape(text)).split()
    if any(BREAK in w for w in out) if BREAK in text or "\n" in text else False:
        parted: list[str] = []
        for w in out:
            if BREAK in w:
                halves = [h for h in w.split(BREAK) if h]
                whole = "".join(halves)
                if known and not known(whole) and all(map(known, halves)):
                    parted += halves
                elif whole:
                    parted.append(whole)
            else:
                parted.append(w)
        out = parted
    return out


_PIECE = re.compile("(?:<[^<>]*>|\\S)+(?:(?<=[-‐­])[ \\t]*\\r?\\n[ \\t>|*#]*(?:<[^<>]*>|\\S)+)*")
_SEAM = re.compile(r"&[#\w]+;|<[^<>]*>|%20|\\+[nrt]|[_|,.;:!?/)\]}\"'-]+")


def _aligned(a: list[str], b: list[str], reach: int = 48) -> Iterator[tuple[int, int]]:
    """Pairs of places of equal words of two nearly equal lists, in order.

    After a difference it goes on at the nearest place where two words in a row
    agree, at most ``reach`` words ahead, and beyond that word by word; so the
    work grows with the lists' length alone.
    """
    i = k = 0
    while i < len(a) and k < len(b):
        if a[i] == b[k]:
            yield i, k
            i, k = i + 1, k + 1
            continue
        ahead = ((p, d - p) for d in range(1, reach) for p in range(d + 1))
        p, q = next(((p, q) for p, q in ahead if a[i + p : i + p + 2] == b[k + q : k + q + 2] != []), (1, 1))
        i, k = i + p, k + q


def word_places(text: str, known: Callable[[str], bool] | None = None) -> list[tuple[int, int]]:
    """Start and end in ``text`` of each word of ``words(text, known)``.

    Words that share an unbroken stretch without a clear seam share its place.
    Pieces are read one by one; where that differs from reading the text whole,
    words are aligned and those without a counterpart take the place before.
    """
    target = words(text, known)
    flat: list[str] = []
    places: list[tuple[int, int]] = []
    for m in _PIECE.finditer(text):
        found = words(m.group(), known)
        if len(found) > 1:
            cuts = [m.start(), *(m.start() + s.end() for s in _SEAM.finditer(m.group())), m.end()]
            parts = [(a, b, words(text[a:b], known)) for a, b in zip(cuts, cuts[1:]) if b > a]
            if [w for _, _, ws in parts for w in ws] == found:
                for a, b, ws in parts:
                    flat += ws
                    places += [(a, b)] * len(ws)
                continue
        flat += found
        places += [m.span()] * len(found)
    if flat == target:
        return places
    out: list[tuple[int, int] | None] = [None] * len(target)
    for i, k in _aligned(target, flat):
        out[i] = places[k]
    before = (0, 0)
    for i, p in enumerate(out):
        before = p = p or before
        out[i] = p
    return out
