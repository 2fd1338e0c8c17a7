"""Sentence ranges and balanced parentheses: character-level state machines, as Arrow-batched pandas UDFs."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

#: Sentence marks, closers, abbreviations, starters and labels.
CJK_ENDS, LATIN_ENDS, CLOSERS = "。！？；", ".!?;", "\"'”’」』》）】)]"
ABBREVIATIONS = {"dr", "mr", "mrs", "ms", "prof", "sr", "jr", "st", "vs", "etc", "no", "fig"}
STARTERS = {"a", "an", "another", "but", "however", "it", "next", "she", "that", "the", "they", "this", "we", "yet"}
LABELS = {"appendix", "case", "category", "chapter", "class", "condition", "equation", "experiment", "fig", "figure", "grade", "group", "item", "model", "option", "panel", "part", "phase", "plan", "sample", "section", "step", "table", "theory", "type", "version", "volume"}
_WS = "".join(map(chr, [9, 10, 11, 12, 13, 32, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))
_BLANK, _RUN = re.compile(f"[{_WS}]"), re.compile(f"[{_WS}]+")
_ENDS = re.compile(f"[{CJK_ENDS}{re.escape(LATIN_ENDS)}]")

RANGES = "array<struct<text:string,start:int,end:int,complete:boolean>>"


def squeeze(text: str) -> str:
    return _RUN.sub(" ", text).strip(" ")


def _name_before(text: str) -> str:
    """The capitalised word that ends a text, if one does."""
    at = len(text)
    while at and (text[at - 1].islower() or text[at - 1] in "'’-"):
        at -= 1
    return text[at - 1 :] if 0 < at < len(text) and text[at - 1].isupper() else ""


def _abbreviates(text: str, dot: int) -> bool:
    """Whether the full stop at `dot` belongs to an abbreviation, an initial or a dotted name."""
    at = dot
    while at and (text[at - 1].isalpha() or text[at - 1] == "."):
        at -= 1
    token = text[at:dot]
    if token.lower() in ABBREVIATIONS:
        return True
    letters = token.split(".")
    if len(letters) > 1:
        return all(len(x) == 1 and x.isalpha() for x in letters)
    if len(token) != 1:
        return False
    after = re.match(f"[{_WS}]+([^\\W\\d_][\\w'’-]*)", text[dot + 1 : dot + 80])
    follows = re.match(r"[^\W\d_](?:[^\W\d_]|['’-])*", after[1])[0] if after and after[1][0].isupper() else ""
    if not follows or follows.lower() in STARTERS:
        return False
    if len(follows) == 1:
        return True
    before = text[:at].rstrip()
    if len(before) > 1 and before[-1] == "." and before[-2].isupper() and (len(before) == 2 or _BLANK.match(before[-3])):
        return True
    name = _name_before(before)
    return bool(name) and name.lower() not in LABELS


def ranges(text: str | None) -> list[tuple[str, int, int, bool]]:
    """(sentence, from, to, complete) along a text; offsets count code points of the raw text."""
    return list(_each(text))


def first_of(text: str | None) -> str:
    """The first sentence; what comes behind it is not looked at."""
    return next((x for x, _, _, _ in _each(text)), "")


def _each(text: str | None) -> Iterator[tuple[str, int, int, bool]]:
    text = text or ""
    start, n = 0, len(text)
    while True:
        while start < n and _BLANK.match(text[start]):
            start += 1
        if start >= n:
            return
        end, complete = n, False
        for m in _ENDS.finditer(text, start):
            i, c = m.start(), m[0]
            if c == "." and (0 < i < n - 1 and text[i - 1].isdecimal() and text[i + 1].isdecimal() or _abbreviates(text, i)):
                continue
            e = i + 1
            while e < n and text[e] in CLOSERS:
                e += 1
            if c in CJK_ENDS or e == n or _BLANK.match(text[e]):
                end, complete = e, True
                break
        stop = end
        while stop > start and _BLANK.match(text[stop - 1]):
            stop -= 1
        if stop > start:
            yield squeeze(text[start:stop]), start, stop, complete
        if not complete:
            return
        start = end


def strip_parentheses(text: str | None) -> str:
    """The text without balanced round brackets and what they hold; unmatched ones stay."""
    s = squeeze(text or "")
    open_, cut = [], []
    for i, c in enumerate(s):
        if c in "(（":
            open_.append((")" if c == "(" else "）", i))
        elif c in ")）" and open_ and open_[-1][0] == c:
            cut.append((open_.pop()[1], i + 1))
    kept, at = [], 0
    for a, b in sorted(cut):
        if b > at:
            kept.append(s[at : max(a, at)])
            at = b
    return squeeze("".join(kept) + s[at:])


def _dicts(text):
    return [{"text": a, "start": b, "end": e, "complete": d} for a, b, e, d in ranges(text)]


def sentence_ranges(c):
    return F.pandas_udf(_series(_dicts), RANGES)(c)


PLACED = "array<struct<text:string,start:int,end:int,first:int,upto:int>>"


def placed_sentences(text, starts, ends):
    """Complete sentences of a text of lines at [start, end), each with its lines: from `first` on, before `upto`."""

    def run(texts: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
        out = []
        for t, a, e in zip(texts, starts, ends):
            own = [(x, i, j) for x, i, j, complete in ranges(t) if complete]
            first = e.searchsorted([i for _, i, _ in own], "right").tolist()
            upto = a.searchsorted([j for _, _, j in own], "left").tolist()
            out.append([{"text": x, "start": i, "end": j, "first": f, "upto": u} for (x, i, j), f, u in zip(own, first, upto)])
        return pd.Series(out)

    return F.pandas_udf(run, PLACED)(text, starts, ends)


def strip_balanced(c):
    return F.pandas_udf(_series(strip_parentheses), "string")(c)


def _series(f):
    def run(c: pd.Series) -> pd.Series:
        return c.map(f)

    return run


def first_sentence(c):
    return F.pandas_udf(_series(first_of), "string")(c)


def sentences(c):
    return F.transform(sentence_ranges(c), lambda r: r["text"])
