"""Text functions that Spark has no expression for: Unicode normalisation, sequence similarity, depth-aware markup (C-04, C-10..C-14, C-21, C-23)."""

from __future__ import annotations

import difflib
import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from versemill.functions import fixed

_WORD = re.compile(r"[a-z0-9]+")
_C1 = str.maketrans(*fixed.mojibake())
_MARKS = str.maketrans(*fixed.PLAIN_MARKS)


def plain(text: str, form: str = "NFKD") -> str:
    """Without combining marks."""
    return "".join(c for c in unicodedata.normalize(form, text) if not unicodedata.combining(c))


def py_loose_key(text: str | None) -> str:
    """C-04: letters and digits alone, without case, accents or kinds of marks."""
    if not text:
        return ""
    t = plain(text.translate(_C1)).translate(_MARKS).casefold()
    return "".join(filter(str.isalnum, t))


def py_words(text: str | None) -> list[str]:
    """C-13: ASCII words of the accentless lower-cased text."""
    return _WORD.findall(plain(text or "").lower())


def py_flat_words(text: str | None) -> str:
    """C-14: words between single spaces, padded, so that a whole word is found as a substring."""
    return f" {' '.join(_WORD.findall(plain((text or '').lower(), 'NFD')))} "


def py_decomposed(text: str | None) -> bool:
    """C-21: not in composed form, with at least two combining marks."""
    if not text or unicodedata.is_normalized("NFC", text):
        return False
    return sum(1 for c in unicodedata.normalize("NFD", text) if unicodedata.combining(c)) >= 2


def py_accented_letters(text: str | None) -> int:
    """Letters that carry an accent: those whose decomposed form has a combining mark."""
    return sum(1 for c in text or "" if c.isalpha() and any(map(unicodedata.combining, unicodedata.normalize("NFD", c))))


_BLOCKS = frozenset(x.lower() for x in fixed.SCRUB_BLOCKS)
_ALONE = _BLOCKS.union(x.lower() for x in fixed.SCRUB_TAGS)
_TOKEN = re.compile(r"<(/?)([A-Za-z]+)\b([^<>]*?)(/?)>")


def py_scrub(text: str | None) -> str:
    """C-10: apparatus goes with its content, colophon divisions with all they hold, other markup without its content."""
    out, at = [], 0
    text = text or ""
    tokens = list(_TOKEN.finditer(text))
    closers: dict[int, int] = {}  # opening token -> its closing one
    stack: list[int] = []
    for i, m in enumerate(tokens):
        name = m.group(2).lower()
        if m.group(1):
            for j in range(len(stack) - 1, -1, -1):
                if tokens[stack[j]].group(2).lower() == name:
                    closers[stack[j]] = i
                    del stack[j:]
                    break
        elif not m.group(4):
            stack.append(i)
    for i, m in enumerate(tokens):
        if m.start() < at:
            continue
        name = m.group(2).lower()
        colophon = name == "div" and not m.group(1) and re.search(r"type\s*=\s*[\"']colophon[\"']", m.group(3), re.I)
        if colophon or i in closers and name in _BLOCKS:
            out += [text[at : m.start()], " "]
            at = tokens[closers[i]].end() if i in closers else len(text)
        elif name in _ALONE:
            out += [text[at : m.start()], " "]
            at = m.end()
    return "".join([*out, text[at:]])


_ENTITY = re.compile(r"&(?:amp|lt|gt|quot|apos|#\d+|#[xX][0-9a-fA-F]+);")


def py_entities(text: str | None) -> str:
    """C-11: the five named and all numeric entities, once."""
    return _ENTITY.sub(lambda m: html.unescape(m.group(0)), text or "")


_MARKUP = re.compile(fixed.MARKUP)


def py_tag_text(text: str | None, gone: frozenset[str], kept: frozenset[str] = frozenset(["add"])) -> str:
    """C-12: text of markup held in a string; elements in `gone` but not in `kept` go with their content.

    Within such an element only the depth counts: a tag that opens adds one and any that closes takes one, whatever its name.
    """
    out, depth = [], 0
    for m in _MARKUP.finditer(text or ""):
        closes, name, alone = m.groups()
        if name is None:
            if not depth:
                out.append(m.group())
        elif closes:
            depth = max(0, depth - 1)
        elif not alone and (depth or name.lower() in gone and name.lower() not in kept):
            depth += 1
    return "".join(out)


def py_ratio(a: str | None, b: str | None) -> float:
    """C-23: similarity of two strings by matching blocks."""
    return difflib.SequenceMatcher(None, a or "", b or "").ratio()


def _mapped(f, kind: T.DataType):
    @F.pandas_udf(kind)
    def run(s: pd.Series) -> pd.Series:
        return s.map(f)

    return run


@F.pandas_udf(T.DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([py_ratio(x, y) for x, y in zip(a, b)], dtype="float64")


loose_key = _mapped(py_loose_key, T.StringType())
words = _mapped(py_words, T.ArrayType(T.StringType()))
flat_words = _mapped(py_flat_words, T.StringType())
decomposed = _mapped(py_decomposed, T.BooleanType())
accented_letters = _mapped(py_accented_letters, T.LongType())
scrub = _mapped(py_scrub, T.StringType())
entities = _mapped(py_entities, T.StringType())


def tag_text(gone: list[str]):
    """C-12 as a function of a column."""
    names = frozenset(x.lower() for x in gone)
    return _mapped(lambda t: py_tag_text(t, names), T.StringType())
