"""Functions no built-in expresses, as Arrow UDFs: full NFKD folding, HTML entities, edit distance with transpositions, longest
common subsequence and highlighting with offsets."""

from __future__ import annotations

import html
import re
import unicodedata
from html.entities import html5

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType


def _each(column: pa.Array, f) -> pa.Array:
    return pa.array([None if x is None else f(x) for x in column.to_pylist()], pa.string())


def _nfkd(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


@F.arrow_udf(StringType())
def nfkd_strip(texts: pa.Array) -> pa.Array:
    """Full NFKD without combining marks."""
    return _each(texts, _nfkd)


@F.arrow_udf(StringType())
def nfkd_fold(texts: pa.Array) -> pa.Array:
    """nfkd_strip of the lower-cased text."""
    return _each(texts, lambda t: _nfkd(t.lower()))


@F.arrow_udf(StringType())
def unescaped(texts: pa.Array) -> pa.Array:
    """Character references decoded, white space runs to one space, trimmed."""
    return _each(texts, lambda t: re.sub(r"\s+", " ", html.unescape(t)).strip())


def _reference(m: re.Match) -> str:
    return html.unescape(m[0]) if m[1].startswith("#") else html5.get(m[1] + ";", m[0])


@F.arrow_udf(StringType())
def cleaned(texts: pa.Array) -> pa.Array:
    """unescaped() of whole pages: only references that a semicolon ends are decoded, so one that was cut off stays as it is."""
    return _each(texts, lambda t: re.sub(r"\s+", " ", re.sub(r"&(#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);", _reference, t)).strip())


def osa(a: str, b: str, most: int) -> int:
    """Optimal string alignment distance (adjacent letters may change places), most + 1 if it is over `most`."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            d = min(row[j] + 1, now[j - 1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            now.append(d)
        if min(now) > most and min(row) > most:  # an exchange reaches two rows back
            return most + 1
        before, row = row, now
    return min(row[-1], most + 1)


def lcs(a: str, b: str) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        corner = 0
        for j, y in enumerate(b, 1):
            corner, row[j] = row[j], corner + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def _letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(letters as numbers, one row a word, padded; lengths)."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    width = max(1, int(lengths.max(initial=0)))
    return np.array(words, f"<U{width}").view(np.uint32).reshape(len(words), width), lengths


def osa_all(a: list[str], b: list[str], most: np.ndarray) -> np.ndarray:
    """osa() of many pairs at once: the table is filled cell by cell, each for all pairs."""
    x, n = _letters(a)
    y, m = _letters(b)
    width = y.shape[1]
    before, row = np.zeros((width + 1, len(a)), np.int16), np.repeat(np.arange(width + 1, dtype=np.int16)[:, None], len(a), axis=1)
    x, y = np.ascontiguousarray(x.T), np.ascontiguousarray(y.T)
    every = np.arange(len(a))
    out = row[m, every].copy()  # of empty words
    for i in range(1, x.shape[0] + 1):
        now = np.empty_like(row)
        now[0] = i
        for j in range(1, width + 1):
            d = np.minimum(np.minimum(row[j], now[j - 1]) + 1, row[j - 1] + (x[i - 1] != y[j - 1]))
            if i > 1 and j > 1:
                swapped = (x[i - 1] == y[j - 2]) & (x[i - 2] == y[j - 1])
                d = np.where(swapped, np.minimum(d, before[j - 2] + 1), d)
            now[j] = d
        before, row = row, now
        at = np.flatnonzero(n == i)
        out[at] = row[m[at], at]
    return np.minimum(out, most + 1)


def lcs_all(a: list[str], b: list[str]) -> np.ndarray:
    """lcs() of many pairs at once."""
    x, n = _letters(a)
    y, m = _letters(b)
    x, y = np.ascontiguousarray(x.T), np.ascontiguousarray(y.T)
    row = np.zeros((y.shape[0] + 1, len(a)), np.int16)
    out = np.zeros(len(a), np.int16)
    for i in range(1, x.shape[0] + 1):
        now = np.zeros_like(row)
        for j in range(1, y.shape[0] + 1):
            now[j] = np.where(x[i - 1] == y[j - 1], row[j - 1] + 1, np.maximum(row[j], now[j - 1]))
        row = now
        at = np.flatnonzero(n == i)
        out[at] = row[m[at], at]
    return out


#: Pairs whose tables are filled together: a cell of all of them fits a core's cache.
PAIRS = 4096


def _pairs(columns: list[pa.Array], f) -> pa.Array:
    """f over the rows without nulls, PAIRS at a time; null for the others."""
    whole = np.flatnonzero(np.logical_and.reduce([c.is_valid().to_numpy(zero_copy_only=False) for c in columns]))
    out = np.zeros(len(columns[0]), np.int32)
    for k in range(0, len(whole), PAIRS):
        at = whole[k : k + PAIRS]
        out[at] = f(*[c.take(pa.array(at)).to_pylist() for c in columns])
    gone = np.ones(len(out), bool)
    gone[whole] = False
    return pa.array(out, pa.int32(), mask=gone)


@F.arrow_udf(IntegerType())
def osa_distance(a: pa.Array, b: pa.Array, most: pa.Array) -> pa.Array:
    return _pairs([a, b, most], lambda x, y, z: osa_all(x, y, np.array(z)))


@F.arrow_udf(IntegerType())
def lcs_length(a: pa.Array, b: pa.Array) -> pa.Array:
    return _pairs([a, b], lcs_all)


def _escape(text: str) -> str:
    return html.escape(text, quote=True).replace("&#x27;", "&#39;")


def mark(text: str, query: str) -> str:
    """HTML-escaped text with the query's words marked wherever they stand, accents and case aside."""
    plain = lambda s: "".join(c for c in unicodedata.normalize("NFD", s) if not "̀" <= c <= "ͯ").lower()
    wanted = [t for t in plain(query or "").split() if len(t) >= 2]
    if not wanted:
        return _escape(text)
    letters, origin = [], []
    for i, c in enumerate(text):
        for x in plain(c):
            letters.append(x)
            origin.append(i)
    out, at = [], 0
    for m in re.finditer("|".join(map(re.escape, wanted)), "".join(letters)):
        start, end = origin[m.start()], origin[m.end() - 1] + 1
        if start < at:
            continue
        out += [_escape(text[at:start]), "<mark>", _escape(text[start:end]), "</mark>"]
        at = end
    return "".join([*out, _escape(text[at:])])


@F.arrow_udf(StringType())
def highlighted(texts: pa.Array, queries: pa.Array) -> pa.Array:
    return pa.array([mark(t or "", q or "") for t, q in zip(texts.to_pylist(), queries.to_pylist(), strict=True)], pa.string())
