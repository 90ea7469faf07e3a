"""DuckDB twins of the text functions and of the index, for the oracle queries."""

from __future__ import annotations

from quillon.functions import text as T
from quillon.operators import index as I
from quillon.plans.corpus import CORPUS

STOP = "[" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + "]"


def fold(x: str) -> str:
    return f"lower(replace(replace(strip_accents(coalesce({x}, '')), 'œ', 'oe'), 'æ', 'ae'))"


def stem(x: str) -> str:
    cut = x
    for pattern, to in T.SUFFIXES:
        cut = f"regexp_replace({cut}, '{pattern}', '{to}')"
    return f"CASE WHEN length({x}) < 5 OR regexp_full_match({x}, '[0-9]+') THEN {x} ELSE {cut} END"


def wanted(x: str) -> str:
    return f"((length({x}) >= 2 OR regexp_full_match({x}, '[0-9]')) AND NOT list_contains({STOP}, {x}))"


def raw_words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({fold(x)}, '{T.SEPARATORS}'), lambda w: {wanted('w')})"


def tokens(x: str) -> str:
    return f"list_filter(list_transform({raw_words(x)}, lambda r: {stem('r')}), lambda v: {wanted('v')})"


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({fold(x)}, '{T.WORD_SEPARATORS}'), lambda w: w <> '')"


def shingles(x: str) -> str:
    runs = [f"list_transform(range(1, greatest(len({x}) - {n - 2}, 1)), lambda i: array_to_string({x}[i:i + {n - 1}], '_'))" for n in (2, 3)]
    return f"list_concat({', '.join(runs)})"


def half_up(x: str) -> str:
    return f"floor(round({x}, 6) + 0.5)"


def _field(f: I.Field) -> str:
    text = f"substr(abstract, 1, {I.ABSTRACT_CHARS})" if f.name == "abstract" else f"CAST({f.name} AS VARCHAR)"
    return f"SELECT doc, '{f.name}' AS field, {f.weight} AS weight, {f.b} AS b, {tokens(text)} AS tokens FROM corpus"


FIELDS = "ft AS (SELECT * FROM (" + " UNION ALL ".join(map(_field, I.FIELDS)) + ") WHERE len(tokens) > 0)"
MEANS = "av AS (SELECT field, greatest(1.0, sum(len(tokens)) / CAST((SELECT count(*) FROM corpus) AS DOUBLE)) AS avg_len FROM ft GROUP BY field)"
INDEX = f"""{CORPUS}, {FIELDS}, {MEANS},
  tt AS (SELECT doc, title, {tokens('title')} AS tk FROM corpus),
  sc AS (SELECT doc, weight / greatest((1 - b) + b * (len(tokens) / avg_len), 0.01) AS scale, unnest(tokens) AS term FROM ft JOIN av USING (field)),
  wd AS (SELECT doc, term, {I.K1 + 1} * sum(scale) / ({I.K1} + sum(scale)) AS score FROM sc GROUP BY doc, term),
  ph AS (SELECT doc, unnest({shingles('tk')}) AS term, {I.TITLE_PHRASE} AS score FROM tt),
  base AS (SELECT doc, term, round(sum(score), {I.PRECISION}) AS score FROM (SELECT * FROM wd UNION ALL SELECT * FROM ph) GROUP BY doc, term),
  tp AS (SELECT doc, unnest(tk[1:96]) AS t, generate_subscripts(tk[1:96], 1) AS p FROM tt),
  pr AS (SELECT a.doc, 'n_' || least(a.t, b.t) || '_' || greatest(a.t, b.t) AS term, {I.TITLE_PAIR} / (b.p - a.p) AS score, row_number() OVER (PARTITION BY a.doc, least(a.t, b.t), greatest(a.t, b.t) ORDER BY a.p, b.p) AS rn
         FROM tp a JOIN tp b ON a.doc = b.doc AND b.p > a.p AND b.p <= a.p + 5 AND a.t <> b.t),
  pairs AS (SELECT doc, term, round(score, {I.PRECISION}) AS score FROM pr WHERE rn = 1),
  sel AS (SELECT doc, term, max(score) AS score FROM (
     SELECT doc, term, score FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY score DESC, term) AS rn FROM base) WHERE rn <= {I.MOST_TERMS}
     UNION ALL SELECT doc, term, score FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY score DESC, term) AS rn FROM pairs) WHERE rn <= {I.MOST_PAIRS}) GROUP BY doc, term),
  p1 AS (SELECT doc, term, greatest(1, {half_up('score * 1000')}) AS score, count(*) OVER (PARTITION BY term) AS df FROM sel),
  post AS (SELECT term, doc, CAST(greatest(1, {half_up('score * ln(1 + ((SELECT count(*) FROM corpus) - df + 0.5) / (df + 0.5)) / 10')}) AS BIGINT) AS impact, df FROM p1)"""


def values(name: str, rows: list[tuple], columns: str) -> str:
    quoted = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else repr(v)
    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rows) + ")"


def query_terms(base: list[str]) -> str:
    return values("qt", [(t, base.index(t) if t in base else -1) for t in T.expanded_terms(base)], "term, bit")
