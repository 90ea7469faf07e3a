"""Text analysis as Column expressions, with a plain-Python twin for query strings at plan time.

Everything here stays in the JVM. Folding maps characters by tables built from Unicode data: those that decompose to one base
character in one pass, the few that decompose to several with letters or digits among them (ligatures, fractions, units) one by one,
in texts that hold any. Both together are NFKD with marks dropped, but for what has no letter or digit in it.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that are not indexed, French then English.
STOPWORDS = tuple(
    "a au aux avec ce ces dans de des du elle en et eux il ils je la le les leur leurs lui ma mais me mes moi mon ne nos notre nous ou par pas pour qu que qui sa se ses son sur ta te tes toi ton tu un une vos votre vous "
    "the and for with from that this these those into onto over under between within without about after before than then are was were been being have has had not all any can could should would".split()
)
#: Suffixes cut in this order, each at most once, and what takes their place.
SUFFIXES = (
    ("(ements|ement|ations|ation|iques|ique|ances|ance|ities|ity|ments|ment)$", ""),
    ("(issements|issement)$", "iss"),
    ("(euses|euse|eurs|eur|ives|ive|ifs|if)$", ""),
    ("(ies|ied|ing|ers|er|ed|es|s)$", ""),
)
MARKS = "[\\u0300-\\u036f]"
SEPARATORS = "[^a-z0-9]+"
#: What stands between the words of full-text search: anything but letters and digits of any script.
WORD_SEPARATORS = "[^\\p{L}\\p{N}]+"


def _bare(c: str) -> str:
    return "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))


def _decomposed() -> list[tuple[str, str]]:
    codes = [*range(0xA0, 0xD800), *range(0xF900, 0x20000)]
    return [(c, base) for c in map(chr, codes) if (base := _bare(c)) != c and base]


@lru_cache(1)
def _plain_letters() -> tuple[str, str]:
    """Characters that decompose to one base character and marks, and those base characters."""
    one = [(c, b) for c, b in _decomposed() if len(b) == 1]
    return "".join(c for c, _ in one), "".join(b for _, b in one)


@lru_cache(1)
def _several_letters() -> tuple[str, str]:
    """Ranges around the characters that decompose to several with a letter or digit of ours, and (from, to) of each of them as JSON."""
    many = [(c, b) for c, b in _decomposed() if len(b) > 1 and re.search("[A-Za-z0-9]", b)]
    return _ranges([ord(c) for c, _ in many], 64), json.dumps([{"a": c, "b": b} for c, b in many], ensure_ascii=False)


def _ranges(codes: list[int], gap: int = 1) -> str:
    """A character class of ascending codes; those at most `gap` apart share a range."""
    cuts = [k for k in range(1, len(codes)) if codes[k] - codes[k - 1] > gap]
    return "[" + "".join(f"\\x{{{codes[a]:x}}}-\\x{{{codes[b - 1]:x}}}" for a, b in zip([0, *cuts], [*cuts, len(codes)], strict=True)) + "]"


@lru_cache(1)
def _combining() -> str:
    """A character class of all combining marks."""
    return _ranges([c for c in range(0x300, 0x20000) if unicodedata.combining(chr(c))])


def strip_marks(c: Column, marks: str = MARKS) -> Column:
    of, to = _plain_letters()
    some, table = _several_letters()
    pairs = F.from_json(F.lit(table), "array<struct<a:string,b:string>>")  # a constant
    apart = F.when(c.rlike(some), F.aggregate(pairs, c, lambda x, p: F.replace(x, p["a"], p["b"]))).otherwise(c)
    # plain ASCII, the most of many texts, goes through as it is
    plain = F.translate(apart, of, to)
    bare = F.when(plain.rlike("[^\\x00-\\u02FF]"), F.regexp_replace(plain, marks, "")).otherwise(plain)
    return F.when(c.rlike("[^\\x00-\\x7F]"), bare).otherwise(c)


def fold(c: Column) -> Column:
    """Marks off, ligatures apart, then lower case, in this order: a capital ligature ends as one that separates words."""
    plain = strip_marks(F.coalesce(c, F.lit("")))
    return F.lower(F.replace(F.replace(plain, F.lit("œ"), F.lit("oe")), F.lit("æ"), F.lit("ae")))


def lower_fold(c: Column) -> Column:
    """Lower case, then all combining marks off: the folding of keyword matching."""
    return strip_marks(F.lower(F.coalesce(c, F.lit(""))), _combining())


def stem(t: Column) -> Column:
    cut = reduce(lambda x, s: F.regexp_replace(x, s[0], s[1]), SUFFIXES, t)
    return F.when((F.length(t) < 5) | t.rlike("^[0-9]+$"), t).otherwise(cut)


def _wanted(t: Column) -> Column:
    return ((F.length(t) >= 2) | t.rlike("^[0-9]$")) & ~t.isin(*STOPWORDS)


def raw_words(c: Column) -> Column:
    """Folded words that are long enough and no stopwords, not stemmed."""
    return F.filter(F.split(fold(c), SEPARATORS), _wanted)


def tokenize(c: Column, most: int | None = None) -> Column:
    """Index terms in order, repeats included; stopwords are dropped before and after stemming."""
    found = F.filter(F.transform(raw_words(c), stem), _wanted)
    return found if most is None else F.slice(found, 1, most)


def surface_pairs(c: Column) -> Column:
    """Distinct (surface, term) of a text."""
    pairs = F.transform(raw_words(c), lambda w: F.struct(w.alias("surface"), stem(w).alias("term")))
    return F.array_distinct(F.filter(pairs, lambda p: _wanted(p["term"])))


def human_words(c: Column) -> Column:
    """Words of four letters and more or single digits, not stemmed: what people type."""
    return F.filter(F.split(fold(c), SEPARATORS), lambda t: ((F.length(t) >= 4) | t.rlike("^[0-9]$")) & ~t.isin(*STOPWORDS))


def runs(tokens: Column, n: int) -> Column:
    """array of the n tokens that stand in a row at each place, as structs of fields "0", "1", ...; shifted copies are zipped, so the
    tokens are made a fixed number of times, not once a place."""
    rest = F.size(tokens) - (n - 1)
    zipped = F.arrays_zip(*[F.slice(tokens, F.lit(k + 1), F.greatest(rest, F.lit(0))).alias(str(k)) for k in range(n)])
    return F.transform(zipped, lambda z: F.array(*[z[str(k)] for k in range(n)]))


def shingles(tokens: Column, sizes: tuple[int, ...] = (2, 3)) -> Column:
    """Runs of 2 and 3 tokens joined by "_", repeats included."""
    return F.concat(*[F.transform(runs(tokens, n), lambda r: F.array_join(r, "_")) for n in sizes])


def pair_key(a: Column, b: Column) -> Column:
    """Key of an unordered pair of different terms; null for equal ones."""
    return F.when(a != b, F.concat(F.lit("n_"), F.least(a, b), F.lit("_"), F.greatest(a, b)))


def proximity_pairs(tokens: Column, weight: float = 3.5, window: int = 5, most: int = 96) -> Column:
    """array<struct<term, weight, at>>: pairs at most `window` apart, nearer ones heavier; the first place (least `at`) of a pair counts."""
    few = F.slice(tokens, 1, most)

    def apart(d: int) -> Column:
        ends = F.arrays_zip(few.alias("a"), F.slice(few, F.lit(d + 1), F.lit(most)).alias("b"))
        return F.transform(ends, lambda z, i: F.struct(pair_key(z["a"], z["b"]).alias("term"), F.lit(weight / d).alias("weight"), (i * (window + 1) + d).alias("at")))

    return F.filter(F.concat(*[apart(d) for d in range(1, window + 1)]), lambda p: p["term"].isNotNull())


def delete_keys(t: Column, least: int = 3) -> Column:
    """A word and all that is left of it after one deletion, two for words of eight letters and more; keys under `least` are left out."""

    def shorter(x: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x))))

    one = F.filter(shorter(t), lambda k: F.length(k) >= least)
    two = F.when((F.length(t) >= 8) & (F.size(one) > 0), F.filter(F.flatten(F.transform(F.array_distinct(one), shorter)), lambda k: F.length(k) >= least)).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(t), F.coalesce(one, F.array().cast("array<string>")), two))


def shard_key(t: Column, depth: int = 3) -> Column:
    return F.rpad(F.substring(t, 1, depth), depth, "_")


def truncated(c: Column, most: int, tail: str = "") -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit(tail))).otherwise(c)


def decade(year: Column) -> Column:
    return F.concat((F.floor(year / 10) * 10).cast("string"), F.lit("s"))


def clean_spaces(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def split_names(c: Column) -> Column:
    """Names of a "; "-joined column, trimmed, blanks dropped."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x != "")


# ---- plan-time twin ------------------------------------------------------------------------------------------------------------


def py_fold(text: str | None) -> str:
    plain = "".join(c for c in unicodedata.normalize("NFKD", text or "") if not "̀" <= c <= "ͯ")
    return plain.replace("œ", "oe").replace("æ", "ae").lower()


def py_stem(token: str) -> str:
    if len(token) < 5 or token.isdigit():
        return token
    for pattern, to in SUFFIXES:
        token = re.sub(pattern, to, token)
    return token


def analyze_query(text: str | None) -> list[tuple[str, str]]:
    """(raw word, term) of a query in order, each term once."""
    keep = lambda t: (len(t) >= 2 or bool(re.fullmatch("[0-9]", t))) and t not in STOPWORDS
    found: dict[str, str] = {}
    for raw in re.split(SEPARATORS, py_fold(text)):
        if keep(raw) and keep(term := py_stem(raw)):
            found.setdefault(term, raw)
    return [(raw, term) for term, raw in found.items()]


def expanded_terms(terms: list[str]) -> list[str]:
    """Base terms and the phrases of 2 and 3 of them in a row."""
    phrases = ["_".join(terms[i : i + n]) for n in (2, 3) for i in range(len(terms) - n + 1)]
    return list(dict.fromkeys([*terms, *phrases]))


def dependency_terms(terms: list[str], window: int = 5, scale: float = 0.12) -> dict[str, float]:
    """Weights of the pairs a query of three terms and more asks for."""
    found: dict[str, float] = {}
    if len(terms) >= 3:
        for i, a in enumerate(terms):
            for d, b in enumerate(terms[i + 1 : i + window + 1], 1):
                if a != b:
                    key = f"n_{min(a, b)}_{max(a, b)}"
                    found[key] = found.get(key, 0.0) + scale / d
    return found


