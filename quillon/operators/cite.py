"""Citations of records in three formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions import text as T

#: Names of the two kinds of records.
MASTER, DOCTOR = "Mémoire de maîtrise", "Thèse de doctorat"


def _text(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def _people(c: str) -> Column:
    return F.filter(F.split(_text(c), r";\s*"), lambda x: x != "")


def _kind() -> Column:
    return F.when(F.col("type") == "memoire", MASTER).otherwise(DOCTOR)


def slug(c: Column) -> Column:
    return F.regexp_replace(T.lower_fold(c), "[^a-z0-9]", "")


def key() -> Column:
    """Family name of the first author, year, first word of three letters of the title."""
    family = F.get(F.split(F.get(F.split(_text("authors"), r";\s*"), 0), ","), 0)
    word = F.get(F.filter(F.split(_text("title"), r"\s+"), lambda w: F.length(w) >= 3), 0)
    made = F.concat(slug(F.when(family == "", F.lit("record")).otherwise(family)), _text("year"), slug(F.coalesce(word, F.lit(""))))
    return F.when(made == "", "record").otherwise(made)


def bibtex() -> Column:
    line = lambda name, value, there: F.when(there, F.concat(F.lit(f"  {name:<6} = {{"), value, F.lit("}")))
    has = lambda c: _text(c) != ""
    fields = F.array_compact(
        F.array(
            line("author", F.array_join(F.split("authors", r";\s*"), " and "), has("authors")),
            line("title", F.col("title"), has("title")),
            line("year", _text("year"), has("year")),
            line("school", F.col("source_name"), has("source_name")),
            line("type", _kind(), F.lit(True)),
            line("note", F.concat(F.lit("Sous la direction de "), F.array_join(F.split("advisors", r";\s*"), " et ")), has("advisors")),
            line("url", F.col("url"), has("url")),
        )
    )
    head = F.when(F.col("type") == "memoire", "@mastersthesis").otherwise("@phdthesis")
    return F.concat(head, F.lit("{"), key(), F.lit(",\n"), F.array_join(fields, ",\n"), F.lit("\n}"))


def _apa_name(a: Column) -> Column:
    parts = F.transform(F.split(a, ","), lambda x: F.trim(x))
    given = F.filter(F.split(F.coalesce(F.get(parts, 1), F.lit("")), r"\s+"), lambda w: w != "")
    return F.trim(F.concat(F.get(parts, 0), F.lit(", "), F.array_join(F.transform(given, lambda w: F.concat(F.left(w, F.lit(1)), F.lit("."))), " ")))


def apa() -> Column:
    names = F.transform(_people("authors"), _apa_name)
    n = F.size(names)
    who = F.when(n == 0, "").when(n == 1, F.get(names, 0)).otherwise(F.concat(F.array_join(F.slice(names, F.lit(1), F.greatest(n - 1, F.lit(0))), ", "), F.lit(", & "), F.get(names, n - 1)))
    year = F.when(_text("year") == "", "s. d.").otherwise(_text("year"))
    return F.trim(F.concat(who, F.lit(" ("), year, F.lit("). *"), _text("title"), F.lit("* ["), _kind(), F.lit(", "), _text("source_name"), F.lit("]. "), _text("url")))


def ris() -> Column:
    tag = lambda t, c: F.when(_text(c) != "", F.concat(F.lit(f"{t}  - "), _text(c)))
    people = lambda t, c: F.transform(_people(c), lambda a: F.concat(F.lit(f"{t}  - "), a))
    one = lambda *cs: F.array_compact(F.array(*cs))
    lines = F.concat(
        F.array(F.lit("TY  - THES")), people("AU", "authors"), people("A2", "advisors"), one(tag("TI", "title"), tag("PY", "year"), tag("PB", "source_name"), F.concat(F.lit("M3  - "), _kind()), tag("UR", "url")), F.array(F.lit("ER  - "))
    )
    return F.array_join(lines, "\n")


def escaped(c: Column) -> Column:
    """HTML-escaped text."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def query_string(q: Column, kind: Column, year_min: Column, year_max: Column, sort: Column, page: Column, disciplines: Column, sources: Column) -> Column:
    """A search's state as a URL query string; default values are left out."""
    pair = lambda k, v, there: F.when(there, F.concat(F.lit(f"{k}="), F.url_encode(v.cast("string"))))
    single = F.array_compact(F.array(pair("q", q, q != ""), pair("type", kind, kind != ""), pair("year_min", year_min, year_min != 0), pair("year_max", year_max, year_max != 0), pair("sort", sort, (sort != "") & (sort != "relevance")), pair("page", page, page > 1)))
    many = lambda k, a: F.transform(a, lambda v: F.concat(F.lit(f"{k}="), F.url_encode(v)))
    return F.array_join(F.concat(single, many("discipline", disciplines), many("source", sources)), "&")


def french_number(n: Column) -> Column:
    """A whole number as French pages show it: groups of three digits with narrow no-break spaces between them."""
    return F.regexp_replace(n.cast("long").cast("string"), r"(?<=\d)(?=(\d{3})+$)", "\u202f")
