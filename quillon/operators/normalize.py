"""Harvested payloads to records: cleaning, type, year, address, authoritative discipline, keep-filter and outcomes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.functions.python import unescaped

#: What marks a record's kind, looked for as substrings.
HINTS = ("thesis", "these", "dissertation", "memoir", "memoire", "doctoral", "master")
DOCTOR = ("doctoral", "doctorate", "doctorat", "these de doctorat", "ph.d", "phd", "doctor of")
MASTER = ("master thesis", "master's thesis", "masters thesis", "masters", "memoire de maitrise", "info:eu-repo/semantics/masterthesis", "m.a.", "m.sc", "m.eng", "m.ed")
DOCTOR_TEXT = ("doctoral", "ph.d", "phd", "doctorat")
MASTER_TEXT = ("master", "maitrise", "memoire", "m.a.", "m.sc")
MASTER_HINT = ("master", "maitrise", "memoire")
YEAR = r"\b(1[89]\d{2}|20\d{2}|21\d{2})\b"


def values(dc: Column, name: str) -> Column:
    return F.coalesce(F.element_at(dc, F.lit(name)), F.array().cast("array<string>"))


def _any(blob: Column, marks: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [blob.contains(m) for m in marks])


def kind(dc: Column) -> Column:
    """'thesis', 'memoire' or null. The type field decides if there is one; else subjects, descriptions and titles do."""
    given = F.filter(values(dc, "type"), lambda v: v != "")
    blob = T.strip_marks(F.lower(F.array_join(given, " ")))
    text = T.strip_marks(F.lower(F.array_join(F.concat(values(dc, "subject"), values(dc, "description"), values(dc, "title")), " ")))
    typed = F.when(_any(blob, DOCTOR), "thesis").when(_any(blob, MASTER), "memoire").when(_any(blob, HINTS), F.when(_any(blob, MASTER_HINT), "memoire").otherwise("thesis"))
    guessed = F.when(_any(text, HINTS), F.when(_any(text, DOCTOR_TEXT), "thesis").when(_any(text, MASTER_TEXT), "memoire").otherwise("thesis"))
    return F.when(F.size(given) > 0, typed).otherwise(guessed)


def year(dc: Column) -> Column:
    """The earliest year from 1800 to 2100 among the dates."""
    found = F.flatten(F.transform(F.concat(values(dc, "date"), values(dc, "issued")), lambda v: F.regexp_extract_all(v, F.lit(YEAR), F.lit(1))))
    return F.array_min(F.filter(F.transform(found, lambda y: y.cast("int")), lambda y: y.between(1800, 2100)))


def address(dc: Column) -> Column:
    """The best web address: resolvers first, then landing pages, then others, raw files last; the first of equals."""
    urls = F.filter(F.concat(values(dc, "identifier"), values(dc, "relation")), lambda u: u.startswith("http://") | u.startswith("https://"))

    def worth(u: Column) -> Column:
        low = F.lower(u)
        file = low.endswith(".pdf") | low.endswith(".doc") | low.endswith(".docx")
        return F.when(file, 0).when(low.contains("doi.org") | low.contains("handle.net"), 3).when(low.contains("/id/eprint/") & ~low.endswith("/"), 2).otherwise(1)

    rated = F.transform(urls, lambda u, i: F.struct(worth(u).alias("worth"), (-i).alias("first"), u.alias("url")))
    return F.coalesce(F.array_max(rated)["url"], F.lit(""))


def first(dc: Column, name: str) -> Column:
    return F.coalesce(unescaped(F.get(values(dc, name), 0)), F.lit(""))


def joined(dc: Column, name: str) -> Column:
    """All values that are not blank, cleaned and joined. A unit separator keeps them apart for one cleaning pass."""
    kept = F.filter(values(dc, name), lambda v: F.trim(F.regexp_replace(v, r"\s+", " ")) != "")
    clean = F.split(unescaped(F.array_join(kept, "\u0001")), "\u0001")
    return F.when(F.size(kept) > 0, F.array_join(F.transform(clean, lambda x: F.trim(x)), "; ")).otherwise(F.lit(""))


def with_authority(dc: Column, authority: Column) -> Column:
    """dc with the source's own discipline in front of its subjects, if it isn't among them."""
    given = F.trim(F.coalesce(authority, F.lit("")))
    subjects = values(dc, "subject")
    more = (given != "") & ~F.array_contains(subjects, given)
    rest = F.map_filter(dc, lambda k, v: k != "subject")
    return F.when(more, F.map_concat(rest, F.create_map(F.lit("subject"), F.array_prepend(subjects, given)))).otherwise(dc)


def normalized(payloads: DataFrame) -> DataFrame:
    """Records from (oai_identifier, datestamp, dc, authoritative_discipline, source_id, source_name), with `kept`: whether it is a
    thesis with a title."""
    d = payloads.withColumn("dc", with_authority(F.col("dc"), F.col("authoritative_discipline")))
    dc = F.col("dc")
    out = d.select(
        "oai_identifier", "source_id", "source_name", first(dc, "title").alias("title"), joined(dc, "creator").alias("authors"), joined(dc, "_advisor").alias("advisors"), first(dc, "description").alias("abstract"), joined(dc, "subject").alias("subjects"), year(dc).alias("year"),
        kind(dc).alias("type"), first(dc, "language").alias("language"), first(dc, "publisher").alias("publisher"), address(dc).alias("url"), F.nullif(F.trim("authoritative_discipline"), F.lit("")).alias("authoritative_discipline"), F.coalesce("datestamp", F.lit("")).alias("datestamp"), (F.cardinality("dc") > 0).alias("has_dc"),
    )
    return out.withColumn("kept", F.coalesce(F.col("has_dc") & F.col("type").isNotNull() & (F.col("title") != ""), F.lit(False))).drop("has_dc")


def with_fallback(payloads: DataFrame, plain: DataFrame) -> DataFrame:
    """payloads with dc and datestamp of `plain` (the same records in plain Dublin Core) where a record has an identifier but no fields;
    `fallback` tells where. The authoritative discipline stays."""
    other = plain.select("oai_identifier", F.col("dc").alias("p_dc"), F.col("datestamp").alias("p_date"))
    empty = F.col("oai_identifier").isNotNull() & ~F.coalesce("deleted", F.lit(False)) & (F.coalesce(F.cardinality("dc"), F.lit(0)) == 0)
    both = payloads.join(other, "oai_identifier", "left").withColumn("fallback", empty & F.col("p_dc").isNotNull())
    return both.withColumn("dc", F.when(F.col("fallback"), F.col("p_dc")).otherwise(F.col("dc"))).withColumn("datestamp", F.when(F.col("fallback"), F.col("p_date")).otherwise(F.col("datestamp"))).drop("p_dc", "p_date")


def outcomes(records: DataFrame) -> DataFrame:
    """records with `outcome`: deleted, kept or skipped; malformed records are skipped, never raised."""
    gone = F.coalesce(F.col("deleted"), F.lit(False))
    return records.withColumn("outcome", F.when(gone, "deleted").when(F.coalesce("kept", F.lit(False)), "kept").otherwise("skipped"))


def harvest_statistics(routed: DataFrame) -> DataFrame:
    """Seen, kept, deleted and skipped records a source, and over all (source null)."""
    n = lambda o: F.count_if(F.col("outcome") == o).alias(o)
    return routed.rollup("source_id").agg(F.count("*").alias("seen"), n("kept"), n("deleted"), n("skipped"))
