"""Four XML dialects of harvested records projected to one Dublin Core shaped payload, with built-in XML parsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TEXT = "array<struct<_VALUE:string,_role:string>>"
_OPTIONS = {"ignoreNamespace": "true", "mode": "PERMISSIVE", "attributePrefix": "_", "valueTag": "_VALUE"}
#: The fields of Dublin Core, and those of its terms that the dialects use.
DC = ("title", "creator", "subject", "description", "publisher", "contributor", "date", "type", "format", "identifier", "source", "language", "relation", "coverage", "rights")
TERMS = ("abstract", "issued", "isPartOf", "available", "created", "modified", "license", "extent", "alternative", "accessRights")
ETD = {"title": "title", "creator": "creator", "subject": "subject", "subjectsss": "subject", "description": "description", "date": "date", "language": "language", "identifier": "identifier", "publisher": "publisher", "type": "type"}
ADVISORS = ("advisor", "thesisadvisor", "supervisor")
_HEADER = "header:struct<_status:string,identifier:string,datestamp:string>"
_MAP = "map<string,array<string>>"


def _parsed(schema: str) -> Column:
    return F.from_xml(F.col("xml"), f"struct<{_HEADER},metadata:struct<{schema}>>", _OPTIONS)


def _texts(c: Column) -> Column:
    trimmed = F.transform(F.coalesce(c, F.array().cast(_TEXT)), lambda x: F.trim(F.regexp_replace(x["_VALUE"], r"^\s+|\s+$", "")))
    return F.filter(trimmed, lambda v: v.isNotNull() & (v != ""))


def _fields(pairs: list[tuple[str, Column]]) -> Column:
    """A map of the fields that have values; pairs of one name are joined in order."""
    names = list(dict.fromkeys(n for n, _ in pairs))
    joined = [F.concat(*[c for n, c in pairs if n == name]) for name in names]
    return F.map_filter(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*joined)), lambda k, v: F.size(v) > 0)


def _trimmed(c: Column) -> Column:
    return F.nullif(F.trim(F.regexp_replace(c, r"^\s+|\s+$", "")), F.lit(""))


def _payload(df: DataFrame, root: Column, dc: Column, authority: Column) -> DataFrame:
    id_ = _trimmed(F.col("r.header.identifier"))
    gone = F.coalesce(F.col("r.header._status") == "deleted", F.lit(False)) & id_.isNotNull()
    bad = id_.isNull() | (~gone & root.isNull())
    ok = ~gone & ~bad
    return df.select(
        *[c for c in df.columns if c not in ("r", "xml")],
        F.when(gone | ok, id_).alias("oai_identifier"), F.when(ok, F.coalesce(F.trim("r.header.datestamp"), F.lit(""))).alias("datestamp"), gone.alias("deleted"), bad.alias("malformed"), F.when(ok, dc).otherwise(F.create_map().cast(_MAP)).alias("dc"), F.when(ok, authority).alias("authoritative_discipline"),
    )


def oai_dc(records: DataFrame) -> DataFrame:
    """records with an xml column, parsed as plain Dublin Core."""
    rows = records.withColumn("r", _parsed("dc:struct<" + ",".join(f"{n}:{_TEXT}" for n in (*DC, *TERMS)) + ">"))
    root = F.col("r.metadata.dc")
    return _payload(rows, root, _fields([(n, _texts(root[n])) for n in (*DC, *TERMS)]), F.lit(None).cast("string"))


def dim(records: DataFrame) -> DataFrame:
    """Qualified fields: authors and advisors apart, degree level and name as type, the first discipline as authority."""
    rows = records.withColumn("r", _parsed("dim:struct<field:array<struct<_VALUE:string,_mdschema:string,_element:string,_qualifier:string>>>"))
    root = F.col("r.metadata.dim")
    each = F.transform(F.coalesce(root["field"], F.array().cast("array<struct<_VALUE:string,_mdschema:string,_element:string,_qualifier:string>>")), lambda x: F.struct(_trimmed(x["_VALUE"]).alias("v"), F.coalesce(x["_mdschema"], F.lit("")).alias("s"), F.coalesce(x["_element"], F.lit("")).alias("e"), F.coalesce(x["_qualifier"], F.lit("")).alias("q")))
    each = F.filter(each, lambda x: x["v"].isNotNull())

    def name(x: Column) -> Column:
        dc = x["s"] == "dc"
        person = F.when(x["q"] == "author", "creator").when(x["q"].isin(*ADVISORS), "_advisor")
        return F.when(dc & (x["e"] == "contributor"), person).when(dc, x["e"]).when((x["e"] == "degree") & x["q"].isin("level", "name"), "type")

    named = F.filter(F.transform(each, lambda x: F.struct(name(x).alias("n"), x["v"].alias("v"))), lambda x: x["n"].isNotNull())
    keys = F.array_distinct(F.transform(named, lambda x: x["n"]))
    dc = F.map_from_arrays(keys, F.transform(keys, lambda k: F.transform(F.filter(named, lambda x: x["n"] == k), lambda x: x["v"])))
    degree = F.filter(each, lambda x: (x["q"] == "discipline") & (((x["s"] == "dc") & (x["e"] == "subject")) | (x["s"].isin("thesis", "etd", "etdms") & (x["e"] == "degree"))))
    return _payload(rows, root, dc, F.get(degree, 0)["v"])


def etdms(records: DataFrame) -> DataFrame:
    """Theses with a degree block; a misspelt subject field counts as subject."""
    fields = ",".join(f"{n}:{_TEXT}" for n in (*ETD, "contributor"))
    rows = records.withColumn("r", _parsed(f"thesis:struct<{fields},degree:struct<name:string,level:string,discipline:string,grantor:string>>"))
    root = F.col("r.metadata.thesis")
    advisors = F.filter(F.coalesce(root["contributor"], F.array().cast(_TEXT)), lambda x: F.lower(F.trim(x["_role"])).isin(*ADVISORS))
    one = lambda c: F.array_compact(F.array(_trimmed(c)))
    d = root["degree"]
    pairs = [(to, _texts(root[n])) for n, to in ETD.items()] + [("_advisor", _texts(advisors)), ("type", one(d["level"])), ("type", one(d["name"])), ("publisher", one(d["grantor"]))]
    return _payload(rows, root, _fields(pairs), _trimmed(d["discipline"]))


#: Names the root element of the last dialect goes by; others are renamed to the first before parsing.
_ROOT = r"(?s)(<(?:\w+:)?metadata\b[^>]*>\s*<)((?:\w+:)?[\w.\-]+)(\b.*</)\2(\s*>\s*</(?:\w+:)?metadata\s*>)"


def uketd(records: DataFrame) -> DataFrame:
    """Electronic theses in Dublin Core terms: the department is the authority; whatever the root element is called."""
    terms = ("department", "degreelevel", "qualificationname", "qualificationlevel", "institution")
    fields = ",".join(f"{n}:{_TEXT}" for n in (*DC, *TERMS, *terms))
    renamed = records.withColumn("xml", F.regexp_replace("xml", _ROOT, "$1uketddc$3uketddc$4"))
    rows = renamed.withColumn("r", _parsed(f"uketddc:struct<{fields}>"))
    root = F.col("r.metadata.uketddc")
    pairs = [(n, _texts(root[n])) for n in (*DC, *TERMS)] + [("type", _texts(root[n])) for n in terms[1:4]] + [("publisher", _texts(root["institution"]))]
    return _payload(rows, root, _fields(pairs), F.get(_texts(root["department"]), 0))


#: Metadata prefixes and their parsers; any other prefix is read as plain Dublin Core.
DIALECTS = {"oai_dc": oai_dc, "dim": dim, "oai_etdms": etdms, "etdms": etdms, "uketd_dc": uketd}


def parse(records: DataFrame, prefix: str = "oai_dc") -> DataFrame:
    return DIALECTS.get(prefix, oai_dc)(records)


def parse_mixed(records: DataFrame, column: str = "metadata_prefix") -> DataFrame:
    """records whose dialects differ from row to row: each dialect parses its rows."""
    other = ~F.col(column).isin("dim", "oai_etdms", "etdms", "uketd_dc") | F.col(column).isNull()
    parts = [oai_dc(records.where(other)), dim(records.where(F.col(column) == "dim")), etdms(records.where(F.col(column).isin("oai_etdms", "etdms"))), uketd(records.where(F.col(column) == "uketd_dc"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
