"""Queries of the data side: parsing, normalisation, classification, merging, labels, streams and the flagship."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import python as P
from quillon.operators import batch_labels, classify, merge, normalize
from quillon.plans.corpus import CORPUS, corpus, table
from quillon.plans.store import stored
from quillon.schema import OTHER
from quillon.sources import parse
from quillon.streaming import ingest
from quillon.tables import scratch

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _with(body: str, *ctes: str) -> str:
    return "WITH " + ", ".join([CORPUS, *ctes]) + " " + body


# ---- flagship ------------------------------------------------------------------------------------------------------------------


@query(
    """SELECT CASE WHEN grouping(r_name) = 0 THEN 'region' WHEN grouping(c_mktsegment) = 0 THEN 'segment' ELSE 'returnflag' END AS facet, coalesce(r_name, c_mktsegment, l_returnflag) AS value, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY GROUPING SETS ((r_name), (c_mktsegment), (l_returnflag))"""
)
def star_revenue_facets(spark, d):
    """Facet counts and revenue over a star join. Catalyst broadcasts the dimensions that are small enough by their statistics."""
    l, o, c, n, r = (table(spark, d, t) for t in ("lineitem", "orders", "customer", "nation", "region"))  # noqa: E741
    rows = l.join(o, l["l_orderkey"] == o["o_orderkey"]).join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    facet = F.when(F.grouping("r_name") == 0, "region").when(F.grouping("c_mktsegment") == 0, "segment").otherwise("returnflag")
    revenue = F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2)
    return rows.groupingSets([["r_name"], ["c_mktsegment"], ["l_returnflag"]], "r_name", "c_mktsegment", "l_returnflag").agg(facet.alias("facet"), F.coalesce("r_name", "c_mktsegment", "l_returnflag").alias("value"), F.count("*").alias("n"), revenue.alias("revenue")).select("facet", "value", "n", "revenue")


# ---- parsing -------------------------------------------------------------------------------------------------------------------


def _escaped(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _record(metadata: Column) -> Column:
    head = F.when(F.col("doc") % 17 == 0, '<header status="deleted">').otherwise("<header>")
    return F.concat(F.lit('<record xmlns="http://www.openarchives.org/OAI/2.0/">'), head, F.lit("<identifier>"), F.col("oai_identifier"), F.lit("</identifier><datestamp>2024-01-"), F.lpad((F.col("doc") % 28 + 1).cast("string"), 2, "0"), F.lit("</datestamp></header><metadata>"), metadata, F.lit("</metadata></record>"))


def _tag(name: str, c: Column, attributes: str = "") -> Column:
    return F.concat(F.lit(f"<{name}{attributes}> "), c, F.lit(f"</{name.split()[0]}>"))


def _title() -> Column:
    return _escaped(F.concat(F.lit("T "), F.col("title"), F.lit(" & more <x>")))


def _source(spark, d) -> DataFrame:
    return corpus(spark, d)


def xml_oai_dc(records: DataFrame) -> DataFrame:
    body = F.concat(F.lit('<oai_dc:dc xmlns:oai_dc="http://www.openarchives.org/OAI/2.0/oai_dc/" xmlns:dc="http://purl.org/dc/elements/1.1/">'), _tag("dc:title", _title()), _tag("dc:creator", F.concat(F.lit("A, "), F.col("source_id"))), _tag("dc:creator", F.lit("B, C")), _tag("dc:subject", F.col("discipline")), _tag("dc:date", F.coalesce(F.col("year").cast("string"), F.lit("   "))), F.lit("<dc:publisher>  </dc:publisher></oai_dc:dc>"))
    return records.fillna({"discipline": "None"}).select("doc", _record(body).alias("xml"))


def xml_dim(records: DataFrame) -> DataFrame:
    f = lambda s, e, q, c: _tag("dim:field", c, f' mdschema="{s}" element="{e}"' + (f' qualifier="{q}"' if q else ""))
    body = F.concat(
        F.lit('<dim:dim xmlns:dim="http://www.dspace.org/xmlns/dspace/dim">'), f("dc", "title", "", _title()), f("dc", "contributor", "author", F.concat(F.lit("A, "), F.col("source_id"))), f("dc", "contributor", "editor", F.lit("E, D")), f("dc", "contributor", "advisor", F.lit("G, H")),
        f("dc", "subject", "discipline", F.concat(F.lit("D "), F.col("language"))), f("thesis", "degree", "level", F.lit("Doctoral")), f("etd", "degree", "discipline", F.lit("other")), F.lit("</dim:dim>"),
    )
    return records.select("doc", _record(body).alias("xml"))


def xml_etdms(records: DataFrame) -> DataFrame:
    body = F.concat(
        F.lit('<thesis xmlns="http://www.ndltd.org/standards/metadata/etdms/1.0/">'), _tag("title", _title()), _tag("creator", F.concat(F.lit("A, "), F.col("source_id"))), _tag("subjectsss", F.col("language")), _tag("contributor", F.lit("G, H"), ' role="Advisor"'), _tag("contributor", F.lit("X, Y"), ' role="committeeMember"'),
        F.lit("<degree>"), _tag("name", F.lit("Ph.D")), _tag("level", F.lit("doctoral")), _tag("discipline", F.concat(F.lit("D "), F.col("language"))), _tag("grantor", F.col("source_name")), F.lit("</degree></thesis>"),
    )
    return records.select("doc", _record(body).alias("xml"))


def xml_uketd(records: DataFrame) -> DataFrame:
    body = F.concat(
        F.lit('<uketd_dc:uketddc xmlns:uketd_dc="http://naca.central.cranfield.ac.uk/ethos-oai/2.0/" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:uketdterms="http://naca.central.cranfield.ac.uk/ethos-oai/terms/">'), _tag("dc:title", _title()), _tag("dc:creator", F.concat(F.lit("A, "), F.col("source_id"))),
        _tag("uketdterms:department", F.concat(F.lit("D "), F.col("language"))), _tag("uketdterms:qualificationlevel", F.lit("masters")), _tag("uketdterms:institution", F.col("source_name")), F.lit("</uketd_dc:uketddc>"),
    )
    return records.select("doc", _record(body).alias("xml"))


_GONE = "doc % 17 = 0"
_PARSED = "SELECT doc, oai_identifier, CASE WHEN {g} THEN NULL ELSE '2024-01-' || lpad(CAST(doc % 28 + 1 AS VARCHAR), 2, '0') END AS datestamp, {g} AS deleted, CASE WHEN NOT {g} THEN trim('T ' || title || ' & more <x>') END AS title, {rest} FROM corpus"


def _flat(parsed: DataFrame, *fields: str) -> DataFrame:
    value = lambda f: F.array_join(F.element_at("dc", F.lit(f)), "|").alias(f.strip("_"))
    title = F.array_join(F.element_at("dc", F.lit("title")), "|").alias("title")
    return parsed.select("doc", "oai_identifier", "datestamp", "deleted", title, F.col("authoritative_discipline").alias("authority"), *map(value, fields))


def _unless_gone(x: str) -> str:
    return f"CASE WHEN NOT {_GONE} THEN {x} END"


@query(_with(_PARSED.format(g=_GONE, rest=f"CAST(NULL AS VARCHAR) AS authority, {_unless_gone(chr(39) + 'A, ' + chr(39) + ' || source_id || ' + chr(39) + '|B, C' + chr(39))} AS creator, {_unless_gone('coalesce(discipline, ' + chr(39) + 'None' + chr(39) + ')')} AS subject, {_unless_gone('CAST(year AS VARCHAR)')} AS date, CAST(NULL AS VARCHAR) AS publisher")))
def parse_oai_dc(spark, d):
    return _flat(parse.parse(xml_oai_dc(_source(spark, d)), "oai_dc"), "creator", "subject", "date", "publisher")


@query(_with(_PARSED.format(g=_GONE, rest=f"{_unless_gone(chr(39) + 'D ' + chr(39) + ' || language')} AS authority, {_unless_gone(chr(39) + 'A, ' + chr(39) + ' || source_id')} AS creator, {_unless_gone(chr(39) + 'G, H' + chr(39))} AS advisor, {_unless_gone(chr(39) + 'D ' + chr(39) + ' || language')} AS subject, {_unless_gone(chr(39) + 'Doctoral' + chr(39))} AS type")))
def parse_dim(spark, d):
    return _flat(parse.parse(xml_dim(_source(spark, d)), "dim"), "creator", "_advisor", "subject", "type")


@query(_with(_PARSED.format(g=_GONE, rest=f"{_unless_gone(chr(39) + 'D ' + chr(39) + ' || language')} AS authority, {_unless_gone(chr(39) + 'A, ' + chr(39) + ' || source_id')} AS creator, {_unless_gone('language')} AS subject, {_unless_gone(chr(39) + 'G, H' + chr(39))} AS advisor, {_unless_gone(chr(39) + 'doctoral|Ph.D' + chr(39))} AS type, {_unless_gone('source_name')} AS publisher")))
def parse_etdms(spark, d):
    return _flat(parse.parse(xml_etdms(_source(spark, d)), "etdms"), "creator", "subject", "_advisor", "type", "publisher")


@query(_with(_PARSED.format(g=_GONE, rest=f"{_unless_gone(chr(39) + 'D ' + chr(39) + ' || language')} AS authority, {_unless_gone(chr(39) + 'A, ' + chr(39) + ' || source_id')} AS creator, {_unless_gone(chr(39) + 'masters' + chr(39))} AS type, {_unless_gone('source_name')} AS publisher")))
def parse_uketd(spark, d):
    return _flat(parse.parse(xml_uketd(_source(spark, d)), "uketd_dc"), "creator", "type", "publisher")


def _routed(spark, d) -> DataFrame:
    records = _source(spark, d)
    xml = xml_dim(records.where("doc % 2 = 0")).withColumn("metadata_prefix", F.lit("dim")).unionByName(xml_oai_dc(records.where("doc % 2 = 1")).withColumn("metadata_prefix", F.lit("oai_dc")))
    # parsed records are a table of their own: what is derived from them doesn't parse again
    parsed = stored(spark, d, "parsed", lambda: parse.parse_mixed(xml)).join(records.select("doc", "source_id", "source_name"), "doc")
    done = normalize.normalized(parsed.where("not deleted and not malformed")).select("oai_identifier", "kept", "title", "type")
    return normalize.outcomes(parsed.select("doc", "oai_identifier", "source_id", "deleted").join(done, "oai_identifier", "left"))


_HINTED = "regexp_matches(strip_accents(lower('T ' || title || ' & more <x>' || ' ' || coalesce(discipline, 'None'))), '" + "|".join(normalize.HINTS) + "')"


@query(_with(f"SELECT source_id, count(*) AS seen, count(*) FILTER (doc % 17 <> 0 AND (doc % 2 = 0 OR {_HINTED})) AS kept, count(*) FILTER (doc % 17 = 0) AS deleted, count(*) FILTER (doc % 17 <> 0 AND NOT (doc % 2 = 0 OR {_HINTED})) AS skipped FROM corpus GROUP BY ROLLUP (source_id)"))
def ingest_outcomes(spark, d):
    return normalize.harvest_statistics(_routed(spark, d))


# ---- normalisation -------------------------------------------------------------------------------------------------------------


#: The test pages hold these five references; "&amp;" is decoded last, so that nothing is decoded twice.
_DECODED = "replace(replace(replace(replace(replace(replace(html, '&copy;', chr(169)), '&middot;', chr(183)), '&quot;', chr(34)), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"


@query(f"SELECT page_id, trim(regexp_replace({_DECODED}, '\\s+', ' ', 'g')) AS text FROM pages")
def normalize_clean_html(spark, d):
    return table(spark, d, "pages").select("page_id", P.cleaned("html").alias("text"))


#: Type strings of the test, by number; the last two have none.
_TYPES = ("Doctoral thesis", "Master's thesis", "Article", "Mémoire de maîtrise", "Thèse", "info:eu-repo/semantics/masterThesis", "Book", "", "")
_SPARK_TYPE = lambda: F.element_at(F.array(*map(F.lit, _TYPES)), (F.col("doc") % 9 + 1).cast("int"))


def _dc(**fields: Column) -> Column:
    names = F.array(*map(F.lit, fields))
    return F.map_from_arrays(names, F.array(*fields.values()))


@query(_with("SELECT doc, CASE doc % 9 WHEN 0 THEN 'thesis' WHEN 1 THEN 'memoire' WHEN 3 THEN 'memoire' WHEN 4 THEN 'thesis' WHEN 5 THEN 'memoire' WHEN 7 THEN 'thesis' WHEN 8 THEN 'memoire' END AS kind FROM corpus"))
def normalize_type(spark, d):
    text = F.when(F.col("doc") % 9 == 7, "a PhD dissertation").when(F.col("doc") % 9 == 8, "a master's dissertation").otherwise("nothing")
    dc = _dc(type=F.array(_SPARK_TYPE()), description=F.array(text))
    return corpus(spark, d).select("doc", normalize.kind(dc).alias("kind"))


_DATES = "'on ' || (1790 + doc % 340) || '-05-01; ' || (1900 + doc * 7 % 250) || ' x' || (1950 + doc % 60)"


@query(_with(f"SELECT doc, list_min(list_filter(list_transform(regexp_extract_all({_DATES}, '\\b(1[89]\\d{{2}}|20\\d{{2}}|21\\d{{2}})\\b'), lambda y: CAST(y AS INTEGER)), lambda y: y BETWEEN 1800 AND 2100)) AS year FROM corpus"))
def normalize_year(spark, d):
    i = F.col("doc")
    date = F.concat(F.lit("on "), (1790 + i % 340).cast("string"), F.lit("-05-01; "), (1900 + i * 7 % 250).cast("string"))
    dc = _dc(date=F.array(date), issued=F.array(F.concat(F.lit("x"), (1950 + i % 60).cast("string"))))
    return corpus(spark, d).select("doc", normalize.year(dc).alias("year"))


@query(_with("SELECT doc, CASE doc % 5 WHEN 0 THEN 'https://x.example/' || doc || '/id/eprint/7' WHEN 1 THEN 'https://doi.org/10.1/' || doc WHEN 2 THEN 'https://x.example/' || doc WHEN 3 THEN 'https://x.example/' || doc || '.pdf' ELSE '' END AS address FROM corpus"))
def pick_best_url(spark, d):
    i, n = F.col("doc") % 5, F.col("doc").cast("string")
    at = lambda tail: F.concat(F.lit("https://x.example/"), n, F.lit(tail))
    ids = F.when(i == 0, F.array(at(".pdf"), at("/id/eprint/7"))).when(i == 1, F.array(at(""), F.concat(F.lit("https://doi.org/10.1/"), n), F.concat(F.lit("http://hdl.handle.net/"), n))).when(i == 2, F.array(at(".PDF"), at(""), at("/other"))).when(i == 3, F.array(at(".pdf"))).otherwise(F.array(F.lit("urn:isbn:1"), n))
    return corpus(spark, d).select("doc", normalize.address(_dc(identifier=ids)).alias("address"))


# ---- classification ------------------------------------------------------------------------------------------------------------

#: Keywords put into the records of the test so that every pass has something to find.
_SUBJECT = ("Étude en écologie", "law and order", "flaw ", "machine learning", "socio-economique", "topology", "nothing here", "")
_ABSTRACT = ("on education", "mathematics and design", "political science", "les étoiles", "astronomy")
_AUTHORITY = ("", "", "", "", "Génie civil", "Chimie organique", "unknown school")


def _labelled(spark, d) -> DataFrame:
    """The records with a keyword put behind their own subjects and whole text, so that every pass has something to find."""
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (F.col("doc") % n + 1).cast("int"))
    return corpus(spark, d).select("doc", "title", "publisher", "oai_identifier", F.concat_ws(" ", "subjects", pick(_SUBJECT, len(_SUBJECT))).alias("subjects"), F.concat_ws(" ", "abstract", pick(_ABSTRACT, len(_ABSTRACT))).alias("abstract"), pick(_AUTHORITY, len(_AUTHORITY)).alias("authoritative_discipline"))


def _pick(values: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + f"][doc % {len(values)} + 1]"


def _holds(blob: str, keyword: str) -> str:
    k = keyword.replace("'", "''")
    return f"contains({blob}, '{k}')" if " " in k else f"regexp_matches({blob}, '(^|[^a-z]){k}s?([^a-z]|$)')"


def _first(blob: str, broad: bool = True) -> str:
    arms = [f"WHEN {' OR '.join(_holds(blob, k) for k in words)} THEN '{label.replace(chr(39), chr(39) * 2)}'" for label, keywords in classify.CORE_RULES if (words := classify.kept_keywords(label, keywords, broad))]
    return "CASE " + " ".join(arms) + " END"


_FOLDED = "strip_accents(lower({}))"
_CLASSIFIED = f"""lb AS (SELECT doc, {_FOLDED.format('trim(' + _pick(_AUTHORITY) + ')')} AS a, {_FOLDED.format("subjects || ' ' || " + _pick(_SUBJECT) + " || ' ' || title || ' ' || publisher")} AS m, {_FOLDED.format("abstract || ' ' || " + _pick(_ABSTRACT))} AS b FROM corpus),
 p AS (SELECT doc, CASE WHEN a <> '' THEN {_first('a')} END AS x, {_first('m')} AS y, {_first('b', False)} AS z FROM lb),
 cl AS (SELECT doc, coalesce(x, y, z, '{OTHER}') AS discipline, CASE WHEN x IS NOT NULL THEN 'auth' WHEN y IS NOT NULL THEN 'rule' WHEN z IS NOT NULL THEN 'rule_abstract' ELSE 'none' END AS discipline_source FROM p)"""


@query(_with("SELECT doc, discipline, CASE discipline_source WHEN 'none' THEN 'rule' ELSE discipline_source END AS discipline_source FROM cl", _CLASSIFIED))
def classify_three_pass(spark, d):
    return classify.classified(_labelled(spark, d)).select("doc", "discipline", "discipline_source")


@query(_with("SELECT discipline_source, count(*) AS n, round(count(*) / CAST((SELECT count(*) FROM cl) AS DOUBLE), 6) AS share FROM cl GROUP BY discipline_source", _CLASSIFIED))
def classify_provenance_mix(spark, d):
    return classify.provenance_mix(classify.classified(_labelled(spark, d), stored=False).select("discipline_source"))


_OLD_LABEL, _OLD_SOURCE = ("Chimie", OTHER, "Droit", "Écologie", OTHER), ("rule", "llm", "manual", "rule", "rule_abstract", "llm")
_MOVED = f"""ol AS (SELECT doc, {_pick(_OLD_LABEL)} AS old, {_pick(_OLD_SOURCE)} AS os FROM corpus),
 ac AS (SELECT doc, old, os, discipline AS new, discipline_source AS ns, CASE WHEN os = 'manual' THEN 'keep' WHEN os = 'llm' AND discipline_source <> 'auth' THEN 'keep' WHEN os = 'llm' AND old <> discipline THEN 'llm_to_auth' WHEN old = '{OTHER}' AND discipline <> '{OTHER}' THEN 'other_to_specific' WHEN old <> '{OTHER}' AND discipline <> '{OTHER}' AND old <> discipline THEN 'reassigned' WHEN old = discipline AND discipline_source <> os AND discipline_source <> 'none' THEN 'provenance' ELSE 'keep' END AS action FROM ol JOIN cl USING (doc))"""


def _moved(spark, d) -> DataFrame:
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("doc") % len(values) + 1).cast("int"))
    return classify.reclassified(_labelled(spark, d).withColumn("discipline", pick(_OLD_LABEL)).withColumn("discipline_source", pick(_OLD_SOURCE)))


@query(_with("SELECT doc, action FROM ac", _CLASSIFIED, _MOVED))
def reclassify_actions(spark, d):
    return _moved(spark, d).select("doc", "action")


@query(_with("SELECT old AS from_label, new AS to_label, count(*) AS n FROM ac WHERE action IN ('llm_to_auth', 'other_to_specific', 'reassigned') GROUP BY ALL ORDER BY n DESC, 1, 2 LIMIT 20", _CLASSIFIED, _MOVED))
def reclassify_transitions(spark, d):
    return classify.transitions(_moved(spark, d))


# ---- merging -------------------------------------------------------------------------------------------------------------------

_TAGS = {"view": "rule", "signup": "rule_abstract", "purchase": "llm", "click": "auth"}
_FEED = "fd AS (SELECT user_id, ts, event_id, value, 'd' || (event_id % 7) AS label, CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _TAGS.items()) + " END AS source, event_type = 'error' AND event_id % 3 = 0 AS gone FROM events)"
_RANK = "CASE source WHEN 'manual' THEN 4 WHEN 'auth' THEN 3 WHEN 'llm' THEN 2 WHEN 'rule_abstract' THEN 1 ELSE 0 END"
_FOLD = f"""{_FEED}, lg AS (SELECT *, max(CASE WHEN gone THEN ts END) OVER (PARTITION BY user_id) AS gt, max(CASE WHEN gone THEN (epoch_us(ts)::HUGEINT * 1000000000 + event_id) END) OVER (PARTITION BY user_id) AS gk FROM fd),
 lv AS (SELECT * FROM lg WHERE NOT gone AND (gk IS NULL OR epoch_us(ts)::HUGEINT * 1000000000 + event_id > gk)),
 st AS (SELECT user_id, arg_max(value, epoch_us(ts)::HUGEINT * 1000000000 + event_id) AS value, arg_max(struct_pack(l := label, s := coalesce(source, '')), ({_RANK})::HUGEINT * 10000000000000000000000000000 + epoch_us(ts)::HUGEINT * 1000000000 + event_id) AS b FROM lv GROUP BY user_id)"""


def _feed(events: DataFrame) -> DataFrame:
    source = F.lit(None).cast("string")
    for k, v in _TAGS.items():
        source = F.when(F.col("event_type") == k, v).otherwise(source)
    return events.select("user_id", "ts", "event_id", "value", F.concat(F.lit("d"), (F.col("event_id") % 7).cast("string")).alias("label"), source.alias("source"), ((F.col("event_type") == "error") & (F.col("event_id") % 3 == 0)).alias("gone"))


_STATE = f"WITH {_FOLD} SELECT user_id, value, b.l AS label, nullif(b.s, '') AS source FROM st"


@query(_STATE)
def upsert_rank_gated(spark, d):
    return merge.folded(_feed(table(spark, d, "events")), "user_id", ["ts", "event_id"], "source", "gone", ["value"], "label")


def _halves(spark, d) -> tuple[DataFrame, DataFrame]:
    rows = _feed(table(spark, d, "events")).select(F.col("user_id").alias("oai_identifier"), "ts", "event_id", "value", F.col("label").alias("discipline"), F.col("source").alias("discipline_source"))
    one = lambda p: merge.latest(rows.where("value < 50" if p == 0 else "value >= 50"), "oai_identifier", ["ts", "event_id"]).select("oai_identifier", "value", "discipline", "discipline_source", F.col("event_id").alias("harvested_at"))
    return one(0), one(1)


_HALF = "SELECT user_id, value, label, source, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM fd WHERE {p}) WHERE rn = 1"


@query(
    f"""WITH {_FEED}, o AS ({_HALF.format(p='value < 50')}), n AS ({_HALF.format(p='value >= 50')}), r AS (SELECT coalesce(o.user_id, n.user_id) AS oai_identifier, CASE WHEN n.user_id IS NOT NULL THEN n.value ELSE o.value END AS value,
 n.user_id IS NOT NULL AND (o.user_id IS NULL OR {_RANK.replace('source', 'n.source')} >= {_RANK.replace('source', 'o.source')}) AS gate, o.label AS ol, n.label AS nl, o.source AS os, n.source AS ns, coalesce(o.event_id, n.event_id) AS harvested_at FROM o FULL JOIN n USING (user_id))
SELECT oai_identifier, value, CASE WHEN gate THEN nl ELSE ol END AS discipline, CASE WHEN gate THEN ns ELSE os END AS discipline_source, harvested_at FROM r"""
)
def upsert_batch(spark, d):
    old, new = _halves(spark, d)
    return merge.upserted(old, new)


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def apply_tombstones(spark, d):
    gone = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return merge.without(table(spark, d, "customer"), gone, "c_custkey").select("c_custkey", "c_name")


@query(
    """WITH s AS (SELECT 'n' || n_nationkey AS source_id, '2024-01-01' AS last_harvest_started, CAST(0 AS BIGINT) AS last_records_seen FROM nation), r AS (SELECT 'n' || c_nationkey AS source_id, count(*) AS c FROM customer GROUP BY 1)
SELECT s.source_id, CASE WHEN c IS NOT NULL AND c % 3 <> 0 THEN '2024-02-01' ELSE last_harvest_started END AS last_harvest_started, CASE WHEN c IS NOT NULL AND c % 3 <> 0 THEN c ELSE last_records_seen END AS last_records_seen FROM s LEFT JOIN r USING (source_id)"""
)
def checkpoint_state(spark, d):
    state = table(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("source_id"), F.lit("2024-01-01").alias("last_harvest_started"), F.lit(0).cast("long").alias("last_records_seen"))
    runs = table(spark, d, "customer").groupBy(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("source_id")).agg(F.count("*").alias("last_records_seen"))
    return merge.checkpointed(state, runs.select("source_id", F.lit("2024-02-01").alias("last_harvest_started"), "last_records_seen", (F.col("last_records_seen") % 3 != 0).alias("succeeded")))


@query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def latest_per_key(spark, d):
    return merge.latest(table(spark, d, "events").select("user_id", "ts", "event_id", "event_type", "value"), "user_id", ["ts", "event_id"]).drop("ts")


# ---- labels from a batch model -------------------------------------------------------------------------------------------------

_LABELS = ["Chimie", "Droit", OTHER]


def _unlabelled(spark, d) -> DataFrame:
    """All records; those in languages without a label of their own are unclassified, and are what the selector finds."""
    return corpus(spark, d).withColumn("discipline", F.coalesce("discipline", F.lit(OTHER)))


@query(
    _with(
        f"""SELECT '{{"key":' || to_json(oai_identifier) || ',"request":{{"contents":[{{"role":"user","parts":[{{"text":' || to_json('Disciplines possibles : {', '.join(_LABELS)}' || chr(10) || chr(10) || 'Titre : ' || substr(title, 1, 300) || chr(10) || 'Auteur·rice·s : ' || substr(authors, 1, 200) || chr(10) || 'Université : ' || source_name || '  ·  Année : ' || coalesce(CAST(year AS VARCHAR), '—') || chr(10) || 'Mots-clés (dc:subject) : ' || substr(subjects, 1, 300) || chr(10) || 'Éditeur / département (dc:publisher) : ' || substr(publisher, 1, 200) || chr(10) || 'Résumé : ' || CASE WHEN abstract = '' THEN '—' ELSE substr(abstract, 1, 800) END || chr(10) || chr(10) || 'Choisis la discipline la plus pertinente.') || '}}]}}],"systemInstruction":{{"parts":[{{"text":"Label."}}]}},"generationConfig":{{"responseMimeType":"application/json","responseSchema":{{"type":"OBJECT","properties":{{"discipline":{{"type":"STRING","enum":["Chimie","Droit","{OTHER}"]}}}},"required":["discipline"]}},"temperature":0.0,"thinkingConfig":{{"thinkingBudget":0}},"maxOutputTokens":128}}}}}}' AS value FROM corpus WHERE discipline IS NULL"""
    )
)
def batch_requests_jsonl(spark, d):
    return batch_labels.requests(batch_labels.unclassified(_unlabelled(spark, d)), _LABELS, "Label.")


@query(_with(f"SELECT oai_identifier, CASE WHEN doc % 3 = 0 THEN 'Chimie' ELSE coalesce(discipline, '{OTHER}') END AS discipline, CASE WHEN doc % 3 = 0 THEN 'llm' ELSE 'rule' END AS discipline_source FROM corpus"))
def batch_apply_labels(spark, d):
    rows = _unlabelled(spark, d).withColumn("discipline_source", F.lit("rule"))
    text = F.when(F.col("doc") % 3 == 0, '{"discipline": "Chimie"}').when(F.col("doc") % 3 == 1, '{"discipline": "No such label"}').otherwise("{oops")
    line = F.to_json(F.struct(F.col("oai_identifier").alias("key"), F.struct(F.array(F.struct(F.struct(F.array(F.struct(text.alias("text"))).alias("parts")).alias("content"))).alias("candidates")).alias("response")))
    return batch_labels.apply(rows, batch_labels.answers(rows.select(line.alias("value"))), _LABELS).select("oai_identifier", "discipline", "discipline_source")


# ---- streams -------------------------------------------------------------------------------------------------------------------


def _event_stream(spark, d) -> DataFrame:
    schema = table(spark, d, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)


@query(_STATE)
def stream_incremental_upsert(spark, d):
    at = scratch(spark)
    records = ingest.RecordTable(spark, f"{at}/table")
    ingest.ingest(_feed(_event_stream(spark, d)), records, f"{at}/checkpoint", "user_id", ["ts", "event_id"], "source", "gone", ["value"], "label").awaitTermination()
    return records.read()


@query("SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_window_counts(spark, d):
    counts = ingest.window_counts(_event_stream(spark, d))
    return ingest.run_to_table(counts, f"{scratch(spark)}/checkpoint").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
