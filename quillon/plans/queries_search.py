"""Queries of the search side: filters, facets, text analysis, index, ranking, spelling, expansion, evaluation, citations."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions import python as P
from quillon.functions import text as T
from quillon.operators import cite, evaluate, expand, fulltext, index, search, typo, views
from quillon.operators import query as Q
from quillon.plans import sql as S
from quillon.plans.corpus import CORPUS, corpus, table
from quillon.plans.store import held, stored
from quillon.schema import OTHER

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

TERMS = ["erin", "ther", "tion"]
PAIR = ["erin", "ther"]


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _with(body: str, *ctes: str) -> str:
    return "WITH " + ", ".join([CORPUS, *ctes]) + " " + body


# ---- filters, counts, pages ----------------------------------------------------------------------------------------------------


@query(_with("SELECT doc, source_id, type, year FROM corpus WHERE discipline IN ('English', 'German') AND source_id IN ('src0', 'src3') AND type = 'thesis' AND year >= 1960 AND year <= 2015"))
def filter_conjunctive(spark, d):
    r = Q.Request(discipline=("English", "German"), source=("src0", "src3"), type="thesis", year_min=1960, year_max=2015)
    return Q.filtered(corpus(spark, d), r).select("doc", "source_id", "type", "year")


@query(_with("SELECT doc, discipline, source_id FROM corpus WHERE discipline IN ('French', 'German') AND source_id IN ('src1', 'src2', 'src4')"))
def filter_in_list(spark, d):
    return Q.filtered(corpus(spark, d), Q.Request(discipline=("French", "German"), source=("src1", "src2", "src4"))).select("doc", "discipline", "source_id")


@query(_with("SELECT doc, authors FROM corpus WHERE position(';src3;' IN ';' || replace(replace(authors, '; ', ';'), ' ;', ';') || ';') > 0 AND position(';a1;' IN ';' || replace(replace(authors, '; ', ';'), ' ;', ';') || ';') > 0"))
def filter_author_membership(spark, d):
    return Q.filtered(corpus(spark, d), Q.Request(author=("src3", "a1"))).select("doc", "authors")


@query(_with("SELECT doc, year FROM corpus WHERE year >= 1990 AND year <= 2000"))
def filter_year_range(spark, d):
    return Q.filtered(corpus(spark, d), Q.Request(year_min=1990, year_max=2000)).select("doc", "year")


_FACETS = f"""SELECT 'discipline' AS facet, coalesce(discipline, '{OTHER}') AS value, coalesce(discipline, '{OTHER}') AS label, count(*) AS n FROM hits GROUP BY ALL
 UNION ALL SELECT 'source', source_id, source_name, count(*) FROM hits GROUP BY ALL
 UNION ALL SELECT 'type', coalesce(type, '?'), coalesce(type, '?'), count(*) FROM hits GROUP BY ALL
 UNION ALL SELECT 'decade', (year // 10 * 10) || 's', (year // 10 * 10) || 's', count(*) FROM hits WHERE year IS NOT NULL GROUP BY ALL
 UNION ALL SELECT * FROM (SELECT 'author', name, name AS l, count(*) AS n FROM (SELECT trim(unnest(string_split(authors, ';'))) AS name FROM hits) WHERE name <> '' GROUP BY ALL ORDER BY n DESC, name LIMIT 50)"""


@query(_with(_FACETS, "hits AS (SELECT * FROM corpus)"))
def facet_counts_all(spark, d):
    return Q.facets(corpus(spark, d), Q.Request())


@query(_with(_FACETS, "hits AS (SELECT * FROM corpus WHERE discipline = 'English' AND year >= 1980)"))
def facet_counts_filtered(spark, d):
    return Q.facets(corpus(spark, d), Q.Request(discipline=("English",), year_min=1980))


@query(_with("SELECT name, count(*) AS n FROM (SELECT trim(unnest(string_split(authors, ';'))) AS name FROM corpus) WHERE name <> '' GROUP BY name ORDER BY n DESC, name LIMIT 50"))
def facet_authors_top50(spark, d):
    found = Q.facets(corpus(spark, d), Q.Request())
    return found.where("facet = 'author'").select(F.col("value").alias("name"), "n")


@query(_with("SELECT source_id, source_name, count(*) AS n FROM corpus GROUP BY ALL ORDER BY source_name"))
def facet_sources_by_name(spark, d):
    return Q.sources(corpus(spark, d))


@query(_with("SELECT (year // 10 * 10) || 's' AS decade, count(*) AS n FROM corpus WHERE year IS NOT NULL GROUP BY 1 ORDER BY 1"))
def facet_decades(spark, d):
    return Q.facets(corpus(spark, d), Q.Request()).where("facet = 'decade'").select(F.col("value").alias("decade"), "n").orderBy("decade")


def _page(order: str, limit: int, offset: int = 0) -> str:
    return _with(f"SELECT doc, year, title, CAST(NULL AS DOUBLE) AS score FROM corpus WHERE source_id <> 'src9' ORDER BY {order}, doc LIMIT {limit} OFFSET {offset}")


def _sources_but_9(spark, d):
    return corpus(spark, d).where("source_id <> 'src9'")


@query(_page("year DESC NULLS LAST, title", 20, 20))
def search_page_year_desc(spark, d):
    return Q.search(_sources_but_9(spark, d), Q.Request(sort="year_desc", page=2, size=20))


@query(_page("year ASC NULLS LAST, title", 20))
def search_page_year_asc(spark, d):
    return Q.search(_sources_but_9(spark, d), Q.Request(sort="year_asc"))


@query(_page("lower(title), title", 30))
def search_title_nocase(spark, d):
    return Q.search(_sources_but_9(spark, d), Q.Request(sort="title_asc", size=30))


def _fts(phrases: list[str]) -> str:
    each = lambda p: " + ".join(f"len(list_filter({S.words(c)}, lambda t: starts_with(t, '{p}')))" for c in Q.TEXT_FIELDS)
    length = " + ".join(f"len({S.words(c)})" for c in Q.TEXT_FIELDS)
    return "fts AS (SELECT doc, year, title, " + ", ".join(f"{each(p)} AS tf{i}" for i, p in enumerate(phrases)) + f", {length} AS len FROM corpus)"


def _bm25(n: int) -> str:
    stats = "st AS (SELECT count(*) AS n, avg(len) AS avg_len, " + ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(n)) + " FROM fts)"
    score = " + ".join(f"greatest(ln((n - df{i} + 0.5) / (df{i} + 0.5)), 0.000001) * tf{i} * {Q.K1 + 1} / (tf{i} + {Q.K1} * ({1 - Q.B} + {Q.B} * len / avg_len))" for i in range(n))
    return f"{stats}, bm AS (SELECT doc, year, title, {score} AS score FROM fts, st WHERE {' AND '.join(f'tf{i} > 0' for i in range(n))})"


@query(_with("SELECT count(*) AS n FROM fts JOIN corpus USING (doc) WHERE tf0 > 0 AND tf1 > 0 AND discipline = 'English'", _fts(["erin", "thon"])))
def search_count(spark, d):
    return Q.count(corpus(spark, d), Q.Request(q="erin thon", discipline=("English",)), index=_fulltext(spark, d))


@query(_with("SELECT doc, CAST(tf0 AS INTEGER) AS tf0, CAST(tf1 AS INTEGER) AS tf1, CAST(len AS INTEGER) AS len FROM fts WHERE tf0 > 0 AND tf1 > 0", _fts(["erin", "thon"])))
def fts_prefix_and(spark, d):
    return fulltext.matched(_fulltext(spark, d), "erin thon")


_PHRASE = "fw AS (SELECT doc, unnest([" + ", ".join(S.words(c) for c in Q.TEXT_FIELDS) + "]) AS w FROM corpus), pf AS (SELECT doc, sum(len(list_filter(range(1, len(w)), lambda i: w[i] = 'of' AND starts_with(w[i + 1], 'th')))) AS tf0 FROM fw GROUP BY doc)"


@query(_with("SELECT count(*) AS n, CAST(sum(tf0) AS BIGINT) AS places FROM pf WHERE tf0 > 0", _PHRASE))
def fts_phrase(spark, d):
    """Words joined by a hyphen are a phrase whose last word is a prefix."""
    return fulltext.matched(_fulltext(spark, d), "of-th").agg(F.count("*").alias("n"), F.sum("tf0").alias("places"))


@query(_with("SELECT doc, CAST(tf0 AS INTEGER) AS tf0, CAST(len AS INTEGER) AS len FROM (SELECT * FROM fts WHERE doc % 3 > 0) WHERE tf0 > 0", _fts(["erin"]).replace("FROM corpus", "FROM (SELECT * REPLACE (CASE WHEN doc % 3 = 1 THEN title ELSE abstract END AS abstract) FROM corpus)")))
def fts_incremental(spark, d):
    """The index after a third of the records were deleted and another third replaced by records of their title alone."""
    records = corpus(spark, d)
    changed, gone = records.where("doc % 3 = 1").withColumn("abstract", F.col("title")), records.where("doc % 3 = 0")
    return fulltext.matched(fulltext.updated(_fulltext(spark, d), changed, gone.select("doc")), "erin")


@query(_with("SELECT doc, year, title, round(score, 6) AS score FROM bm ORDER BY round(score, 6) DESC, year DESC NULLS LAST, doc LIMIT 25", _fts(["erin", "thon"]), _bm25(2)))
def bm25_rank_topk(spark, d):
    return Q.search(corpus(spark, d), Q.Request(q="erin thon", size=25), index=_fulltext(spark, d))


@query(_with("SELECT CAST(row_number() OVER (ORDER BY round(score, 6) DESC, bm.year DESC NULLS LAST, doc) AS INTEGER) AS place, c.* FROM bm JOIN corpus c USING (doc) ORDER BY place LIMIT 10", _fts(["erin", "thon"]), _bm25(2)))
def search_result_rows(spark, d):
    return Q.results(corpus(spark, d), Q.Request(q="erin thon", size=10), index=_fulltext(spark, d))


@query(_with("SELECT CAST(doc AS VARCHAR) AS id, nullif(title, '') AS title, nullif(authors, '') AS authors, nullif(advisors, '') AS advisors, nullif(subjects, '') AS subjects, type, language, publisher, discipline, source_id, source_name, nullif(CASE WHEN length(abstract) > 900 THEN substr(abstract, 1, 900) || '…' ELSE abstract END, '') AS abstract, year, url FROM corpus"))
def display_rows(spark, d):
    return search.display(corpus(spark, d))


# ---- text analysis -------------------------------------------------------------------------------------------------------------


@query(f"WITH {CORPUS} SELECT doc, array_to_string({S.tokens('abstract')}, ' ') AS tokens FROM corpus")
def tokenize_fold_stem(spark, d):
    return corpus(spark, d).select("doc", F.array_join(T.tokenize(F.col("abstract")), " ").alias("tokens"))


@query(f"WITH {CORPUS}, {S.FIELDS} SELECT doc, field, term, count(*) AS tf FROM (SELECT doc, field, unnest(tokens) AS term FROM ft) GROUP BY ALL")
def term_frequency(spark, d):
    return index.term_frequencies(corpus(spark, d))


@query(f"WITH {CORPUS}, {S.FIELDS}, {S.MEANS} SELECT field, round(avg_len, 6) AS avg_len FROM av")
def avg_field_length(spark, d):
    return index.average_lengths(corpus(spark, d)).select("field", F.round("avg_len", 6).alias("avg_len"))


@query(f"WITH {S.INDEX} SELECT term, count(DISTINCT doc) AS df FROM sel GROUP BY term")
def document_frequency(spark, d):
    return index.selected_terms(corpus(spark, d)).groupBy("term").agg(F.count("*").alias("df"))


@query(f"WITH {CORPUS}, tt AS (SELECT doc, {S.tokens('title')} AS tk FROM corpus) SELECT doc, term, count(*) AS n FROM (SELECT doc, unnest({S.shingles('tk')}) AS term FROM tt) GROUP BY ALL")
def title_shingles(spark, d):
    return corpus(spark, d).select("doc", F.explode(T.shingles(T.tokenize(F.col("title")))).alias("term")).groupBy("doc", "term").agg(F.count("*").alias("n"))


@query(f"WITH {S.INDEX} SELECT doc, term, score FROM pairs")
def proximity_pairs(spark, d):
    return index.pair_scores(index.field_tokens(corpus(spark, d)))


@query(f"WITH {CORPUS}, tt AS (SELECT DISTINCT unnest({S.tokens('title')}) AS term FROM corpus) SELECT term, rpad(substr(term, 1, 3), 3, '_') AS shard FROM tt")
def shard_keys(spark, d):
    return corpus(spark, d).select(F.explode(T.tokenize(F.col("title"))).alias("term")).distinct().select("term", T.shard_key(F.col("term")).alias("shard"))


# ---- index ---------------------------------------------------------------------------------------------------------------------


@query(f"WITH {S.INDEX} SELECT term, doc, impact, df FROM post")
def bm25f_impacts(spark, d):
    return index.build(corpus(spark, d))


@query(f"WITH {S.INDEX} SELECT doc, term, score FROM sel")
def top_terms_per_doc(spark, d):
    return index.selected_terms(corpus(spark, d))


def _dictionary(name: str) -> str:
    return f"(SELECT coalesce({name}, '') AS value, row_number() OVER (ORDER BY min(doc)) - 1 AS code, count(*) AS n FROM corpus GROUP BY 1)"


@query(_with(" UNION ALL ".join(f"SELECT '{c}' AS facet, value, CAST(code AS INTEGER) AS code, n FROM {_dictionary(c)}" for c in ("source_id", "discipline", "type"))))
def facet_dictionary_codes(spark, d):
    records = corpus(spark, d)
    return search.all_of([index.dictionary(records, c).select(F.lit(c).alias("facet"), "value", "code", "n") for c in ("source_id", "discipline", "type")])


@query(
    f"""WITH {S.INDEX}, sd AS {_dictionary('source_id')},
 pl AS (SELECT term, impact, code, coalesce(year, 0) AS year, (row_number() OVER (PARTITION BY term ORDER BY impact DESC, post.doc) - 1) // 128 AS block FROM post JOIN corpus USING (doc) JOIN sd ON sd.value = corpus.source_id)
SELECT term, CAST(block AS BIGINT) AS block, max(impact) AS max_impact, count(*) AS n, bit_or(CASE WHEN code // 32 = 0 THEN CAST(1 AS BIGINT) << CAST(code % 32 AS BIGINT) ELSE 0 END) AS word0, min(nullif(year, 0)) AS year_min, max(nullif(year, 0)) AS year_max FROM pl GROUP BY term, block"""
)
def postings_blocks(spark, d):
    word = F.coalesce(F.element_at("source_id_words", F.lit(0).cast("long")), F.lit(0).cast("long"))
    return _blocks(spark, d).select("term", "block", "max_impact", "n", word.alias("word0"), "year_min", "year_max")


@query(
    f"""WITH {S.INDEX}, tn AS (SELECT term, count(*) AS n FROM post GROUP BY term),
 ks AS (SELECT term, n, rpad(substr(term, 1, 3), 3, '_') AS k3, rpad(substr(term, 1, 4), 4, '_') AS k4, rpad(substr(term, 1, 5), 5, '_') AS k5 FROM tn),
 ss AS (SELECT *, sum(n) OVER (PARTITION BY k3) AS s3, sum(n) OVER (PARTITION BY k4) AS s4 FROM ks)
SELECT CASE WHEN s3 <= 300 THEN k3 WHEN s4 <= 300 THEN k4 ELSE k5 END AS shard, count(*) AS n_terms, CAST(sum(n) AS BIGINT) AS n_postings FROM ss GROUP BY 1"""
)
def adaptive_shards(spark, d):
    return index.shards(_index(spark, d), 300)


_RANGES = "rg AS (SELECT user_id % 16 AS pack, event_id * 6000 AS start, event_id * 6000 + 3000 + event_id % 9 * 1500 AS stop FROM events)"


@query(
    f"""WITH {_RANGES}, m AS (SELECT *, max(stop) OVER (PARTITION BY pack ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM rg),
 g AS (SELECT *, sum(CASE WHEN reach IS NULL OR start > reach + 8192 THEN 1 ELSE 0 END) OVER (PARTITION BY pack ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS g FROM m)
SELECT pack, min(start) AS start, max(stop) AS stop, count(*) AS n FROM g GROUP BY pack, g"""
)
def range_coalesce(spark, d):
    e, i = table(spark, d, "events"), F.col("event_id")
    return index.coalesced_ranges(e.select((F.col("user_id") % 16).alias("pack"), (i * 6000).alias("start"), (i * 6000 + 3000 + i % 9 * 1500).alias("stop")))


@query(
    f"""WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY writer ORDER BY name) AS n FROM (SELECT p_partkey % 4 AS writer, 's' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS name, CAST(p_size AS BIGINT) * 40000 + 1 AS size FROM part)),
 l(writer, name, n, pack, "offset", used) AS (SELECT writer, name, n, 0, CAST(0 AS BIGINT), size FROM o WHERE n = 1
  UNION ALL SELECT o.writer, o.name, o.n, CASE WHEN used + size > {index.PACK_BYTES} THEN pack + 1 ELSE pack END, CASE WHEN used + size > {index.PACK_BYTES} THEN 0 ELSE used END, CASE WHEN used + size > {index.PACK_BYTES} THEN size ELSE used + size END FROM l JOIN o ON o.writer = l.writer AND o.n = l.n + 1)
SELECT writer, name, pack, "offset" FROM l"""
)
def pack_layout(spark, d):
    p = table(spark, d, "part").select((F.col("p_partkey") % 4).alias("writer"), F.concat(F.lit("s"), F.lpad(F.col("p_partkey").cast("string"), 8, "0")).alias("name"), (F.col("p_size") * 40_000 + 1).alias("size"))
    return index.packed(p, "writer")


@query(
    "WITH k AS (SELECT DISTINCT p_name AS key, substr(p_name, 1, 1) AS shard FROM part), b AS (SELECT *, coalesce(lag(key) OVER (PARTITION BY shard ORDER BY key), '') AS before FROM k) "
    "SELECT key, shard, CAST(list_max(list_filter(range(0, least(length(key), length(before)) + 1), lambda i: substr(key, 1, i) = substr(before, 1, i))) AS INTEGER) AS shared FROM b"
)
def front_coding(spark, d):
    p = table(spark, d, "part").select(F.col("p_name").alias("key"), F.substring("p_name", 1, 1).alias("shard")).distinct()
    return index.front_coded(p)


def _index(spark, d) -> DataFrame:
    """The index as searches find it: built once, stored in order of terms and blocks, read by every query."""
    return held(spark, d, "index", lambda: index.placed(index.build(corpus(spark, d), coded=True)))


def _blocks(spark, d) -> DataFrame:
    return stored(spark, d, "blocks", lambda: index.ordered_summaries(_index(spark, d)))


def _fulltext(spark, d) -> fulltext.Index:
    made = lambda: fulltext.build(corpus(spark, d))
    return fulltext.Index(stored(spark, d, "words", lambda: fulltext.in_order(made().postings)), stored(spark, d, "lengths", lambda: made().lengths))


@query(
    f"WITH {S.INDEX}, fc AS (SELECT 'source_id' AS name, * FROM {_dictionary('source_id')} UNION ALL SELECT 'discipline', * FROM {_dictionary('discipline')} UNION ALL SELECT 'type', * FROM {_dictionary('type')}) "
    "SELECT 'total' AS name, CAST(count(*) AS VARCHAR) AS value FROM corpus UNION ALL SELECT 'terms', CAST(count(DISTINCT term) AS VARCHAR) FROM post UNION ALL SELECT 'postings', CAST(count(*) AS VARCHAR) FROM post "
    """UNION ALL SELECT name, '[' || string_agg('{"code":' || code || ',"value":' || CAST(to_json(value) AS VARCHAR) || ',"n":' || n || '}', ',' ORDER BY code) || ']' FROM fc GROUP BY name"""
)
def index_manifest(spark, d):
    return index.manifest(corpus(spark, d), _index(spark, d))


@query(_with("""SELECT doc // 100 AS chunk, count(*) AS n, '[' || string_agg('{"doc":' || doc || ',"title":' || CAST(to_json(title) AS VARCHAR) || ',"source_id":' || CAST(to_json(source_id) AS VARCHAR) || '}', ',' ORDER BY doc) || ']' AS value FROM corpus GROUP BY 1"""))
def document_chunks(spark, d):
    return index.document_chunks(corpus(spark, d), ["title", "source_id"])


_VARINT = "list_transform(range(0, greatest(1, CAST(ceil(length(regexp_replace(bin(n), '^0+', '')) / 7.0) AS BIGINT))), lambda i: CAST((n >> (7 * i)) & 127 AS INTEGER) + CASE WHEN i < greatest(1, CAST(ceil(length(regexp_replace(bin(n), '^0+', '')) / 7.0) AS BIGINT)) - 1 THEN 128 ELSE 0 END)"


@query(f"WITH x AS (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) * (o_orderkey % 5) AS n FROM orders) SELECT o_orderkey, array_to_string({_VARINT}, ' ') AS bytes, n AS again, CASE WHEN n <= 255 THEN 1 WHEN n <= 65535 THEN 2 ELSE 4 END AS width FROM x")
def varint_codes(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", (F.floor("o_totalprice") * (F.col("o_orderkey") % 5)).alias("n"))
    coded = o.select("o_orderkey", "n", index.varint(F.col("n")).alias("b"))
    return coded.select("o_orderkey", F.array_join("b", " ").alias("bytes"), index.from_varint(F.col("b")).alias("again"), index.fixed_width(F.col("n")).alias("width"))


# ---- ranked search -------------------------------------------------------------------------------------------------------------

_SCORED = "sr AS (SELECT doc, sum(impact) AS score, count(*) FILTER (bit >= 0) AS hits FROM post JOIN qt USING (term) {where} GROUP BY doc HAVING count(*) FILTER (bit >= 0) >= {least})"


def _scored(terms: list[str], where: str = "") -> str:
    return f"WITH {S.INDEX}, {S.query_terms(terms)}, " + _SCORED.format(where=where, least=search.min_match(len(terms)))


@query(_scored(PAIR) + " SELECT doc, CAST(score AS BIGINT) AS score, hits FROM sr ORDER BY score DESC, doc LIMIT 50")
def topk_min_should_match(spark, d):
    return search.scored(_index(spark, d), PAIR).orderBy(F.desc("score"), "doc").limit(50)


@query(_scored(PAIR, "WHERE doc IN (SELECT doc FROM corpus WHERE discipline = 'English' AND year >= 1970)") + " SELECT doc, CAST(score AS DOUBLE) AS score, CAST(row_number() OVER (ORDER BY score DESC, doc) AS INTEGER) AS place FROM sr ORDER BY place LIMIT 20")
def topk_filtered(spark, d):
    records = corpus(spark, d)
    return search.search(_index(spark, d), records, Q.Request(q=" ".join(PAIR), discipline=("English",), year_min=1970), rerank=False)


@query(
    _scored(TERMS)
    + f""", {S.values('dt', list(T.dependency_terms(TERMS).items()), 'term, w')}, fp AS (SELECT doc, score, row_number() OVER (ORDER BY score DESC, doc) AS pl FROM sr ORDER BY pl LIMIT 30),
 ex AS (SELECT doc, sum(impact * w) AS extra FROM post JOIN dt USING (term) WHERE doc IN (SELECT doc FROM fp) GROUP BY doc),
 rr AS (SELECT doc, round(score + coalesce(extra, 0), 6) AS score, pl FROM fp LEFT JOIN ex USING (doc))
SELECT doc, score, CAST(row_number() OVER (ORDER BY score DESC, pl) AS INTEGER) AS place FROM rr"""
)
def topk_reranked(spark, d):
    made = _index(spark, d)
    return search.reranked(made, search.scored(made, TERMS).select("doc", F.col("score").cast("double").alias("score")), TERMS, 30)


@query(_scored(PAIR) + " SELECT doc, CAST(score AS BIGINT) AS score, hits FROM sr ORDER BY score DESC, doc LIMIT 10")
def block_pruned_topk(spark, d):
    return search.pruned(_index(spark, d), _blocks(spark, d), PAIR, 10)


@query(_scored(PAIR, "WHERE doc IN (SELECT doc FROM corpus WHERE source_id IN ('src1', 'src4', 'src7') AND year BETWEEN 1970 AND 2010)") + " SELECT doc, CAST(score AS BIGINT) AS score, hits FROM sr ORDER BY score DESC, doc LIMIT 10")
def filtered_blocks_topk(spark, d):
    """Filters in the space of codes: blocks by their masks and years, postings by their codes."""
    records = corpus(spark, d)
    facets = {c: index.dictionary(records, c) for c in index.MASKED}
    r = Q.Request(q=" ".join(PAIR), source=("src1", "src4", "src7"), year_min=1970, year_max=2010, size=10)
    return search.pruned(_index(spark, d), _blocks(spark, d), PAIR, 10, search.filter_plan(r, facets)) if search.fast_path(r, PAIR) else search.scored(_index(spark, d), PAIR)


@query(_with("SELECT doc, CAST(row_number() OVER (ORDER BY doc) AS INTEGER) AS place FROM corpus ORDER BY doc LIMIT 50"))
def initial_page(spark, d):
    return stored(spark, d, "initial", lambda: search.initial_page(corpus(spark, d)))


def _by_year(order: str) -> str:
    return _scored(PAIR) + f", y AS (SELECT doc, CAST(score AS DOUBLE) AS score, coalesce(year, 0) AS year FROM sr JOIN corpus USING (doc)) SELECT doc, score, CAST(row_number() OVER (ORDER BY {order}) AS INTEGER) AS place FROM y ORDER BY place LIMIT 20"


@query(_by_year("year DESC, score DESC, doc"))
def topk_year_desc(spark, d):
    return search.search(_index(spark, d), corpus(spark, d), Q.Request(q=" ".join(PAIR), sort="year_desc"))


@query(_by_year("CASE WHEN year = 0 THEN 9999 ELSE year END, score DESC, doc"))
def topk_year_asc(spark, d):
    return search.search(_index(spark, d), corpus(spark, d), Q.Request(q=" ".join(PAIR), sort="year_asc"))


@query(_scored(PAIR) + " SELECT 'source' AS facet, source_id AS value, count(*) AS n FROM sr JOIN corpus USING (doc) GROUP BY ALL UNION ALL SELECT 'discipline', coalesce(discipline, ''), count(*) FROM sr JOIN corpus USING (doc) GROUP BY ALL UNION ALL SELECT 'type', coalesce(type, ''), count(*) FROM sr JOIN corpus USING (doc) GROUP BY ALL UNION ALL SELECT 'decade', coalesce((year // 10 * 10) || 's', ''), count(*) FROM sr JOIN corpus USING (doc) GROUP BY ALL")
def result_facets(spark, d):
    records = corpus(spark, d)
    return search.facet_counts(search.scored(_index(spark, d), PAIR), records)


@query(_scored(PAIR) + ", lp AS (SELECT doc, CAST(score AS BIGINT) AS score, CAST(row_number() OVER (ORDER BY score DESC, doc) AS INTEGER) AS place FROM sr ORDER BY place LIMIT 15) SELECT lp.*, title, source_name, year, url FROM lp JOIN corpus USING (doc) ORDER BY place")
def loaded_rows(spark, d):
    """Whole rows of a page: ranking first, rows last."""
    page = search.scored(_index(spark, d), PAIR).orderBy(F.desc("score"), "doc").limit(15).select("doc", "score")
    placed = page.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "doc")))  # one page
    return search.loaded(placed, corpus(spark, d)).select("doc", "score", "place", "title", "source_name", "year", "url")


# ---- spelling ------------------------------------------------------------------------------------------------------------------


@query(
    f"""WITH {CORPUS}, t AS (SELECT DISTINCT unnest({S.tokens('title')}) AS term FROM corpus),
 a AS (SELECT term, list_filter(list_transform(range(1, length(term) + 1), lambda i: substr(term, 1, i - 1) || substr(term, i + 1)), lambda k: length(k) >= 3) AS one FROM t),
 b AS (SELECT term, list_distinct(list_concat([term], one, CASE WHEN length(term) >= 8 THEN list_filter(flatten(list_transform(one, lambda x: list_transform(range(1, length(x) + 1), lambda i: substr(x, 1, i - 1) || substr(x, i + 1)))), lambda k: length(k) >= 3) ELSE [] END)) AS ks FROM a)
SELECT term, unnest(ks) AS delete_key FROM b"""
)
def typo_delete_keys(spark, d):
    terms = corpus(spark, d).select(F.explode(T.tokenize(F.col("title"))).alias("term")).distinct()
    return terms.select("term", F.explode(T.delete_keys(F.col("term"))).alias("delete_key"))


def _mistyped(spark, d):
    words = typo.surfaces(corpus(spark, d))
    return words, words.where(F.length("surface") >= 6).select(typo.mutated(F.col("surface"), F.length("surface") * 3 + 17).alias("token")).distinct()


@query(_with(f"SELECT term, CAST(df AS BIGINT) AS df FROM (SELECT term, count(*) AS df FROM (SELECT DISTINCT doc, term FROM (SELECT doc, unnest({S.tokens('title')}) AS term FROM corpus)) GROUP BY term) WHERE length(term) BETWEEN 5 AND 20 AND regexp_full_match(term, '[a-z][a-z0-9]*') AND df <= greatest(1, (SELECT floor(count(*) * 0.08) FROM corpus))"))
def typo_index_terms(spark, d):
    records = corpus(spark, d)
    terms = records.select(F.explode(F.array_distinct(T.tokenize(F.col("title")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return typo.eligible(terms, records.agg(F.count("*").alias("n")))


_DELETES = lambda t: f"list_distinct(list_concat([{t}], {_ONE(t)}, CASE WHEN length({t}) >= 8 THEN list_filter(flatten(list_transform({_ONE(t)}, lambda x: list_transform(range(1, length(x) + 1), lambda i: substr(x, 1, i - 1) || substr(x, i + 1)))), lambda k: length(k) >= 3) ELSE [] END))"
_ONE = lambda t: f"list_filter(list_transform(range(1, length({t}) + 1), lambda i: substr({t}, 1, i - 1) || substr({t}, i + 1)), lambda k: length(k) >= 3)"
_SURFACES = (
    "sp AS (SELECT DISTINCT doc, w AS surface, " + S.stem("w") + " AS term FROM (SELECT doc, unnest(list_concat(" + ", ".join(S.raw_words(c) for c in typo.FIELDS) + ")) AS w FROM corpus)), "
    f"sf AS (SELECT surface, term, count(*) AS df FROM sp WHERE {S.wanted('term')} AND length(surface) BETWEEN 4 AND 24 AND length(term) BETWEEN 2 AND 20 AND regexp_full_match(surface, '[a-z][a-z0-9]*') AND regexp_full_match(term, '[a-z][a-z0-9]*') GROUP BY ALL HAVING count(*) <= greatest(1, (SELECT floor(count(*) * {typo.DF_RATIO}) FROM corpus)))"
)


def _osa(a: str, b: str) -> str:
    """Edit distance with exchanges of neighbours, row by row: s holds the last two rows."""
    swap = f"CASE WHEN x[1][1] > 1 AND y[1] > 1 AND substr({a}, x[1][1], 1) = substr({b}, y[1] - 1, 1) AND substr({a}, x[1][1] - 1, 1) = substr({b}, y[1], 1) THEN s[1][y[1] - 1] + 1 ELSE 999 END"
    cell = f"least(s[2][y[1] + 1] + 1, r[-1] + 1, s[2][y[1]] + CASE WHEN substr({a}, x[1][1], 1) = substr({b}, y[1], 1) THEN 0 ELSE 1 END, {swap})"
    row = f"list_reduce(list_transform(range(1, length({b}) + 1), lambda j: [j]), lambda r, y: list_append(r, {cell}), [x[1][1]])"
    return f"list_reduce(list_transform(range(1, length({a}) + 1), lambda i: [[i]]), lambda s, x: [s[2], {row}], [range(0, 1), range(0, length({b}) + 1)])[2][length({b}) + 1]"


def _lcs(a: str, b: str) -> str:
    cell = f"CASE WHEN substr({a}, x[1], 1) = substr({b}, y[1], 1) THEN s[y[1]] + 1 ELSE greatest(s[y[1] + 1], r[-1]) END"
    row = f"list_reduce(list_transform(range(1, length({b}) + 1), lambda j: [j]), lambda r, y: list_append(r, {cell}), [CAST(0 AS BIGINT)])"
    return f"list_reduce(list_transform(range(1, length({a}) + 1), lambda i: [i]), lambda s, x: {row}, list_transform(range(0, length({b}) + 1), lambda z: CAST(0 AS BIGINT)))[-1]"


_TYPO_INDEX = f"ix AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY df DESC, length(surface), length(term), surface, term) AS rn FROM (SELECT surface, term, df, unnest({_DELETES('surface')}) AS k FROM sf)) WHERE rn <= {typo.MOST_PER_KEY})"
_REACH = f"mt AS (SELECT token, surface, term, max(df) AS df FROM tk JOIN ix USING (k) WHERE surface <> token GROUP BY ALL), nr AS (SELECT * FROM (SELECT *, CAST({_osa('token', 'surface')} AS INTEGER) AS dist FROM mt) WHERE dist BETWEEN 1 AND CASE WHEN length(token) >= 8 THEN 2 ELSE 1 END)"


@query(_with("SELECT token, surface, term, dist AS distance FROM nr", _SURFACES, _TYPO_INDEX, f"tk AS (SELECT token, unnest({_DELETES('token')}) AS k FROM (SELECT DISTINCT substr(surface, 1, 3) || substr(surface, 5) AS token FROM sf WHERE length(surface) >= 6))", _REACH))
def typo_reach(spark, d):
    """Words within reach of tokens that lack their fourth letter, with their distance."""
    words = typo.surfaces(corpus(spark, d))
    tokens = words.where(F.length("surface") >= 6).select(F.concat(F.substring("surface", 1, 3), F.substring("surface", 5, 99)).alias("token")).distinct()
    return typo.reach(tokens, typo.delete_index(words)).select("token", "surface", "term", "distance")


def _mutated(t: str, s: str) -> str:
    n, letters = f"length({t})", "etaoinshrdlucmpgfbvyq"
    inner = f"(CASE WHEN {n} > 6 THEN 1 ELSE 0 END)"
    at = f"({inner} + {s} % greatest(1, {n} - 2 * {inner}))"
    here = f"substr({t}, {at} + 1, 1)"
    other = f"substr('{letters}', (position({here} IN '{letters}') - 1 + {s} + 7) % {len(letters)} + 1, 1)"
    return f"CASE WHEN {n} < 5 THEN {t} WHEN {s} % 4 = 0 THEN substr({t}, 1, {at}) || substr({t}, {at} + 2) WHEN {s} % 4 = 1 AND {at} < {n} - 1 THEN substr({t}, 1, {at}) || substr({t}, {at} + 2, 1) || {here} || substr({t}, {at} + 3) WHEN {s} % 4 = 2 THEN substr({t}, 1, {at}) || {other} || substr({t}, {at} + 2) ELSE substr({t}, 1, {at}) || {here} || substr({t}, {at} + 1) END"


_RATED = f"""rt AS (SELECT *, round(ln(1 + df) * 1.15 + least(list_max(list_filter(range(0, least(length(token), length(surface)) + 1), lambda i: substr(token, 1, i) = substr(surface, 1, i))), 4) * 0.15 + {_lcs('token', 'surface')} / CAST(greatest(1, length(token)) AS DOUBLE) * 4.0
 + CASE WHEN substr(token, 1, 1) = substr(surface, 1, 1) THEN 1.2 ELSE -1.6 END + CASE WHEN substr(token, -1) = substr(surface, -1) THEN 0.35 ELSE 0.0 END - dist * 2.35 - abs(length(token) - length(surface)) * 0.25, 9) AS score FROM nr)"""


@query(
    _with(
        f"SELECT token, surface, term, CAST(df AS BIGINT) AS df, dist AS distance, CAST(round(score, 6) AS DOUBLE) AS score FROM (SELECT *, row_number() OVER (PARTITION BY token ORDER BY score DESC, dist, df DESC, term, surface) AS place FROM rt) WHERE place <= {typo.MOST_PER_TOKEN}",
        _SURFACES, _TYPO_INDEX, f"tk AS (SELECT token, unnest({_DELETES('token')}) AS k FROM (SELECT DISTINCT {_mutated('surface', '(length(surface) * 3 + 17)')} AS token FROM sf WHERE length(surface) >= 6))", _REACH, _RATED,
    )
)
def typo_candidates(spark, d):
    words, tokens = _mistyped(spark, d)
    return typo.candidates(tokens, typo.delete_index(words)).select("token", "surface", "term", "df", "distance", F.round("score", 6).alias("score"))


_TYPED = "thaneedble erni"
_BASE = T.analyze_query(_TYPED)  # two words


@query(
    f"""WITH {S.INDEX}, {_SURFACES}, {_TYPO_INDEX}, {S.values('bt', [(i, raw, term) for i, (raw, term) in enumerate(_BASE)], 'i, raw, base')},
 ms AS (SELECT count(*) AS m FROM bt WHERE base NOT IN (SELECT term FROM post)),
 ak AS (SELECT bt.* FROM bt, ms WHERE NOT (base IN (SELECT term FROM post) AND m > 0)),
 tk AS (SELECT token, unnest({_DELETES('token')}) AS k FROM (SELECT DISTINCT raw AS token FROM ak)), {_REACH}, {_RATED},
 cd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY token ORDER BY score DESC, dist, df DESC, term, surface) AS pl FROM rt WHERE score >= {typo.LEAST_SCORE}) WHERE pl <= {typo.PLANS_PER_TOKEN}),
 pt AS (SELECT score, CASE WHEN i = 0 THEN term ELSE '{_BASE[0][1]}' END AS t0, CASE WHEN i = 1 THEN term ELSE '{_BASE[1][1]}' END AS t1 FROM ak JOIN cd ON cd.token = ak.raw WHERE term <> base),
 pn AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY score DESC, t0 || ' ' || t1) AS n FROM pt) WHERE n <= {typo.MOST_PLANS}),
 tl AS (SELECT n, count(*) AS total FROM (SELECT n, doc FROM pn JOIN post ON post.term IN (t0, t1) GROUP BY n, doc HAVING count(*) = 2) GROUP BY n),
 bf AS (SELECT count(*) AS c FROM (SELECT doc FROM post WHERE term IN ('{_BASE[0][1]}', '{_BASE[1][1]}') GROUP BY doc HAVING count(*) = 2))
SELECT '{_TYPED}' AS q, (SELECT t0 || ' ' || t1 FROM pn JOIN tl USING (n), bf WHERE c = 0 AND score + 0.05 * least(total, 20) > 0 ORDER BY score + 0.05 * least(total, 20) DESC, n LIMIT 1) AS corrected"""
)
def typo_correct_query(spark, d):
    records = corpus(spark, d)
    found = typo.corrected(_index(spark, d), typo.delete_index(typo.surfaces(records)), _TYPED)
    return spark.createDataFrame([(_TYPED, " ".join(found[0]) if found else None)], "q string, corrected string")


@query(
    f"""WITH {CORPUS}, vo AS (SELECT word, row_number() OVER (ORDER BY word) AS place FROM (SELECT DISTINCT {S.fold('p_brand')} AS word FROM part)),
 tk AS (SELECT DISTINCT overlay AS token FROM (SELECT substr({S.fold('p_brand')}, 1, 3) || 'x' || substr({S.fold('p_brand')}, 5) AS overlay FROM part) WHERE length(overlay) >= 4),
 pr AS (SELECT token, word, place, levenshtein(token, word) AS dist FROM tk, vo WHERE abs(length(token) - length(word)) <= greatest(1, length(token) // 4)),
 bs AS (SELECT token, arg_min(word, dist * 1000000 + place) AS suggestion FROM pr WHERE dist <= greatest(1, length(token) // 4) GROUP BY token) SELECT token, suggestion FROM bs WHERE suggestion <> token"""
)
def did_you_mean(spark, d):
    brands = table(spark, d, "part").select(T.fold(F.col("p_brand")).alias("word")).distinct()
    vocabulary = brands.withColumn("place", F.row_number().over(Window.orderBy("word")))  # facet labels
    tokens = brands.select(F.concat(F.substring("word", 1, 3), F.lit("x"), F.substring("word", 5, 99)).alias("token")).distinct()
    return typo.did_you_mean(tokens, vocabulary)


@query(f"WITH {CORPUS}, t AS (SELECT DISTINCT unnest({S.tokens('title')}) AS term, CAST(doc % 101 AS INTEGER) AS seed FROM corpus) SELECT term, seed, {_mutated('term', 'seed')} AS mutated FROM t")
def typo_mutations(spark, d):
    t = corpus(spark, d).select(F.explode(T.tokenize(F.col("title"))).alias("term"), (F.col("doc") % 101).cast("int").alias("seed")).distinct()
    return t.select("term", "seed", typo.mutated(F.col("term"), F.col("seed")).alias("mutated"))


# ---- expansion -----------------------------------------------------------------------------------------------------------------

_TEXTS = {"title": "title", "subjects": "subjects", "discipline": "discipline", "abstract": "substr(abstract, 1, 1800)"}
_KEY_FIELDS = [(f, w, expand.USUAL.keys if f == "abstract" else None) for f, w in expand.KEY_FIELDS.items()]
_DF = "ot AS (SELECT doc, unnest(list_distinct(list_concat(" + ", ".join(S.tokens(c) for c in _TEXTS.values()) + "))) AS term FROM corpus), df AS (SELECT term, count(*) AS df FROM ot GROUP BY term), n AS (SELECT count(*) AS n FROM corpus)"
_KEYS = (
    _DF
    + ", ff AS ("
    + " UNION ALL ".join(f"SELECT doc, '{f}' AS field, {w} AS w, unnest({S.tokens(_TEXTS[f])}{f'[1:{m}]' if m else ''}) AS term FROM corpus" for f, w, m in _KEY_FIELDS)
    + """), tf AS (SELECT doc, field, w, term, count(*) AS tf FROM ff GROUP BY ALL),
 sk AS (SELECT doc, term, df, round(sum(w * (1 + ln(tf)) * ln(1 + (n + 0.5) / (df + 0.5))), 9) AS score FROM tf JOIN df USING (term), n WHERE NOT regexp_full_match(term, '[0-9]+') AND df >= 2 AND df <= n * 0.35 GROUP BY doc, term, df),
 rk AS (SELECT doc, term, score, row_number() OVER (PARTITION BY doc ORDER BY score DESC, term) AS rn FROM sk, n WHERE df >= 3 AND df <= n * 0.12), keys AS (SELECT doc, term, score FROM rk WHERE rn <= 10)"""
)


@query(_with("SELECT doc, term, round(score, 6) AS score FROM keys", _KEYS))
def sparse_key_terms(spark, d):
    return expand.key_terms(corpus(spark, d)).withColumn("score", F.round("score", 6))


_LINKS = """aw AS (SELECT a.term, b.term AS neighbor, sum(sqrt(a.score * b.score)) AS w FROM keys a JOIN keys b USING (doc) WHERE a.term <> b.term GROUP BY ALL),
 an AS (SELECT aw.term, neighbor, round(w / sqrt(x.df * y.df), 9) AS score FROM aw JOIN df x ON x.term = aw.term JOIN df y ON y.term = neighbor),
 links AS (SELECT term, neighbor, score FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY score DESC, neighbor) AS rn FROM an) WHERE rn <= 8)"""


@query(_with("SELECT term, neighbor, round(score, 6) AS score FROM links", _KEYS, _LINKS))
def term_associations(spark, d):
    records = corpus(spark, d)
    return expand.associations(records).withColumn("score", F.round("score", 6))


def _phrases(column: str, weight: float, most: int, source: str) -> str:
    return f"""SELECT doc, term, weight, '{source}' AS source FROM (
 SELECT doc, unnest([t || '_' || t1, t || '_' || t1 || '_' || t2]) AS term, unnest([{weight} * (idf + i1) / 2, {weight} * 1.12 * (idf + i1 + i2) / 3]) AS weight FROM (
  SELECT doc, t, idf, lead(t, 1) OVER w AS t1, lead(t, 2) OVER w AS t2, lead(idf, 1) OVER w AS i1, lead(idf, 2) OVER w AS i2 FROM (
   SELECT doc, ps, t, idf FROM (SELECT doc, unnest({S.tokens(column)}[1:{most}]) AS t, generate_subscripts({S.tokens(column)}[1:{most}], 1) AS ps FROM corpus) JOIN band ON band.term = t) WINDOW w AS (PARTITION BY doc ORDER BY ps))) WHERE term IS NOT NULL"""


def _unigrams(column: str, weight: float, source: str) -> str:
    return f"SELECT doc, u.term, {weight} * idf AS weight, '{source}' AS source FROM (SELECT doc, unnest(list_distinct({S.tokens(column)}[1:60])) AS term FROM corpus) u JOIN band ON band.term = u.term"


_W = expand.WEIGHTS
_EXPANSIONS = f"""band AS (SELECT term, ln(1 + (n + 0.5) / (df + 0.5)) AS idf FROM df, n WHERE NOT regexp_full_match(term, '[0-9]+') AND df >= 2 AND df <= n * 0.35),
 ka AS (SELECT doc, term, score AS anchor FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY score DESC, term) AS rn FROM keys) WHERE rn <= 6),
 al AS (SELECT doc, neighbor AS term, {_W['association']} * least(1.6, greatest(0.18, score * sqrt(anchor))) AS weight, 'association' AS source FROM ka JOIN links USING (term)),
 ev AS ({_phrases('subjects', _W['subject_phrase'], 48, 'subject_phrase')} UNION ALL {_phrases('discipline', _W['discipline_phrase'], 12, 'discipline_phrase')} UNION ALL {_phrases(_TEXTS['abstract'], _W['abstract_phrase'], 64, 'abstract_phrase')}
   UNION ALL {_unigrams('subjects', _W['subject_term'], 'subject_term')} UNION ALL {_unigrams('discipline', _W['discipline_term'], 'discipline_term')}
   UNION ALL SELECT * FROM al WHERE NOT EXISTS (SELECT 1 FROM ot WHERE ot.doc = al.doc AND ot.term = al.term)),
 eo AS (SELECT doc, term, round(weight, 9) AS weight, source, row_number() OVER (PARTITION BY doc, term ORDER BY round(weight, 9) DESC, source) AS rn FROM ev),
 ep AS (SELECT doc, term, weight, source, row_number() OVER (PARTITION BY doc ORDER BY weight DESC, term) AS place FROM eo WHERE rn = 1)"""


@query(_with("SELECT doc, term, round(weight, 4) AS weight, source FROM ep WHERE place <= 24", _KEYS, _LINKS, _EXPANSIONS))
def sparse_expansions(spark, d):
    return expand.expansions(corpus(spark, d))


@query(_with("""SELECT doc, '{"doc":' || doc || ',"terms":[' || string_agg('{"term":' || CAST(to_json(term) AS VARCHAR) || ',"source":"' || source || '"}', ',' ORDER BY weight DESC, term) || ']}' AS value FROM (SELECT doc, term, round(weight, 4) AS weight, source, place FROM ep WHERE place <= 24) GROUP BY doc""", _KEYS, _LINKS, _EXPANSIONS))
def expansion_lines(spark, d):
    """The expansions as JSON lines, their weights left out: two engines may write the same number in two ways."""
    lines = expand.expansion_lines(expand.expansions(corpus(spark, d)))
    parsed = F.from_json("value", "doc bigint, terms array<struct<term:string,source:string>>")
    return lines.select(parsed.alias("p")).select("p.doc", F.to_json("p").alias("value"))


@query("SELECT count(*) FILTER (o_orderkey % 7 <> 0) AS records, count(*) FILTER (o_orderkey % 7 = 0) AS malformed_lines, count(*) FILTER (o_orderkey % 7 <> 0 AND o_orderkey % 5 = 0) AS missing_docs FROM orders")
def expansion_line_statistics(spark, d):
    o, key = table(spark, d, "orders"), F.col("o_orderkey")
    name = F.when(key % 5 == 0, F.concat(F.lit("no-"), key.cast("string"))).otherwise(key.cast("string"))
    line = F.when(key % 7 == 0, F.lit("{broken")).otherwise(F.to_json(F.struct(name.alias("id"), F.array(F.lit("t")).alias("terms"))))
    return expand.line_statistics(o.select(line.alias("value")), o.select(key.cast("string").alias("name"), key.alias("doc")))


def _whole(sql: str) -> str:
    """SQL without its cuts to the first characters of abstracts and the first tokens of fields."""
    return re.sub(r"\[1:\d+\]", "", re.sub(r"substr\(abstract, 1, \d+\)", "abstract", sql))


@query(_whole(f"WITH {S.INDEX}, {_KEYS}, {_LINKS}, {_EXPANSIONS} SELECT doc, term, CAST(max(score) AS DOUBLE) AS score FROM (SELECT doc, term, score FROM sel UNION ALL SELECT doc, term, round(weight, 4) FROM ep WHERE place <= 24) GROUP BY ALL"))
def terms_with_expansions(spark, d):
    """Of whole texts."""
    return expand.index_terms(corpus(spark, d))


@query(
    """WITH r AS (SELECT o_orderkey AS doc, o_orderpriority AS raw, o_orderkey % 4 AS shape FROM orders WHERE o_orderkey % 7 <> 0)
SELECT doc, CASE WHEN raw LIKE '%NOT SPECIFIED%' THEN '4_specif' ELSE regexp_replace(lower(raw), '[^a-z0-9]+', '_', 'g') END AS term, CASE WHEN shape = 1 THEN 2.5 WHEN shape = 2 THEN 3.0 ELSE 1.0 END AS score FROM (SELECT doc, replace(raw, '-', ' ') AS raw, shape FROM r)"""
)
def expansion_jsonl_merge(spark, d):
    o = table(spark, d, "orders")
    key, raw = F.col("o_orderkey"), F.col("o_orderpriority")
    shape = key % 4
    line = (
        F.when(key % 7 == 0, F.lit("{broken"))
        .when(shape == 0, F.to_json(F.struct(key.alias("doc"), F.array(raw).alias("terms"))))
        .when(shape == 1, F.to_json(F.struct(key.cast("string").alias("id"), F.array(F.struct(raw.alias("token"), F.lit(2.5).alias("score"))).alias("expansions"))))
        .when(shape == 2, F.to_json(F.struct(key.alias("index"), F.create_map(raw, F.lit(3.0)).alias("sparse_terms"))))
        .otherwise(F.to_json(F.struct(key.alias("doc_index"), F.array(F.struct(raw.alias("query"))).alias("tokens"))))
    )
    return expand.read_lines(o.select(line.alias("value")), o.select(key.cast("string").alias("name"), key.alias("doc")))


# ---- evaluation ----------------------------------------------------------------------------------------------------------------

_RANKINGS = """ra AS (SELECT doc % 25 AS query, doc, CAST(row_number() OVER (PARTITION BY doc % 25 ORDER BY length(abstract) DESC, doc) AS INTEGER) AS place FROM corpus),
 rb AS (SELECT doc % 25 AS query, doc, CAST(row_number() OVER (PARTITION BY doc % 25 ORDER BY (length(abstract) + doc % 60) DESC, doc) AS INTEGER) AS place FROM corpus)"""


def _rankings(spark, d):
    r = corpus(spark, d).select((F.col("doc") % 25).alias("query"), "doc", F.length("abstract").alias("l"))
    by = lambda c: F.row_number().over(Window.partitionBy("query").orderBy(F.desc(c), "doc")).alias("place")
    return r.select("query", "doc", by(F.col("l"))), r.select("query", "doc", by(F.col("l") + F.col("doc") % 60))


@query(_with("SELECT count(*) AS n, round(avg(CAST(r BETWEEN 1 AND 1 AS INTEGER)), 6) AS hit1, round(avg(CAST(r BETWEEN 1 AND 3 AS INTEGER)), 6) AS hit3, round(avg(CAST(r BETWEEN 1 AND 10 AS INTEGER)), 6) AS hit10, round(avg(CASE WHEN r BETWEEN 1 AND 10 THEN 1.0 / r ELSE 0 END), 6) AS mrr10 FROM (SELECT t.query, coalesce(min(rb.place), 0) AS r FROM (SELECT query, doc FROM ra WHERE place = 2) t LEFT JOIN rb ON rb.query = t.query AND rb.doc = t.doc AND rb.place <= 12 GROUP BY t.query)", _RANKINGS))
def eval_hits_mrr(spark, d):
    a, b = _rankings(spark, d)
    return evaluate.hit_metrics(evaluate.ranks(b.where("place <= 12"), a.where("place = 2").select("query", "doc")))


@query(_with("SELECT ref.query, round(count(o.place) / CAST(max(d) AS DOUBLE), 6) AS overlap, round(sum(coalesce((d - ref.place + 1) / CAST(d AS DOUBLE) / log2(o.place + 1), 0)) / sum((d - ref.place + 1) / CAST(d AS DOUBLE) / log2(ref.place + 1)), 6) AS ndcg, CAST(coalesce(max(CASE WHEN ref.place = 1 THEN o.place END), 0) AS INTEGER) AS top1_rank FROM (SELECT *, max(place) OVER (PARTITION BY query) AS d FROM ra WHERE place <= 10) ref LEFT JOIN (SELECT * FROM rb WHERE place <= 10) o ON o.query = ref.query AND o.doc = ref.doc GROUP BY ref.query", _RANKINGS))
def eval_overlap_ndcg(spark, d):
    a, b = _rankings(spark, d)
    return evaluate.agreement(b, a)


@query(_with("SELECT count(*) AS n, round(avg(CAST(f[1] = e[1] AS INTEGER)), 6) AS top1_match, round(avg(CAST(f = e AS INTEGER)), 6) AS top10_match, round(avg(len(list_intersect(f, e)) / CAST(len(e) AS DOUBLE)), 6) AS overlap10 FROM (SELECT query, list(doc ORDER BY place) AS e FROM ra WHERE place <= 10 GROUP BY query) JOIN (SELECT query, list(doc ORDER BY place) AS f FROM rb WHERE place <= 10 GROUP BY query) USING (query)", _RANKINGS))
def fast_exact_agreement(spark, d):
    a, b = _rankings(spark, d)
    return evaluate.same_lists(b, a)


@query("SELECT event_type, count(*) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY event_type")
def latency_quantiles(spark, d):
    return evaluate.quantiles(table(spark, d, "events"), "value", by=("event_type",))


_HUMAN = f"list_filter(regexp_split_to_array({S.fold('title')}, '{T.SEPARATORS}'), lambda w: (length(w) >= 4 OR regexp_full_match(w, '[0-9]')) AND NOT list_contains({S.STOP}, w))"


@query(
    _with(
        "SELECT doc, title, q FROM (SELECT doc, title, string_agg(w, ' ' ORDER BY place) AS q, count(*) AS c FROM kp WHERE place <= 3 GROUP BY doc, title) WHERE c >= 2 ORDER BY (doc * 1103515245 + 12345) % 2147483647, doc LIMIT 150",
        f"hw AS (SELECT doc, title, w, min(ps) AS ps FROM (SELECT doc, title, unnest({_HUMAN}) AS w, generate_subscripts({_HUMAN}, 1) AS ps FROM corpus WHERE length(title) > 25) GROUP BY ALL), hd AS (SELECT w, count(*) AS df FROM hw GROUP BY w), "
        "kp AS (SELECT doc, title, w, row_number() OVER (PARTITION BY doc ORDER BY df, ps) AS place FROM hw JOIN hd USING (w) WHERE df <= 700 AND NOT regexp_full_match(w, '[0-9]+'))",
    )
)
def known_item_queries(spark, d):
    return evaluate.known_items(corpus(spark, d), 150)


# ---- citations -----------------------------------------------------------------------------------------------------------------

_KIND = f"CASE WHEN type = 'memoire' THEN '{cite.MASTER}' ELSE '{cite.DOCTOR}' END"
_SLUG = lambda x: f"regexp_replace(strip_accents(lower({x})), '[^a-z0-9]', '', 'g')"
_WORD = "coalesce(list_filter(regexp_split_to_array(title, '\\s+'), lambda w: length(w) >= 3)[1], '')"
_YEAR = "coalesce(CAST(year AS VARCHAR), '')"
_KEY = f"({_SLUG('string_split(string_split(authors, chr(59))[1], chr(44))[1]')} || {_YEAR} || {_SLUG(_WORD)})"
_NL = " || chr(10) || "


@query(_with(f"SELECT doc, CASE WHEN type = 'memoire' THEN '@mastersthesis' ELSE '@phdthesis' END || '{{' || {_KEY} || ',' || chr(10) || array_to_string(list_filter(['  author = {{' || array_to_string(regexp_split_to_array(authors, ';\\s*'), ' and ') || '}}', CASE WHEN title <> '' THEN '  title  = {{' || title || '}}' END, '  year   = {{' || year || '}}', '  school = {{' || source_name || '}}', '  type   = {{' || {_KIND} || '}}', '  note   = {{Sous la direction de ' || array_to_string(regexp_split_to_array(advisors, ';\\s*'), ' et ') || '}}', '  url    = {{' || url || '}}'], lambda x: x IS NOT NULL), ',' || chr(10)) || chr(10) || '}}' AS citation FROM corpus"))
def citations_bibtex(spark, d):
    return corpus(spark, d).select("doc", cite.bibtex().alias("citation"))


@query(_with(f"SELECT doc, array_to_string(list_filter(list_concat(['TY  - THES'], list_transform(regexp_split_to_array(authors, ';\\s*'), lambda a: 'AU  - ' || a), list_transform(regexp_split_to_array(advisors, ';\\s*'), lambda a: 'A2  - ' || a), [CASE WHEN title <> '' THEN 'TI  - ' || title END, 'PY  - ' || year, 'PB  - ' || source_name, 'M3  - ' || {_KIND}, 'UR  - ' || url, 'ER  - ']), lambda x: x IS NOT NULL), chr(10)) AS citation FROM corpus"))
def citations_ris(spark, d):
    return corpus(spark, d).select("doc", cite.ris().alias("citation"))


@query(_with(f"SELECT doc, trim('src' || (doc % 7) || ',, & a' || (doc % 13) || ', (' || coalesce(CAST(year AS VARCHAR), 's. d.') || '). *' || title || '* [' || {_KIND} || ', ' || source_name || ']. ' || url) AS citation FROM corpus"))
def citations_apa(spark, d):
    return corpus(spark, d).select("doc", cite.apa().alias("citation"))


@query(_with("SELECT doc, replace(replace(replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;'), chr(39), '&#39;') AS title, regexp_replace(CAST(doc * 7919 AS VARCHAR), '^(\\d{1,3}?)((?:\\d{3})*)$', '\\1') || regexp_replace(regexp_replace(CAST(doc * 7919 AS VARCHAR), '^(\\d{1,3}?)((?:\\d{3})*)$', '\\2'), '(\\d{3})', chr(8239) || '\\1', 'g') AS number FROM corpus"))
def escaped_titles(spark, d):
    return corpus(spark, d).select("doc", cite.escaped(F.col("title")).alias("title"), cite.french_number(F.col("doc") * 7919).alias("number"))


@query(_with("SELECT doc, array_to_string(list_filter(['q=' || replace(url_encode(source_name), '%20', '+'), CASE WHEN type <> '' THEN 'type=' || type END, CASE WHEN year IS NOT NULL THEN 'year_min=' || year END, CASE WHEN doc % 2 = 0 THEN 'sort=year_desc' END, CASE WHEN doc % 3 > 0 THEN 'page=' || (doc % 3 + 1) END, 'discipline=' || replace(url_encode(coalesce(discipline, 'x y')), '%20', '+'), 'source=' || source_id], lambda x: x IS NOT NULL), '&') AS query FROM corpus"))
def query_strings(spark, d):
    c = F.col
    text = lambda n, other="": F.coalesce(c(n), F.lit(other))
    q = cite.query_string(c("source_name"), text("type"), F.coalesce(c("year"), F.lit(0)), F.lit(0), F.when(c("doc") % 2 == 0, "year_desc").otherwise("relevance"), c("doc") % 3 + 1, F.array(text("discipline", "x y")), F.array(c("source_id")))
    return corpus(spark, d).select("doc", q.alias("query"))


_ESCAPED = "replace(replace(replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;'), chr(39), '&#39;')"
#: The query's words with every accent their letters may have; none of them stands in an escaped character.
_MARKED = "[tTţťŢŤ][hHĥĤ][eéèêëEÉÈÊË]|[eéèêëEÉÈÊË][rřRŘ][iíìîïIÍÌÎÏ][nñNÑ]|[eéèêëEÉÈÊË][aáàâäãåAÁÀÂÄÃÅ][uúùûüUÚÙÛÜ]"


@query(_with(f"SELECT doc, regexp_replace({_ESCAPED}, '({_MARKED})', '<mark>\\1</mark>', 'g') AS marked FROM corpus"))
def highlight_matches(spark, d):
    return corpus(spark, d).select("doc", P.highlighted("title", F.lit("the erin éau")).alias("marked"))


# ---- views ---------------------------------------------------------------------------------------------------------------------


@query(_with("SELECT doc, CASE WHEN authors <> '' THEN array_to_string(regexp_split_to_array(authors || '; x; y; z', ';\\s*')[1:4], ' · ') END AS authors, array_to_string(regexp_split_to_array(advisors, ';\\s*')[1:3], ' · ') AS advisors, CASE WHEN language IN ('fr', 'en') THEN language ELSE 'fr' END AS language FROM corpus"))
def short_names(spark, d):
    names = F.concat("authors", F.lit("; x; y; z"))
    return corpus(spark, d).select("doc", views.few_names(names).alias("authors"), views.few_names(F.col("advisors"), views.ADVISORS).alias("advisors"), views.page_language(F.col("language")).alias("language"))


@query(_with("SELECT value, label, n, greatest(0, t - 8) AS hidden FROM (SELECT *, row_number() OVER (ORDER BY n DESC, value) AS p, count(*) OVER () AS t FROM (SELECT source_id AS value, source_name AS label, count(*) AS n FROM corpus WHERE contains(lower(source_name), 'src1') GROUP BY ALL)) WHERE p <= 8"))
def facet_text_filter(spark, d):
    return views.facet_list(Q.facets(corpus(spark, d), Q.Request()), "source", "SRC1")


@query(_with("SELECT (year // 10 * 10) || 's' AS value, count(*) AS n, CAST(greatest(2, floor(count(*) / CAST(max(count(*)) OVER () AS DOUBLE) * 100 + 0.5)) AS INTEGER) AS width FROM corpus WHERE year IS NOT NULL GROUP BY 1 ORDER BY 1"))
def decade_bars(spark, d):
    return views.decade_bars(Q.facets(corpus(spark, d), Q.Request()))


@query("SELECT user_id, props, CAST(place AS INTEGER) AS place FROM (SELECT user_id, props, row_number() OVER (PARTITION BY user_id ORDER BY max(ts) DESC, arg_max(event_id, (ts, event_id)) DESC, props) AS place FROM events WHERE props <> '' GROUP BY user_id, props) WHERE place <= 8")
def recent_searches(spark, d):
    return views.recent(table(spark, d, "events"), "user_id", "props", ["ts", "event_id"])


@query(_with("SELECT oai_identifier AS id, title, authors, year, source_name AS source, discipline, url FROM corpus"))
def adapted_rows(spark, d):
    return views.adapted(corpus(spark, d), "relational")


@query("SELECT count(*) AS n, round(avg(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END), 6) AS clicked_rate, round(coalesce(avg(value) FILTER (event_type <> 'error'), 0), 6) AS avg_cost FROM events")
def run_figures(spark, d):
    e = table(spark, d, "events").select((F.col("event_type") == "click").alias("clicked"), F.when(F.col("event_type") != "error", F.col("value")).alias("cost"))
    return views.run_figures(e, ["clicked"], ["cost"])


@query(_with(f"SELECT coalesce(discipline, '{OTHER}') AS discipline, count(*) AS n, round(100 * count(*) / CAST((SELECT count(*) FROM corpus) AS DOUBLE), 1) AS share FROM corpus GROUP BY 1"))
def discipline_histogram(spark, d):
    return views.discipline_histogram(corpus(spark, d))


@query(_with("SELECT CAST(doc AS VARCHAR) AS id, CASE WHEN doc % 3 = 0 THEN 'urn:x:' || 'oai%3Acorpus%3A' || doc ELSE url END AS url FROM corpus"))
def made_up_addresses(spark, d):
    records = corpus(spark, d).withColumn("url", F.when(F.col("doc") % 3 != 0, F.col("url")))
    return search.display(records, "urn:x:").select("id", "url")
