"""Ranked search over the index: filters, minimum match, phrase scoring, block-max pruning, reranking, facets and pages."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators.query import Request, filtered

RERANK_LEAST = 30
#: Most results and terms that are searched by blocks, and results kept ready for the empty query.
FAST_RESULTS = 50
FAST_TERMS = 30
INITIAL = 50


def min_match(terms: int) -> int:
    return terms if terms <= 4 else terms - 1


def _wanted(terms: list[str]) -> Column:
    """A query's terms and phrases are known when it is planned: as a list they reach the scan, which reads their ranges alone."""
    return F.col("term").isin(*T.expanded_terms(terms))


def scored(index: DataFrame, terms: list[str], allowed: DataFrame | None = None, where: Column | None = None) -> DataFrame:
    """(doc, score, hits): impacts summed over base terms and phrases, for records with enough base terms; of all records, those `allowed`,
    or those whose postings pass `where`."""
    found = index.where(_wanted(terms))
    if where is not None:
        found = found.where(where)
    if allowed is not None:
        found = found.join(allowed.select("doc"), "doc", "left_semi")
    summed = found.groupBy("doc").agg(F.sum("impact").alias("score"), F.count_if(F.col("term").isin(*terms)).alias("hits"))
    return summed.where(F.col("hits") >= min_match(len(terms)))


@dataclass(frozen=True)
class FilterPlan:
    """A request's filters in the space of codes: codes wanted of each facet, and the range of years."""

    codes: dict[str, tuple[int, ...]]
    year_min: int | None = None
    year_max: int | None = None

    @property
    def active(self) -> bool:
        return bool(self.codes) or self.year_min is not None or self.year_max is not None

    def block(self) -> Column:
        """Whether a block may hold a record that passes: its masks meet the wanted codes and its years the range."""
        ok = F.lit(True)
        for name, codes in self.codes.items():
            words: dict[int, int] = {}
            for c in codes:
                words[c // 32] = words.get(c // 32, 0) | 1 << c % 32
            met = [F.coalesce(F.element_at(f"{name}_words", F.lit(w).cast("long")), F.lit(0)).bitwiseAND(F.lit(bits).cast("long")) != 0 for w, bits in words.items()]
            ok &= reduce(lambda a, b: a | b, met) if met else F.lit(False)
        if self.year_min is not None:  # with an upper bound alone records without a year pass, which a block's years don't tell
            ok &= F.col("year_max") >= self.year_min
            if self.year_max is not None:
                ok &= F.col("year_min") <= self.year_max
        return F.coalesce(ok, F.lit(False))

    def posting(self) -> Column:
        """Whether a posting's record passes."""
        ok = F.lit(True)
        for name, codes in self.codes.items():
            ok &= F.col(f"{name}_code").isin(*codes) if codes else F.lit(False)
        if self.year_min is not None:
            ok &= F.col("year") >= self.year_min
        if self.year_max is not None:
            ok &= F.col("year") <= self.year_max
        return ok


def filter_plan(r: Request, dictionaries: dict[str, DataFrame]) -> FilterPlan:
    """The plan of a request's filters. dictionaries: (value, code) of source_id, discipline and type; the wanted values' codes are read."""
    asked = {"source_id": r.source, "discipline": r.discipline, "type": (r.type,) if r.type else ()}
    codes = {n: tuple(sorted(x.code for x in dictionaries[n].where(F.col("value").isin(*v)).select("code").collect())) for n, v in asked.items() if v}  # a row a wanted value
    return FilterPlan(codes, r.year_min or None, r.year_max or None)


def fast_path(r: Request, terms: list[str]) -> bool:
    """Whether a request is answered by blocks: the first page by relevance, of few results and terms."""
    return bool(terms) and r.page == 1 and r.sort == "relevance" and r.size <= FAST_RESULTS and len(T.expanded_terms(terms)) <= FAST_TERMS


def pruned(placed: DataFrame, blocks: DataFrame, terms: list[str], k: int, plan: FilterPlan | None = None) -> DataFrame:
    """The k best of scored(), from placed postings and their blocks' summaries.

    First the k-th best score over each term's leading block gives a floor: what those records score on the postings read is at most their
    full score. Blocks are in order of impact, so the blocks that can reach the floor together with every other term's highest impact are
    each term's first ones; a record that stands in none of them is not taken up. With a plan, blocks that hold no passing record are
    left out by their masks. Floor and depths are a few numbers a query; they go into the scan's filter. Results equal the full evaluation.
    """
    passing = plan is not None and plan.active
    where = plan.posting() if passing else F.lit(True)
    mine = placed.where(_wanted(terms) & where)
    lead = mine.where("block = 0").groupBy("doc").agg(F.sum("impact").alias("low"), F.count_if(F.col("term").isin(*terms)).alias("hits"))
    lows = lead.where(F.col("hits") >= min_match(len(terms))).orderBy(F.desc("low"), "doc").limit(k).agg(F.count("*").alias("n"), F.min("low").alias("low")).first()
    floor = lows.low if lows.n == k else 0
    own = blocks.where(_wanted(terms) & (plan.block() if passing else F.lit(True)))
    tops = own.groupBy("term").agg(F.max("max_impact").alias("top"))
    others = tops.agg(F.sum("top").alias("tops"))
    reach = own.join(F.broadcast(tops), "term").crossJoin(F.broadcast(others))  # a row a term of the query
    deep = reach.where(F.col("tops") - F.col("top") + F.col("max_impact") >= floor).groupBy("term").agg(F.max("block").alias("b")).collect()  # a row a term of the query
    if not deep:
        return scored(placed.limit(0), terms)
    near = reduce(lambda a, b: a | b, [(F.col("term") == x.term) & (F.col("block") <= x.b) for x in deep])
    docs = placed.where(near & where).select("doc").distinct()
    return scored(placed, terms, docs, where).orderBy(F.desc("score"), "doc").limit(k)


def reranked(index: DataFrame, found: DataFrame, terms: list[str], window: int) -> DataFrame:
    """found (doc, score) with its first `window` rows reordered by the proximity features their titles have; ties keep their order."""
    asked = T.dependency_terms(terms)
    placed = found.orderBy(F.desc("score"), "doc").limit(window).withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "doc")))  # `window` rows
    if not asked:
        return placed.select("doc", "score", "place")
    weight = F.element_at(F.create_map(*[F.lit(x) for t in asked.items() for x in t]), F.col("term"))
    extra = index.where(F.col("term").isin(*asked)).join(F.broadcast(placed.select("doc")), "doc").groupBy("doc").agg(F.sum(F.col("impact") * weight).alias("extra"))  # `window` rows
    both = placed.join(extra, "doc", "left").withColumn("score", F.round(F.col("score") + F.coalesce("extra", F.lit(0.0)), 6))
    return both.select("doc", "score", F.row_number().over(Window.orderBy(F.desc("score"), "place")).alias("place"))


def search(index: DataFrame, records: DataFrame, r: Request, rerank: bool = True, blocks: DataFrame | None = None, facets: dict[str, DataFrame] | None = None) -> DataFrame:
    """(doc, score, place): one page. Without query terms all records that pass the filters, in their order, with score 0. Given the summaries
    of a placed index's blocks and the facets' dictionaries, first pages are answered by blocks (fast_path); the rows are the same."""
    terms = [t for _, t in T.analyze_query(r.q)]
    size, page = max(1, r.size), max(1, r.page)
    active = Request(discipline=r.discipline, source=r.source, type=r.type, year_min=r.year_min, year_max=r.year_max)
    unfiltered = active == Request()
    allowed = filtered(records.withColumn("year", F.coalesce("year", F.lit(0))) if r.year_min or r.year_max else records, active)
    if blocks is not None and fast_path(r, terms):
        plan = None if unfiltered else filter_plan(r, facets or {})
        few = pruned(index, blocks, terms, max(RERANK_LEAST, size), plan)
        found = few.select("doc", F.col("score").cast("double").alias("score"), F.lit(0).alias("year"))
    elif not terms:
        found = allowed.select("doc", F.lit(0).cast("double").alias("score"), "year")
    else:
        found = scored(index, terms, None if unfiltered else allowed).join(records.select("doc", "year"), "doc").select("doc", F.col("score").cast("double").alias("score"), "year")
    if r.sort == "year_desc":
        by = [F.coalesce("year", F.lit(0)).desc(), F.desc("score"), F.col("doc")]
    elif r.sort == "year_asc":
        by = [F.coalesce(F.nullif("year", F.lit(0)), F.lit(9999)).asc(), F.desc("score"), F.col("doc")]
    else:
        by = [F.desc("score"), F.col("doc")]
    if rerank and terms and r.sort == "relevance":
        window = max(RERANK_LEAST, size * page)
        ranked = reranked(index, found.select("doc", "score"), terms, window)
        return ranked.where((F.col("place") > size * (page - 1)) & (F.col("place") <= size * page))
    top = found.orderBy(*by).limit(size * page).withColumn("place", F.row_number().over(Window.orderBy(*by)))
    return top.where(F.col("place") > size * (page - 1)).select("doc", "score", "place")


def initial_page(records: DataFrame, n: int = INITIAL, key: str = "doc") -> DataFrame:
    """(doc, place): what the empty query without filters shows, in order of the records' numbers; written once, its pages need no search."""
    first = records.select(F.col(key).alias("doc")).orderBy("doc").limit(n)
    return first.withColumn("place", F.row_number().over(Window.orderBy("doc")))  # n rows


def facet_counts(found: DataFrame, records: DataFrame) -> DataFrame:
    """(facet, value, n) over the records found."""
    each = F.array(*[F.struct(F.lit(n).alias("facet"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("value")) for n, c in (("source", "source_id"), ("discipline", "discipline"), ("type", "type"), ("decade", "decade"))])
    rows = records.withColumn("decade", T.decade(F.col("year"))).join(found.select("doc"), "doc", "left_semi")
    return rows.select(F.explode(each).alias("f")).select("f.*").groupBy("facet", "value").agg(F.count("*").alias("n"))


def loaded(page: DataFrame, records: DataFrame) -> DataFrame:
    """Whole rows of a page: ranking first, rows last."""
    return F.broadcast(page).join(records, "doc").orderBy("place")


def display(records: DataFrame, urn: str = "urn:record:") -> DataFrame:
    """Rows as they are shown: ids as text, empty strings null, abstracts cut, an address made of `urn` where there is none."""
    cut = T.truncated(F.col("abstract"), 900, "…")
    shown = {c: F.nullif(F.col(c), F.lit("")) for c in ("title", "authors", "advisors", "subjects", "type", "language", "publisher", "discipline", "source_id", "source_name")}
    address = F.coalesce(F.nullif("url", F.lit("")), F.concat(F.lit(urn), F.replace(F.url_encode(F.coalesce("oai_identifier", F.col("doc").cast("string"))), F.lit("+"), F.lit("%20"))))
    return records.select(F.col("doc").cast("string").alias("id"), *[v.alias(k) for k, v in shown.items()], F.nullif(cut, F.lit("")).alias("abstract"), "year", address.alias("url"))


def all_of(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
