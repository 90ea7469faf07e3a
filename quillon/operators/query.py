"""Relational search: filters, prefix full-text match, facets, sorts and pages over records."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.schema import OTHER

#: Fields that full-text search reads.
TEXT_FIELDS = ("title", "authors", "advisors", "abstract", "subjects")
K1, B = 1.2, 0.75


@dataclass(frozen=True)
class Request:
    q: str = ""
    discipline: tuple[str, ...] = ()
    source: tuple[str, ...] = ()
    author: tuple[str, ...] = ()
    type: str | None = None
    year_min: int | None = None
    year_max: int | None = None
    sort: str = "relevance"
    page: int = 1
    size: int = 20
    extra: dict = field(default_factory=dict, compare=False)


def has_author(authors: Column, name: str) -> Column:
    """Whether a name stands in a ";"-joined column as a whole."""
    tight = F.replace(F.replace(authors, F.lit("; "), F.lit(";")), F.lit(" ;"), F.lit(";"))
    return F.instr(F.concat(F.lit(";"), tight, F.lit(";")), f";{name};") > 0


def predicate(r: Request) -> Column | None:
    """The conjunction of the request's filters; values of one list are alternatives, several authors must all be there."""
    parts: list[Column] = []
    if r.discipline:
        parts.append(F.col("discipline").isin(*r.discipline))
    if r.source:
        parts.append(F.col("source_id").isin(*r.source))
    parts += [has_author(F.col("authors"), a) for a in r.author]
    if r.type:
        parts.append(F.col("type") == r.type)
    if r.year_min is not None:
        parts.append(F.col("year") >= r.year_min)
    if r.year_max is not None:
        parts.append(F.col("year") <= r.year_max)
    return reduce(lambda a, b: a & b, parts) if parts else None


def filtered(records: DataFrame, r: Request) -> DataFrame:
    where = predicate(r)
    return records if where is None else records.where(where)


def prefix_groups(q: str) -> list[list[str]]:
    """A query's phrases: each a list of folded words, the last of which is a prefix."""
    groups = []
    for raw in re.findall(r"[\w\-]+", q or ""):
        if len(raw) >= 2:
            words = [w for w in re.split(r"[\W_]+", T.py_fold(raw)) if w]
            if words:
                groups.append(words)
    return groups


def words(c: Column) -> Column:
    return F.filter(F.split(T.fold(c), T.WORD_SEPARATORS), lambda w: w != "")


def _places(tokens: Column, phrase: list[str]) -> Column:
    """Number of places of a phrase whose last word is a prefix."""
    if len(phrase) == 1:
        return F.size(F.filter(tokens, lambda w: w.startswith(phrase[0])))

    def here(r: Column) -> Column:
        ok = F.get(r, len(phrase) - 1).startswith(phrase[-1])
        for k, w in enumerate(phrase[:-1]):
            ok &= F.get(r, k) == w
        return ok

    return F.size(F.filter(T.runs(tokens, len(phrase)), here))


def matched(records: DataFrame, q: str, key: str = "doc") -> DataFrame:
    """(key, tf0, tf1, ..., len): places of each phrase of q over the text fields, read from the records themselves: for tables that have no
    full-text index. Fields are walked apart, so no phrase runs over a field's end. One pass over the records and no shuffle.
    """
    groups = prefix_groups(q)
    tokens = records.select(key, *[words(F.col(c)).alias(f"w_{c}") for c in TEXT_FIELDS])
    total = lambda f: reduce(lambda a, b: a + b, [f(F.col(f"w_{c}")) for c in TEXT_FIELDS])
    found = tokens.select(key, *[total(lambda w, g=g: _places(w, g)).alias(f"tf{i}") for i, g in enumerate(groups)], total(F.size).alias("len"))
    return found


def bm25_score(n: int) -> Column:
    """BM25 of n phrases from columns tf0, df0, ..., len, n and avg_len."""
    score = F.lit(0.0)
    for i in range(n):
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.greatest(F.log((F.col("n") - df + 0.5) / (df + 0.5)), F.lit(1e-6))
        score += idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    return score


def bm25(records: DataFrame, q: str, key: str = "doc") -> DataFrame:
    """(key, score): BM25 of the phrases over all text fields as one, records that hold all phrases; higher is better."""
    n = len(prefix_groups(q))
    found = matched(records, q, key)
    stats = found.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(n)])
    both = reduce(lambda d, i: d.where(F.col(f"tf{i}") > 0), range(n), found).crossJoin(F.broadcast(stats))  # stats is one row
    return both.select(key, bm25_score(n).alias("score"))


def hits(records: DataFrame, r: Request, key: str = "doc", index=None) -> DataFrame:
    """Records that pass q and the filters, with `score` (null without a query). With a full-text index q is looked up there."""
    kept = filtered(records, r)
    if not prefix_groups(r.q):  # also a query of single letters only: there is nothing to rank by
        return kept.withColumn("score", F.lit(None).cast("double"))
    if index is None:
        return kept.join(bm25(records, r.q, key), key)
    from quillon.operators import fulltext

    return kept.join(fulltext.bm25(index, r.q).withColumnRenamed("doc", key), key)


def order(r: Request, key: str = "doc") -> list[Column]:
    """A total order: the key settles ties."""
    by = {
        "year_desc": [F.col("year").desc_nulls_last(), F.col("title").asc()],
        "year_asc": [F.col("year").asc_nulls_last(), F.col("title").asc()],
        "title_asc": [F.lower("title").asc(), F.col("title").asc()],
    }.get(r.sort)
    if by is None:
        by = [F.col("score").desc(), F.col("year").desc_nulls_last()] if prefix_groups(r.q) else [F.col("year").desc_nulls_last(), F.col("title").asc()]
    return [*by, F.col(key).asc()]


def search(records: DataFrame, r: Request, key: str = "doc", index=None) -> DataFrame:
    """One page of results. Ranking carries the key and the sort columns only; whole rows are joined to the page."""
    size, page = max(1, min(100, r.size)), max(1, r.page)
    ranked = hits(records, r, key, index).select(key, "year", "title", F.round("score", 6).alias("score")).orderBy(*order(r, key)).limit(size * page)
    return ranked.offset(size * (page - 1)) if page > 1 else ranked


def results(records: DataFrame, r: Request, key: str = "doc", index=None) -> DataFrame:
    """Whole rows of a page with `place`; ranking first, rows last."""
    page = search(records, r, key, index).select(key, F.monotonically_increasing_id().alias("m"))
    placed = page.withColumn("place", F.row_number().over(Window.orderBy("m"))).drop("m")  # one page
    return records.join(F.broadcast(placed), key).orderBy("place")


def count(records: DataFrame, r: Request, key: str = "doc", index=None) -> DataFrame:
    return hits(records, r, key, index).agg(F.count("*").alias("n"))


def facets(records: DataFrame, r: Request, key: str = "doc", top_authors: int = 50, index=None) -> DataFrame:
    """(facet, value, label, n) of all facets at once. Counts apply all filters, the facet's own too."""
    kept = hits(records, r, key, index)
    one = lambda name, value, label=None: F.struct(F.lit(name).alias("facet"), value.alias("value"), (value if label is None else label).alias("label"))
    flat = F.array(
        one("discipline", F.coalesce(F.nullif("discipline", F.lit("")), F.lit(OTHER))),
        one("source", F.col("source_id"), F.col("source_name")),
        one("type", F.coalesce(F.nullif("type", F.lit("")), F.lit("?"))),
        one("decade", T.decade(F.when(F.col("year") != 0, F.col("year")))),
    )
    names = F.transform(T.split_names(F.col("authors")), lambda a: F.struct(F.lit("author").alias("facet"), a.alias("value"), a.alias("label")))
    counts = kept.select(F.explode(F.concat(flat, names)).alias("f")).select("f.*").where("value is not null").groupBy("facet", "value", "label").agg(F.count("*").alias("n"))
    # authors are ranked, all other facets keep every value; a window with a limit keeps the best of each task before it shuffles
    best = Window.partitionBy("facet").orderBy(F.desc("n"), "value")
    return counts.where("facet <> 'author'").unionByName(counts.where("facet = 'author'").withColumn("__p", F.row_number().over(best)).where(F.col("__p") <= top_authors).drop("__p"))


def sources(records: DataFrame) -> DataFrame:
    return records.groupBy("source_id", "source_name").agg(F.count("*").alias("n")).orderBy("source_name")


def health() -> dict:
    return {"ok": True}
