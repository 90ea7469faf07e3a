"""Spelling correction: delete-key dictionary, candidates, scoring, plans and "did you mean"."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import python as P
from quillon.functions import text as T
from quillon.operators import search as S

#: Fixed values of the dictionary and of acceptance.
MOST_PER_KEY = 32
MOST_PER_TOKEN = 64
LEAST_SCORE = 0.5
PLANS_PER_TOKEN = 4
MOST_PLANS = 12
MOST_TERMS = 8
DF_RATIO = 0.08
PLAIN = "^[a-z][a-z0-9]*$"
FIELDS = ("title", "authors", "advisors", "subjects", "discipline", "source_name")


def eligible(terms: DataFrame, total: DataFrame, least: int = 5, most: int = 20) -> DataFrame:
    """(term, df) of the terms that go into the spelling index: plain words of usual length that are not in too many records."""
    usual = F.length("term").between(least, most) & F.col("term").rlike(PLAIN)
    return terms.where(usual).crossJoin(F.broadcast(total)).where(F.col("df") <= F.greatest(F.lit(1), F.floor(F.col("n") * DF_RATIO))).select("term", "df")  # total is one row


def surfaces(records: DataFrame, key: str = "doc") -> DataFrame:
    """(surface, term, df): records that hold a word, with its term; of records with many words each pair counts once."""
    every = F.array_distinct(F.concat(*[T.surface_pairs(F.col(c)) for c in FIELDS]))
    df = records.select(F.explode(every).alias("p")).select("p.*").groupBy("surface", "term").agg(F.count("*").alias("df"))
    n = records.agg(F.count("*").alias("n"))
    usual = (F.length("surface").between(4, 24)) & (F.length("term").between(2, 20)) & F.col("surface").rlike(PLAIN) & F.col("term").rlike(PLAIN)
    return df.where(usual).crossJoin(F.broadcast(n)).where(F.col("df") <= F.greatest(F.lit(1), F.floor(F.col("n") * DF_RATIO))).drop("n")


def delete_index(words: DataFrame) -> DataFrame:
    """(delete_key, surface, term, df): the best candidates of every delete key."""
    keyed = words.select(F.explode(T.delete_keys(F.col("surface"))).alias("delete_key"), "surface", "term", "df")
    best = Window.partitionBy("delete_key").orderBy(F.desc("df"), F.length("surface"), F.length("term"), "surface", "term")
    return keyed.withColumn("place", F.row_number().over(best)).where(F.col("place") <= MOST_PER_KEY).drop("place")


def edits_for(token: Column) -> Column:
    return F.when(F.length(token) >= 8, 2).otherwise(1)


def score(token: Column, surface: Column, df: Column, distance: Column) -> Column:
    n = F.least(F.length(token), F.length(surface))
    prefix = F.array_max(F.filter(F.sequence(F.lit(0), n), lambda i: F.substring(token, F.lit(1), i) == F.substring(surface, F.lit(1), i)))
    likeness = P.lcs_length(token, surface) / F.greatest(F.lit(1), F.length(token))
    first = F.when(F.left(token, F.lit(1)) == F.left(surface, F.lit(1)), 1.2).otherwise(-1.6)
    last = F.when(F.right(token, F.lit(1)) == F.right(surface, F.lit(1)), 0.35).otherwise(0.0)
    return F.log1p(df) * 1.15 + F.least(prefix, F.lit(4)) * 0.15 + likeness * 4.0 + first + last - distance * 2.35 - F.abs(F.length(token) - F.length(surface)) * 0.25


def reach(tokens: DataFrame, index: DataFrame) -> DataFrame:
    """(token, surface, term, df, distance): words within reach of each token. Delete keys meet by an equi-join; the distance is measured on
    what met only."""
    asked = tokens.where(F.col("token").rlike(PLAIN) & F.length("token").between(2, 24)).select("token", F.explode(T.delete_keys(F.col("token"))).alias("delete_key"))
    met = asked.join(index, "delete_key").where("surface <> token").groupBy("token", "surface", "term").agg(F.max("df").alias("df"))
    edits = edits_for(F.col("token"))
    # an exchange of neighbours is two plain edits: what is further than twice as many plain ones apart needs no exact distance
    met = met.where(F.levenshtein("token", "surface", 4) >= 0).where(F.levenshtein("token", "surface") <= 2 * edits)
    near = met.withColumn("distance", P.osa_distance("token", "surface", edits_for(F.col("token")))).where((F.col("distance") >= 1) & (F.col("distance") <= edits_for(F.col("token"))))
    return near


def candidates(tokens: DataFrame, index: DataFrame) -> DataFrame:
    """(token, surface, term, df, distance, score): the best words within reach of each token."""
    rated = reach(tokens, index).withColumn("score", F.round(score(F.col("token"), F.col("surface"), F.col("df"), F.col("distance")), 9))
    best = Window.partitionBy("token").orderBy(F.desc("score"), "distance", F.desc("df"), "term", "surface")
    return rated.withColumn("place", F.row_number().over(best)).where(F.col("place") <= MOST_PER_TOKEN).drop("place")


def plans(analyzed: list[tuple[str, str]], present: dict[str, int], index: DataFrame) -> list[tuple[float, list[str], dict]]:
    """Queries with one term replaced, best first. While some terms are missing from the index, those that are there stay."""
    base = [t for _, t in analyzed]
    if not base or len(base) > MOST_TERMS:
        return []
    missing = any(t not in present for t in base)
    asked = [(i, raw) for i, (raw, t) in enumerate(analyzed) if not (present.get(t) and missing)]
    if not asked:
        return []
    tokens = index.sparkSession.createDataFrame([(raw,) for _, raw in asked], "token string").distinct()
    accepted = candidates(tokens, index).where(F.col("score") >= LEAST_SCORE)
    best = Window.partitionBy("token").orderBy(F.desc("score"), "distance", F.desc("df"), "term", "surface")
    rows = accepted.withColumn("place", F.row_number().over(best)).where(F.col("place") <= PLANS_PER_TOKEN).collect()  # 4 a query term
    found = []
    for i, raw in asked:
        for row in rows:
            if row.token == raw and row.term != base[i]:
                found.append((row.score, [*base[:i], row.term, *base[i + 1 :]], {"from": raw, "to": row.term, "surface": row.surface, "distance": row.distance, "df": row.df}))
    found.sort(key=lambda p: (-p[0], " ".join(p[1])))
    return found[:MOST_PLANS]


def corrected(postings: DataFrame, index: DataFrame, q: str, size: int = 20) -> tuple[list[str], dict] | None:
    """The corrected query that is worth most, if it finds more than the query as typed: score + 0.05 * min(found, 20)."""
    analyzed = T.analyze_query(q)
    base = [t for _, t in analyzed]
    spark = postings.sparkSession
    present = {r.term: r.df for r in postings.where(F.col("term").isin(*base, "")).groupBy("term").agg(F.max("df").alias("df")).collect()}  # a row a query term
    before = S.scored(postings, base).count() if base else 0
    if before:
        return None
    tried = plans(analyzed, present, index)  # at most MOST_PLANS
    if not tried:
        return None
    rows = [(n, t, t in terms, S.min_match(len(terms))) for n, (_, terms, _) in enumerate(tried) for t in T.expanded_terms(terms)]
    asked = spark.createDataFrame(rows, "plan int, term string, base boolean, least int")
    found = postings.where(F.col("term").isin(*{r[1] for r in rows})).join(F.broadcast(asked), "term").groupBy("plan", "least", "doc").agg(F.count_if("base").alias("hits"))  # tens of rows
    totals = {r.plan: r.n for r in found.where("hits >= least").groupBy("plan").agg(F.count("*").alias("n")).collect()}  # a row a plan
    best, worth = None, 0.0
    for n, (value, terms, change) in enumerate(tried):
        total = totals.get(n, 0)
        if total > before and value + 0.05 * min(total, size) > worth:
            best, worth = (terms, change), value + 0.05 * min(total, size)
    return best


def did_you_mean(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(token, suggestion): the nearest facet label within one edit for four letters; the first of equals by `place`."""
    budget = F.greatest(F.lit(1), F.floor(F.length("token") / 4)).cast("int")
    pairs = tokens.where(F.length("token") >= 4).join(F.broadcast(vocabulary), F.abs(F.length("token") - F.length("word")) <= budget)  # facet labels: a vocabulary
    near = pairs.withColumn("d", F.levenshtein("token", "word")).where(F.col("d") <= budget)
    return near.groupBy("token").agg(F.min_by("word", F.struct("d", "place")).alias("suggestion")).where("suggestion <> token")


def mutated(token: Column, seed: Column) -> Column:
    """A word with one letter left out, two changed about, one replaced or one doubled, as the seed says; words under five letters stay."""
    n = F.length(token)
    inner = F.when(n > 6, 1).otherwise(0)
    at = inner + F.pmod(seed, F.greatest(F.lit(1), n - 2 * inner))
    part = lambda a, b: F.substring(token, a, b)
    letters = "etaoinshrdlucmpgfbvyq"
    here = part(at + 1, F.lit(1))
    other = F.substring(F.lit(letters), F.pmod(F.instr(F.lit(letters), here) - 1 + seed + 7, F.lit(len(letters))).cast("int") + 1, F.lit(1))
    op = F.pmod(seed, F.lit(4))
    head, tail = part(F.lit(1), at), lambda k: part(at + k, n)
    return (
        F.when(n < 5, token)
        .when(op == 0, F.concat(head, tail(2)))
        .when((op == 1) & (at < n - 1), F.concat(head, part(at + 2, F.lit(1)), here, tail(3)))
        .when(op == 2, F.concat(head, other, tail(2)))
        .otherwise(F.concat(head, here, tail(1)))
    )
