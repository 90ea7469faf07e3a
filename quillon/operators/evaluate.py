"""Retrieval metrics: hits, reciprocal ranks, agreement of rankings, nearest-rank quantiles, and test query synthesis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import text as T


def ranks(results: DataFrame, targets: DataFrame) -> DataFrame:
    """(query, rank): the place of each query's target in results (query, doc, place), 0 if it isn't there."""
    found = targets.join(results, ["query", "doc"], "left").groupBy("query").agg(F.coalesce(F.min("place"), F.lit(0)).alias("rank"))
    return found


def hit_metrics(ranked: DataFrame) -> DataFrame:
    """(n, hit1, hit3, hit10, mrr10) of (query, rank)."""
    r = F.col("rank")
    within = lambda k: F.round(F.avg(((r > 0) & (r <= k)).cast("int")), 6)
    return ranked.agg(F.count("*").alias("n"), within(1).alias("hit1"), within(3).alias("hit3"), within(10).alias("hit10"), F.round(F.avg(F.when((r > 0) & (r <= 10), 1 / r).otherwise(0.0)), 6).alias("mrr10"))


def agreement(ours: DataFrame, reference: DataFrame, depth: int = 10) -> DataFrame:
    """(query, overlap, ndcg, top1_rank): how far our ranking (query, doc, place) agrees with a reference ranking of the same shape.

    The reference's place i of d has relevance (d - i + 1) / d, discounted by log2 of our place + 1.
    """
    d = reference.where(F.col("place") <= depth).groupBy("query").agg(F.max("place").alias("d"))
    ref = reference.where(F.col("place") <= depth).join(d, "query").select("query", "doc", F.col("place").alias("rp"), "d", ((F.col("d") - F.col("place") + 1) / F.col("d")).alias("rel"))
    both = ref.join(ours.where(F.col("place") <= depth).select("query", "doc", F.col("place").alias("op")), ["query", "doc"], "left")
    gain = F.sum(F.coalesce(F.col("rel") / F.log2(F.col("op") + 1), F.lit(0.0)))
    ideal = F.sum(F.col("rel") / F.log2(F.col("rp") + 1))
    return both.groupBy("query").agg(F.round(F.count("op") / F.max("d"), 6).alias("overlap"), F.round(gain / ideal, 6).alias("ndcg"), F.coalesce(F.max(F.when(F.col("rp") == 1, F.col("op"))), F.lit(0)).alias("top1_rank"))


def same_lists(fast: DataFrame, exact: DataFrame) -> DataFrame:
    """(n, top1_match, top10_match, overlap10) of two rankings (query, doc, place)."""
    listed = lambda d, n: d.where(F.col("place") <= 10).groupBy("query").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "doc"))), lambda x: x["doc"]).alias(n))
    both = listed(exact, "e").join(listed(fast, "f"), "query", "left")
    f, e = F.coalesce("f", F.array().cast("array<bigint>")), F.col("e")
    return both.agg(F.count("*").alias("n"), F.round(F.avg(F.coalesce((F.get(f, 0) == F.get(e, 0)).cast("int"), F.lit(0))), 6).alias("top1_match"), F.round(F.avg((f == e).cast("int")), 6).alias("top10_match"), F.round(F.avg(F.size(F.array_intersect(f, e)) / F.size(e)), 6).alias("overlap10"))


def quantiles(values: DataFrame, column: str, qs: tuple[float, ...] = (0.5, 0.95), by: tuple[str, ...] = ()) -> DataFrame:
    """Nearest-rank quantiles: the smallest value with at least the share q of all at or below it."""
    aggs = [F.expr(f"percentile_disc({q}) within group (order by {column})").alias(f"p{round(q * 100)}") for q in qs]
    return values.groupBy(*by).agg(F.count("*").alias("n"), *aggs)


def known_items(records: DataFrame, n: int, key: str = "doc", seed: int = 12345, most_df: int = 700) -> DataFrame:
    """(doc, title, q): queries of a title's two or three rarest words, for n records in a seeded order."""
    titled = records.where(F.length("title") > 25).select(F.col(key).alias("doc"), "title")
    words = titled.select("doc", "title", F.posexplode(F.array_distinct(T.human_words(F.col("title")))).alias("at", "w"))
    df = words.groupBy("w").agg(F.count("*").alias("df"))
    rare = Window.partitionBy("doc").orderBy("df", "at")
    kept = words.join(df, "w").where((F.col("df") <= most_df) & ~F.col("w").rlike("^[0-9]+$")).withColumn("place", F.row_number().over(rare)).where("place <= 3")
    queries = kept.groupBy("doc", "title").agg(F.count("*").alias("c"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "w"))), lambda x: x["w"]), " ").alias("q")).where("c >= 2")
    return queries.orderBy(shuffled(F.col("doc"), seed), "doc").limit(n).select("doc", "title", "q")


def shuffled(id_: Column, seed: int) -> Column:
    """A seeded order any engine can follow: a multiplicative congruence of the id."""
    return F.pmod(id_ * 1103515245 + seed, F.lit(2147483647))
