"""What is shown around results: shortened names, facet lists, decade bars, recent searches, adapters, and figures of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.schema import OTHER

#: Names shown of authors and advisors, facet values before "more", recent searches kept, least width of a bar.
AUTHORS, ADVISORS, FACET_VALUES, RECENT, BAR = 4, 3, 8, 8, 2
#: Names that other engines give to the columns of a result.
ADAPTERS = {
    "relational": {"id": "oai_identifier", "title": "title", "authors": "authors", "year": "year", "source": "source_name", "discipline": "discipline", "url": "url"},
    "pages": {"url": "url", "title": "title", "excerpt": "abstract", "author": "authors", "year": "year"},
}


def few_names(names: Column, most: int = AUTHORS) -> Column:
    """The first names of a "; "-joined column; null where there are none."""
    return F.when(F.coalesce(names, F.lit("")) != "", F.array_join(F.slice(F.split(names, r";\s*"), 1, most), " · "))


def page_language(language: Column) -> Column:
    """The language a page is set in: French or English by its first two letters, else French."""
    two = F.substring(F.lower(F.coalesce(language, F.lit(""))), 1, 2)
    return F.when(two.isin("fr", "en"), two).otherwise("fr")


def facet_list(counts: DataFrame, facet: str, text: str = "", more: bool = False) -> DataFrame:
    """(value, label, n, hidden): a facet's values whose label holds the text, whatever its case, the first FACET_VALUES of them; `hidden`
    is the number of the rest."""
    rows = counts.where((F.col("facet") == facet) & F.contains(F.lower("label"), F.lit(text.lower())))
    order = Window.orderBy(F.desc("n"), "value")  # a facet's vocabulary
    listed = rows.select("value", "label", "n", F.row_number().over(order).alias("p"), F.count("*").over(Window.partitionBy(F.lit(1))).alias("t"))
    return listed if more else listed.where(F.col("p") <= FACET_VALUES).select("value", "label", "n", F.greatest(F.lit(0), F.col("t") - FACET_VALUES).alias("hidden"))


def decade_bars(counts: DataFrame) -> DataFrame:
    """(value, n, width): decades that hold records, in order, with the width of their bars in percent of the largest."""
    rows = counts.where((F.col("facet") == "decade") & (F.col("n") > 0))
    top = rows.agg(F.max("n").alias("top"))
    width = F.greatest(F.lit(BAR), F.floor(F.col("n") / F.col("top") * 100 + 0.5)).cast("int")
    return rows.crossJoin(F.broadcast(top)).select("value", "n", width.alias("width")).orderBy("value")  # top is one row


def recent(searches: DataFrame, who: str, key: str, at: list[str], most: int = RECENT) -> DataFrame:
    """(who, key, place): the latest different searches of everybody; blank ones are not kept. The latest of each key is found by a
    pre-aggregated max, so somebody's thousand equal searches are one row."""
    last = searches.where(F.coalesce(F.col(key), F.lit("")) != "").groupBy(who, key).agg(F.max(F.struct(*at)).alias("__at"))
    place = F.row_number().over(Window.partitionBy(who).orderBy(F.desc("__at"), key))
    return last.withColumn("place", place).where(F.col("place") <= most).select(who, key, "place")


def adapted(rows: DataFrame, engine: str) -> DataFrame:
    """Rows under the names of another engine; columns that are not there are null."""
    return rows.select(*[(F.col(c) if c in rows.columns else F.lit(None).cast("string")).alias(n) for n, c in ADAPTERS[engine].items()])


def run_figures(runs: DataFrame, rates: list[str], averages: list[str]) -> DataFrame:
    """One row: n, the share of runs in which each of `rates` holds and the mean of each of `averages` over the runs that have one."""
    share = [F.round(F.coalesce(F.avg(F.coalesce(F.col(c), F.lit(False)).cast("int")), F.lit(0.0)), 6).alias(f"{c}_rate") for c in rates]
    mean = [F.round(F.coalesce(F.avg(F.when(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")), F.col(c))), F.lit(0.0)), 6).alias(f"avg_{c}") for c in averages]
    return runs.agg(F.count("*").alias("n"), *share, *mean)


def discipline_histogram(records: DataFrame) -> DataFrame:
    """(discipline, n, share): the labels' shares; that of OTHER is what is left unclassified."""
    total = records.agg(F.count("*").alias("t"))
    counts = records.groupBy(F.coalesce("discipline", F.lit(OTHER)).alias("discipline")).agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(total)).select("discipline", "n", F.round(100 * F.col("n") / F.col("t"), 1).alias("share"))  # total is one row
