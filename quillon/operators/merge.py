"""Rank-gated upserts, tombstones and checkpoints over plain tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Strength of a label's provenance; others have 0.
RANKS = {"manual": 4, "auth": 3, "llm": 2, "rule_abstract": 1}
#: Columns an update never overwrites: the key, the first-seen time, and the gated pair.
LABEL = ("discipline", "discipline_source")


def rank(source: Column) -> Column:
    out = F.lit(0)
    for name, value in RANKS.items():
        out = F.when(source == name, value).otherwise(out)
    return out


def upserted(existing: DataFrame, incoming: DataFrame, key: str = "oai_identifier", keep: tuple[str, ...] = ("harvested_at",)) -> DataFrame:
    """existing with incoming (one row a key) merged: all columns are overwritten but `keep`; the label only by one of at least its rank."""
    new = incoming.select(F.col(key), F.struct(*incoming.columns).alias("n"))
    old = existing.select(F.col(key), F.struct(*existing.columns).alias("o"))
    both = old.join(new, key, "full")
    fresh, had = F.col("n").isNotNull(), F.col("o").isNotNull()
    gate = fresh & (~had | (rank(F.col("n.discipline_source")) >= rank(F.col("o.discipline_source"))))
    columns = []
    for c in existing.columns:
        if c == key:
            columns.append(F.col(key))
        elif c in LABEL:
            columns.append(F.when(gate, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
        elif c in keep or c not in incoming.columns:
            new_value = F.col(f"n.{c}") if c in incoming.columns else F.lit(None)
            columns.append(F.when(had, F.col(f"o.{c}")).otherwise(new_value).alias(c))
        else:
            columns.append(F.when(fresh, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
    return both.select(*columns)


def without(existing: DataFrame, tombstones: DataFrame, key: str = "oai_identifier") -> DataFrame:
    return existing.join(tombstones.select(key).distinct(), key, "left_anti")


def folded(feed: DataFrame, key: str, arrival: list[str], source: str, deleted: str, columns: list[str], label: str) -> DataFrame:
    """The state a feed of versions and tombstones leaves, as one aggregation.

    Applying versions in order of arrival keeps, of the versions after the last tombstone, the newest columns and the newest label among those
    of the highest rank: a weaker one never replaces it, one as strong or stronger always does.
    """
    at = F.struct(*arrival)
    last = Window.partitionBy(key)
    live = feed.withColumn("__at", at).withColumn("__gone", F.max(F.when(F.col(deleted), F.col("__at"))).over(last)).where(~F.col(deleted) & (F.col("__gone").isNull() | (F.col("__at") > F.col("__gone"))))
    strongest = F.max_by(F.struct(F.col(label).alias("l"), F.col(source).alias("s")), F.struct(rank(F.col(source)).alias("r"), F.col("__at").alias("a")))
    newest = F.max_by(F.struct(*columns), "__at")
    out = live.groupBy(key).agg(newest.alias("c"), strongest.alias("b"))
    return out.select(key, "c.*", F.col("b.l").alias(label), F.col("b.s").alias(source))


def latest(feed: DataFrame, key: str, arrival: list[str]) -> DataFrame:
    """The newest version of every key."""
    rest = [c for c in feed.columns if c != key]
    return feed.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*arrival)).alias("r")).select(key, "r.*")


def checkpointed(state: DataFrame, runs: DataFrame) -> DataFrame:
    """state (a row a source) with the runs that ended well: a run that failed leaves the old checkpoint, so its window is read again."""
    good = runs.where("succeeded").drop("succeeded")
    return state.join(good.select("source_id"), "source_id", "left_anti").unionByName(good.select(*state.columns))


def resume_from(sources: DataFrame, state: DataFrame, full: bool = False) -> DataFrame:
    """sources with `from_date`, the start of the last good harvest; null is from the beginning."""
    if full:
        return sources.withColumn("from_date", F.lit(None).cast("string"))
    return sources.join(state.select("source_id", F.col("last_harvest_started").alias("from_date")), "source_id", "left")
