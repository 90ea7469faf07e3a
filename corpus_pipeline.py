"""The corpus pipeline: each stage works on all that the one before kept and is written and read again.

Part of quillon.llm; the library works without this file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import chunks, decontaminate, perplexity, pieces, simhash
from quillon.llm.common import discarded, temporary, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return perplexity.kept(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents alike in 0.8 or more of their five-word shingles one row with the smallest doc_id stays."""
    return simhash.one_of_each(docs, 0.8, 5).select(*COLUMNS)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that stand in an earlier document are cut out; a document of which nothing is left goes."""
    cut = chunks.dedup(docs.select(*COLUMNS)).where("dedup.n_removed = 0 or trim(text) <> ''")
    return cut.select("doc_id", "text", "lang", "source", F.char_length("text").cast("long").alias("n_chars"))


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their SentencePiece ids."""
    out = pieces.encode(docs.select(*COLUMNS))
    return out.select(*COLUMNS, F.col("pieces.ids").alias("ids"), F.size("pieces.ids").cast("long").alias("n_pieces"), F.col("pieces.exact").alias("exact"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("substrings", substrings), ("decontamination", benchmarks), ("encoding", encoded)]

#: Kneser-Ney scores, chunk cuts, spaced seeds and piece lattices are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with temporary(spark) as keep:  # what a stage wrote for itself goes once its result is written
            made = keep(written(stage(spark, docs, sf_dir), f"pipeline-{name}"))
        if hasattr(docs, "quillon_path"):
            discarded(spark, [docs.quillon_path])
        docs = made
    return STAGES[-1][1](spark, docs, sf_dir)
