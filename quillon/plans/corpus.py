"""A record-shaped view of the driver's documents, and the same view as DuckDB SQL: the first line is the title, the whole text the abstract."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")  # noqa: E741
    quality = l.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    id_ = F.col("doc_id")
    return d.join(quality, "doc_id", "left").select(
        id_.alias("doc"),
        F.concat(F.lit("oai:corpus:"), id_.cast("string")).alias("oai_identifier"),
        F.col("source").alias("source_id"),
        F.concat(F.lit("Repository "), F.col("source")).alias("source_name"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.concat(F.lit("src"), (id_ % 7).cast("string"), F.lit("; a"), (id_ % 13).cast("string")).alias("authors"),
        F.concat(F.lit("Guide, B"), (id_ % 5).cast("string")).alias("advisors"),
        F.col("text").alias("abstract"),
        F.concat(F.lit("lang "), F.col("lang"), F.lit("; group "), (id_ % 9).cast("string")).alias("subjects"),
        F.when(id_ % 11 != 0, (1950 + id_ % 75).cast("int")).alias("year"),
        F.when(F.col("quality") == 1, "thesis").when(F.col("quality") == 0, "memoire").alias("type"),
        F.col("lang").alias("language"),
        F.concat(F.lit("press "), (id_ % 3).cast("string")).alias("publisher"),
        F.concat(F.lit("https://repository.example/id/"), id_.cast("string")).alias("url"),
        F.when(F.col("lang") == "en", "English").when(F.col("lang") == "fr", "French").when(F.col("lang") == "de", "German").alias("discipline"),
    )


CORPUS = """corpus AS (
  SELECT d.doc_id AS doc, 'oai:corpus:' || d.doc_id AS oai_identifier, source AS source_id, 'Repository ' || source AS source_name,
    split_part(text, chr(10), 1) AS title, 'src' || (d.doc_id % 7) || '; a' || (d.doc_id % 13) AS authors,
    'Guide, B' || (d.doc_id % 5) AS advisors, text AS abstract, 'lang ' || lang || '; group ' || (d.doc_id % 9) AS subjects,
    CASE WHEN d.doc_id % 11 <> 0 THEN CAST(1950 + d.doc_id % 75 AS INTEGER) END AS year,
    CASE WHEN quality = 1 THEN 'thesis' WHEN quality = 0 THEN 'memoire' END AS type, lang AS language, 'press ' || (d.doc_id % 3) AS publisher,
    'https://repository.example/id/' || d.doc_id AS url,
    CASE lang WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French' WHEN 'de' THEN 'German' END AS discipline
  FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l ON d.doc_id = l.doc_id)"""
