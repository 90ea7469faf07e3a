"""Labels from an external batch model: requests as JSON lines, tolerant reading of answers, guarded application."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.schema import OTHER

ANSWER = "struct<key:string,response:struct<candidates:array<struct<content:struct<parts:array<struct<text:string>>>>>>>"


def unclassified(records: DataFrame, limit: int | None = None) -> DataFrame:
    fields = ("title", "authors", "abstract", "subjects", "publisher", "source_name")
    rows = records.where(F.col("discipline") == OTHER).select("oai_identifier", *[F.coalesce(c, F.lit("")).alias(c) for c in fields], F.coalesce("year", F.lit(0)).alias("year"))
    return rows if limit is None else rows.orderBy("oai_identifier").limit(limit)


def prompt(labels: list[str]) -> Column:
    """The question for one record; every field is cut to its share."""
    cut = lambda c, n: F.substring(c, 1, n)
    or_dash = lambda c: F.when(c == "", "—").otherwise(c)
    year = F.when(F.col("year") == 0, "—").otherwise(F.col("year").cast("string"))
    return F.concat(
        F.lit(f"Disciplines possibles : {', '.join(labels)}\n\nTitre : "), cut("title", 300), F.lit("\nAuteur·rice·s : "), cut("authors", 200), F.lit("\nUniversité : "), F.col("source_name"), F.lit("  ·  Année : "), year,
        F.lit("\nMots-clés (dc:subject) : "), or_dash(cut("subjects", 300)), F.lit("\nÉditeur / département (dc:publisher) : "), or_dash(cut("publisher", 200)), F.lit("\nRésumé : "), or_dash(cut("abstract", 800)), F.lit("\n\nChoisis la discipline la plus pertinente."),
    )


def requests(rows: DataFrame, labels: list[str], instruction: str = "") -> DataFrame:
    """(value): one JSON line a record."""
    part = lambda c: F.array(F.struct(c.alias("text")))
    schema = F.struct(F.lit("OBJECT").alias("type"), F.struct(F.struct(F.lit("STRING").alias("type"), F.array(*map(F.lit, labels)).alias("enum")).alias("discipline")).alias("properties"), F.array(F.lit("discipline")).alias("required"))
    config = F.struct(F.lit("application/json").alias("responseMimeType"), schema.alias("responseSchema"), F.lit(0.0).alias("temperature"), F.struct(F.lit(0).alias("thinkingBudget")).alias("thinkingConfig"), F.lit(128).alias("maxOutputTokens"))
    request = F.struct(F.array(F.struct(F.lit("user").alias("role"), part(prompt(labels)).alias("parts"))).alias("contents"), F.struct(part(F.lit(instruction)).alias("parts")).alias("systemInstruction"), config.alias("generationConfig"))
    return rows.select(F.to_json(F.struct(F.col("oai_identifier").alias("key"), request.alias("request"))).alias("value"))


def answers(lines: DataFrame) -> DataFrame:
    """(key, discipline) from answer lines; malformed lines and answers are left out."""
    parsed = lines.where(F.trim("value") != "").select(F.from_json("value", ANSWER, {"mode": "PERMISSIVE"}).alias("a"))
    texts = F.flatten(F.transform("a.response.candidates", lambda c: F.coalesce(c["content"]["parts"], F.array().cast("array<struct<text:string>>"))))
    first = F.get(F.filter(texts, lambda p: p["text"].isNotNull()), 0)["text"]
    return parsed.select(F.col("a.key").alias("key"), F.get_json_object(first, "$.discipline").alias("discipline")).where("key is not null and discipline is not null")


def answered(rows: DataFrame, labels: list[str], client: Callable[[list[str]], list[str]]) -> DataFrame:
    """(key, discipline) from a client called with the prompts of one batch at a time, on the executors."""

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"key": b["key"], "discipline": client(b["prompt"].tolist())})

    return rows.select(F.col("oai_identifier").alias("key"), prompt(labels).alias("prompt")).mapInPandas(ask, "key string, discipline string")


class BatchJob:
    """The life of a batch: preview, submit, poll, fetch. `client` has submit(lines) -> name, state(name) -> str and answers(name) -> lines;
    requests are handed over as they are read, never as a whole list. Answer lines become a table through `to_table`."""

    DONE, FAILED = frozenset(("succeeded", "JOB_STATE_SUCCEEDED")), frozenset(("failed", "cancelled", "expired", "JOB_STATE_FAILED", "JOB_STATE_CANCELLED", "JOB_STATE_EXPIRED"))

    def __init__(self, client, labels: list[str], instruction: str = "", sleep: Callable[[float], None] = time.sleep):
        self.client, self.labels, self.instruction, self.sleep = client, labels, instruction, sleep

    def preview(self, records: DataFrame, n: int = 3) -> tuple[int, list[str]]:
        """(records that would be asked about, the first n requests)."""
        rows = unclassified(records)
        return rows.count(), [r.value for r in requests(rows.orderBy("oai_identifier").limit(n), self.labels, self.instruction).collect()]  # n rows

    def submit(self, records: DataFrame, limit: int | None = None) -> str:
        return self.client.submit(r.value for r in requests(unclassified(records, limit), self.labels, self.instruction).toLocalIterator())

    def poll(self, name: str, every: float = 30.0, tries: int = 2880) -> str:
        """The state in which the batch ended; an error if it failed or did not end."""
        for _ in range(tries):
            state = self.client.state(name)
            if state in self.DONE:
                return state
            if state in self.FAILED:
                raise RuntimeError(f"{name}: {state}")
            self.sleep(every)
        raise TimeoutError(name)

    def fetch(self, name: str, records: DataFrame, to_table: Callable[[Iterable[str]], DataFrame]) -> DataFrame:
        """records with the batch's labels."""
        return apply(records, answers(to_table(self.client.answers(name))), self.labels)

    def run(self, records: DataFrame, to_table: Callable[[Iterable[str]], DataFrame], every: float = 30.0) -> DataFrame:
        name = self.submit(records)
        self.poll(name, every)
        return self.fetch(name, records, to_table)


def apply(records: DataFrame, updates: DataFrame, labels: list[str]) -> DataFrame:
    """records with the answered labels, tagged "llm", whatever was there; labels that are not on the list are ignored."""
    good = updates.where(F.col("discipline").isin(*labels)).groupBy("key").agg(F.max("discipline").alias("__new"))
    both = records.join(good, records["oai_identifier"] == good["key"], "left").drop("key")
    new = F.col("__new").isNotNull()
    return both.withColumn("discipline", F.coalesce("__new", "discipline")).withColumn("discipline_source", F.when(new, "llm").otherwise(F.col("discipline_source"))).drop("__new")
