"""License scans by diagonal voting, in DataFrame functions alone.

Every K words in a row of a document are hashed and joined to the places where license templates hold the same K words. A hit votes
for its diagonal, the place in the document less that in the template. Votes are counted per document, template and diagonal,
diagonals at most SLACK apart are merged (a word put in or left out moves the rest of a notice by one), and a merged span is verified
by the share of the template's K-grams it holds and by its length. Templates are a table (label, text) of any size, of which a
small set is built in. Up to SENT of its K-grams go to all tasks, and then only hits are shuffled; a larger table is joined by hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.common import clashing, written

K = 3
SLACK = 2
COVERAGE = 0.6
#: Most K-grams of templates that are broadcast, some 50 bytes each.
SENT = 500_000

#: Opening or notice phrases of public licenses and some whole texts, in words as words() makes them.
TEMPLATES = (
    ("agpl", "gnu affero general public license"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "released under the bsd license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "creative commons attribution sharealike 4 0 international license"),
    ("cc0", "cc0 1 0 universal public domain dedication"),
    ("gpl", "licensed under the gnu general public license version 3"),
    ("gpl", "under the terms of the gnu general public license as published by the free software foundation"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "gnu lesser general public license"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("reserved", "all rights reserved"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    ),
    (
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    ),
)
#: Base phrases and their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ in single characters: Java looks these up in a table, but calls a chain of functions for ranges.
WORD = "[^" + "".join(f"\\x{c:02X}" for c in range(128) if chr(c) not in LOWER + "0123456789") + "]+"


def words(text: Column) -> Column:
    """The words of a text, A-Z in lower case; null has none. lower() is faster than translate(), but the same for ASCII alone."""
    whole = F.coalesce(text, F.lit(""))
    low = F.when(F.octet_length(whole) == F.length(whole), F.lower(whole)).otherwise(F.translate(whole, UPPER, LOWER))
    return F.regexp_extract_all(low, F.lit(WORD), F.lit(0))


def built_in(spark: SparkSession) -> DataFrame:
    """(label, text): the templates built in."""
    return spark.createDataFrame(list(TEMPLATES), "label string, text string")


def _grams() -> Column:
    n = F.size("words")
    return F.when(n >= K, F.transform(F.sequence(F.lit(0), n - K), lambda i: F.xxhash64(*[F.get(F.col("words"), i + k) for k in range(K)])))


def places(templates: DataFrame) -> DataFrame:
    """(t long, label, grams int, j int, h long): the template places. Templates of fewer than K words have none; repeated ones count once."""
    each = templates.select("label", "text").where("label is not null").distinct().select(F.xxhash64("label", "text").alias("t"), "label", words(F.col("text")).alias("words"))
    return each.select("t", "label", (F.size("words") - (K - 1)).alias("grams"), F.posexplode(_grams()).alias("j", "h"))


def _worded(documents: DataFrame) -> DataFrame:
    return clashing(documents, "doc_id", "text").select("doc_id", F.xxhash64("text").alias("th"), words(F.col("text")).alias("words"))


def spans(documents: DataFrame, templates: DataFrame | None = None) -> DataFrame:
    """(doc_id, th, label, coverage, first_word, last_word): verified template spans; th is the hash of the text."""
    known = written(places(templates if templates is not None else built_in(documents.sparkSession)), "license-places")
    sent = F.broadcast(known) if known.count() <= SENT else known
    own = _worded(documents).select("doc_id", "th", F.posexplode(_grams()).alias("i", "h"))
    hits = own.join(sent, "h").select("doc_id", "th", "t", "label", "grams", "i", "j", (F.col("i") - F.col("j")).alias("d"))
    at = ["doc_id", "th", "t", "label", "grams"]
    # a row of a document that is there more than once votes once
    votes = hits.groupBy(*at, "d").agg(F.collect_set("j").alias("js"), F.min("i").alias("low"), F.max("i").alias("high"))
    order = Window.partitionBy(*at).orderBy("d")
    new = F.coalesce((F.col("d") - F.lag("d").over(order) > SLACK).cast("int"), F.lit(0))
    merged = votes.withColumn("g", F.sum(new).over(order))
    found = merged.groupBy(*at, "g").agg(F.size(F.array_distinct(F.flatten(F.collect_list("js")))).alias("held"), F.min("low").alias("first_word"), (F.max("high") + (K - 1)).alias("last_word"))
    coverage = F.col("held") / F.col("grams")
    fits = F.col("last_word") - F.col("first_word") + 1 <= 2 * (F.col("grams") + (K - 1))
    return found.where((coverage >= COVERAGE) & fits).select("doc_id", "th", "label", coverage.alias("coverage"), "first_word", "last_word")


def _phrase(words_: Column, phrase: str) -> Column:
    """Places where the phrase's words stand consecutively; the array is walked only if it holds them all."""
    parts = phrase.split()
    last = F.size(words_) - len(parts)
    there = last >= 0
    for p in parts:
        there &= F.array_contains(words_, p)

    def stands(i: Column) -> Column:
        ok = F.get(words_, i) == parts[0]
        for k, p in enumerate(parts[1:], 1):
            ok &= F.get(words_, i + k) == p
        return ok

    return F.when(there, F.filter(F.sequence(F.lit(0), last), stands)).otherwise(F.array().cast("array<int>"))


def scan(documents: DataFrame, templates: DataFrame | None = None) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score), one row per row of documents.

    Null and empty texts have no words, no labels and score 0; repeated rows are scanned each, as are rows that share a doc_id but not
    a text; an empty table gives no rows, one of templates no labels but the base ones; texts of any length are scanned whole; further
    columns are ignored. score is the best coverage of a verified span.
    """
    base = _worded(documents)
    for k, (phrase, _) in enumerate(PHRASES):
        base = base.withColumn(f"p{k}", _phrase(F.col("words"), phrase))
    stands = [F.col(f"p{k}") for k in range(len(PHRASES))]
    every = F.concat(*stands)
    named = F.filter(F.array(*[F.when(F.size(p) > 0, F.lit(label)) for p, (_, label) in zip(stands, PHRASES, strict=True)]), lambda x: x.isNotNull())
    base = base.select("doc_id", "th", F.size("words").cast("long").alias("n_words"), F.size(every).cast("long").alias("n_base"), F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"), F.array_sort(F.array_distinct(named)).alias("own"))
    found = spans(documents, templates).groupBy(F.col("doc_id").alias("d"), F.col("th").alias("h")).agg(F.collect_set("label").alias("more"), F.max("coverage").alias("score"))
    both = base.join(found, base["doc_id"].eqNullSafe(found["d"]) & (base["th"] == found["h"]), "left")
    labels = F.array_sort(F.array_distinct(F.concat("own", F.coalesce("more", F.array().cast("array<string>")))))
    return both.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("own", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), F.round(F.coalesce("score", F.lit(0.0)), 6).alias("score"))


def op6_licenses(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _oracle() -> str:
    rows = ", ".join(f"({t}, '{label}', {len(w) - K + 1}, {j}, '{' '.join(w[j : j + K])}')" for t, (label, text) in enumerate(TEMPLATES) for w in [text.split()] for j in range(len(w) - K + 1))
    bases = " UNION ALL ".join(f"SELECT rid, pos - 1 AS i, '{label}' AS label FROM w WHERE " + " AND ".join(f"list_extract(ws, CAST(pos + {k} AS BIGINT)) = '{p}'" for k, p in enumerate(phrase.split())) for phrase, label in PHRASES)
    gram = " || ' ' || ".join(f"ws[pos + {k}]" for k in range(K))
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
w AS (SELECT rid, ws, unnest(range(1, len(ws) + 1)) AS pos FROM d),
tm(t, label, grams, j, g) AS (VALUES {rows}),
hits AS (SELECT DISTINCT rid, t, tm.label, grams, pos - 1 AS i, j, pos - 1 - j AS dg FROM w JOIN tm ON {gram} = g),
dg AS (SELECT rid, t, label, grams, dg, list(j) AS js, min(i) AS low, max(i) AS high FROM hits GROUP BY ALL),
st AS (SELECT *, CASE WHEN dg - lag(dg) OVER (PARTITION BY rid, t ORDER BY dg) > {SLACK} THEN 1 ELSE 0 END AS nw FROM dg),
gr AS (SELECT *, sum(nw) OVER (PARTITION BY rid, t ORDER BY dg ROWS UNBOUNDED PRECEDING) AS g FROM st),
sp AS (SELECT rid, label, len(list_distinct(flatten(list(js)))) / CAST(grams AS DOUBLE) AS coverage, min(low) AS f, max(high) + {K - 1} AS l, grams FROM gr GROUP BY rid, t, label, grams, g),
ok AS (SELECT rid, label, coverage FROM sp WHERE coverage >= {COVERAGE} AND l - f + 1 <= 2 * (grams + {K - 1})),
base AS ({bases}),
b AS (SELECT rid, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word FROM base GROUP BY rid),
bl AS (SELECT rid, string_agg(label, ',' ORDER BY label) AS base_labels FROM (SELECT DISTINCT rid, label FROM base) GROUP BY rid),
al AS (SELECT rid, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT rid, label FROM base UNION SELECT rid, label FROM ok) GROUP BY rid),
sc AS (SELECT rid, max(coverage) AS score FROM ok GROUP BY rid)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, round(coalesce(score, 0.0), 6) AS score
FROM d LEFT JOIN b USING (rid) LEFT JOIN bl USING (rid) LEFT JOIN al USING (rid) LEFT JOIN sc USING (rid)"""


ORACLE = _oracle()
