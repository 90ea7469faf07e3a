"""Exact repeats of SPAN bytes by prefix-free parsing, distributed.

A rolling hash over W bytes triggers a cut where it is the least of Q in a row, so cuts depend on the text around them alone. Any
SPAN-byte string contains its own cut, the least of its first Q, wherever it stands; two equal strings have theirs at the same distance.
Texts are so parsed into phrases: a string is a phrase's suffix (what stands before its cut) and the parse from there.

1. Dictionary of contexts: of every phrase the hash of the bytes that all its strings share after the cut (`key`) and of all bytes
   its strings cover (`whole`). A phrase whose key is nowhere else holds no repeat; one whose whole is elsewhere is covered fully.
   Nearly all text is settled here, at one row a phrase (some 50 bytes).
2. What is left are the phrases at the edges of repeats. For each key, their suffixes and continuations are put in corpus order:
   for every distance before the cut, strings are sorted by phrase suffix, then by the parse that follows; equal ones are
   neighbours. Only the first SPAN bytes of the order matter, so no order of the whole corpus is ever made.
3. The start places found are turned into covered bytes and cut from the texts.

Keys with over CROWD different phrases at the edges don't go to one task: their strings are hashed one by one and counted, which Spark
pre-aggregates. Texts are told apart by 96 bits of hash (th, tk), phrases by 128 (key, whole) and strings of crowded keys by 64.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import arrow_map, clashing, pressed, text_bytes, written

SPAN = 200
W = 16
Q = 96
CROWD = 20_000
#: String starts of a text parsed at a time; bounds the memory a very long text takes.
STEP = 1 << 21
GEAR = np.array([xxhash.xxh64_intdigest(bytes([b]), 11) for b in range(256)], np.uint64)
PLACE_BITS = np.uint64(24)


def phrases(data: bytes, span: int = SPAN) -> Iterator[tuple[int, int, int]]:
    """(cut, low, high): the strings that start at low..high have their cut there. Every start of a whole string is in one phrase."""
    raw = np.frombuffer(data, np.uint8)
    for base in range(0, len(data) - span + 1, STEP):
        part = raw[base : base + STEP + span - 1]
        starts = len(part) - span + 1
        h = GEAR[part]
        for k in (1, 2, 4, 8):  # doubling: h[i] covers the W bytes from i
            h = h[:-k] * np.uint64(0x9E3779B97F4A7C15) + (h[k:] ^ (h[k:] >> np.uint64(31)))
        v = (h >> PLACE_BITS << PLACE_BITS) | np.arange(len(h), dtype=np.uint64)
        for k in (1, 2, 4, 8, 16, 32):
            v = np.minimum(v[:-k], v[k:])
        v = np.minimum(v[:-32], v[32:])  # least of Q = 64 + 32
        cut = (v[:starts] & np.uint64((1 << 24) - 1)).astype(np.int64)
        low = np.concatenate(([0], np.flatnonzero(cut[1:] != cut[:-1]) + 1))
        high = np.concatenate((low[1:] - 1, [starts - 1]))
        yield from zip((cut[low] + base).tolist(), (low + base).tolist(), (high + base).tolist(), strict=True)


def _place(cut: int, low: int, high: int) -> int:
    return cut << 16 | (cut - low) << 8 | (cut - high)


def _parts(place: int) -> tuple[int, int, int]:
    cut = place >> 16
    return cut, cut - (place >> 8 & 255), cut - (place & 255)


def shared(span: int) -> int:
    """Bytes after a cut that all strings with this cut share."""
    return span - Q + 1


def tallied(texts: DataFrame, span: int = SPAN) -> DataFrame:
    """(key, whole, n, th): phrases by what they cover, counted within each batch of texts, with the least of their texts' hashes."""
    size = shared(span)
    digest = xxhash.xxh3_64_intdigest

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, wholes, ths = [], [], []
        for th, data in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True):
            before = len(keys)
            if len(data) >= span:
                for cut, low, high in phrases(data, span):
                    keys.append(digest(data[cut : cut + size]))
                    wholes.append(digest(data[low : high + span]))
            ths += [th] * (len(keys) - before)
        k, w, t = (np.array(x, kind) for x, kind in ((keys, np.uint64), (wholes, np.uint64), (ths, np.int64)))
        order = np.lexsort((w, k))
        k, w, t = k[order], w[order], t[order]
        first = np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]) | (w[1:] != w[:-1])))) if len(k) else np.zeros(0, np.int64)
        n = np.diff(np.concatenate((first, [len(k)])))
        least = np.minimum.reduceat(t, first) if len(k) else t
        return pa.RecordBatch.from_arrays([pa.array(k[first].view(np.int64)), pa.array(w[first].view(np.int64)), pa.array(n.astype(np.int64)), pa.array(least)], names=["key", "whole", "n", "th"])

    return arrow_map(texts.select("th", "text"), of, "key long, whole long, n long, th long")


def dictionary(texts: DataFrame, span: int = SPAN) -> DataFrame:
    """(key, whole, th, tk, place): one row a phrase of every text (columns th, tk, text)."""
    n = shared(span)
    digest = xxhash.xxh3_64_intdigest

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, wholes, places, counts = [], [], [], []
        for data in text_bytes(batch.column(2)):
            before = len(keys)
            if len(data) >= span:
                for cut, low, high in phrases(data, span):
                    keys.append(digest(data[cut : cut + n]))
                    wholes.append(digest(data[low : high + span]))
                    places.append(_place(cut, low, high))
            counts.append(len(keys) - before)
        at = pa.array(np.repeat(np.arange(batch.num_rows), counts))
        as_long = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
        return pa.RecordBatch.from_arrays([as_long(keys), as_long(wholes), batch.column(0).take(at), batch.column(1).take(at), as_long(places)], names=["key", "whole", "th", "tk", "place"])

    return arrow_map(texts.select("th", "tk", "text"), of, "key long, whole long, th long, tk int, place long")


def _edges(span: int):
    """Phrases of one key, sorted by key -> (th, tk, low, high) of starts that are repeated."""
    rest = span - shared(span)

    def work(rows: list[tuple[int, int, int, bool, bytes, bytes]]) -> Iterator[tuple[int, int, int, int]]:
        """rows: (th, tk, place, settled, bytes before the cut, bytes after the shared ones)."""
        found: dict[int, list[int]] = {}
        ranges = [(p >> 8 & 255, p & 255) for _, _, p, _, _, _ in rows]
        for a in range(min(r[1] for r in ranges), max(r[0] for r in ranges) + 1):
            order = sorted((left[len(left) - a :], right[: rest - a], i) for i, ((_, _, _, _, left, right), (most, least)) in enumerate(zip(rows, ranges, strict=True)) if least <= a <= most)
            for (s1, c1, i), (s2, c2, j) in zip(order, order[1:], strict=False):
                if s1 == s2 and c1 == c2:
                    found.setdefault(i, []).append(a)
                    found.setdefault(j, []).append(a)
        for i, distances in found.items():
            th, tk, place, settled, _, _ = rows[i]
            if settled:
                continue
            cut = place >> 16
            starts = sorted({cut - a for a in distances})
            low = before = starts[0]
            for s in [*starts[1:], None]:
                if s != before + 1:
                    yield th, tk, low, before
                    low = s
                before = s

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        out: list[tuple[int, int, int, int]] = []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else [[]] * 4
            b = pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["th", "tk", "low", "high"])
            out.clear()
            return b

        for batch in batches:
            for row in zip(*[batch.column(k).to_pylist() for k in range(7)], strict=True):
                if row[0] != now:
                    if len(rows) > 1:
                        out += work(rows)
                    now, rows = row[0], []
                rows.append(row[1:])
            if len(out) > 10_000:
                yield flush()
        if len(rows) > 1:
            out += work(rows)
        yield flush()

    return run


def starts(texts: DataFrame, span: int = SPAN, crowd: int = CROWD) -> DataFrame:
    """(th, tk, low, high): ranges of places where a string of `span` bytes starts that also starts elsewhere, for texts (th, tk, text)."""
    n, rest = shared(span), span - shared(span)
    # phrases are counted by what they cover before they meet by key, so a line of all texts is a row a batch
    sums = tallied(texts, span).repartition("key").groupBy("key", "whole").agg(F.sum("n").alias("same"), F.min("th").alias("first"))
    key, edge = Window.partitionBy("key"), F.col("same") == 1
    told = sums.withColumn("c", F.sum("same").over(key)).withColumn("edges", F.count_if(edge).over(key)).withColumn("differ", F.count("*").over(key))
    told = written(told.where("c > 1 and (same > 1 or edges > 0)").drop("c"), "repeat-wholes")
    counted = dictionary(texts, span).join(told, ["key", "whole"])
    # phrases to compare: those at edges, and those of one text for each whole that they may meet
    need = edge | ((F.col("th") == F.col("first")) & (F.col("edges") > 0))
    met = written(counted.select("key", "th", "tk", "place", (F.col("same") > 1).alias("settled"), need.alias("need"), (F.col("differ") > crowd).alias("crowded")), "repeat-phrases")
    cut = F.shiftright("place", 16)
    covered = met.where("settled").select("th", "tk", (cut - F.shiftright("place", 8).bitwiseAND(F.lit(255))).alias("low"), (cut - F.col("place").bitwiseAND(F.lit(255))).alias("high")).distinct()
    asked = met.where("need").drop("need").distinct().groupBy("th", "tk").agg(F.collect_list(F.struct("key", "place", "settled", "crowded")).alias("asked"))  # a text's own phrases
    # of equal texts one goes on; most are dropped before the shuffle
    once = texts.select("th", "tk", pressed("text", texts).alias("z")).groupBy("th", "tk").agg(F.first("z").alias("z"))
    held = once.join(asked, ["th", "tk"])

    def contexts(batch: pa.RecordBatch) -> pa.RecordBatch:
        unpress = zstandard.ZstdDecompressor()
        rows = []
        for th, tk, z, phrases_ in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True):
            data = unpress.decompress(z.as_py())
            for p in phrases_:
                at, low, high = _parts(p["place"])
                if not p["crowded"]:
                    rows.append((p["key"], th, tk, p["place"], p["settled"], data[low:at], data[at + n : high + span]))
                    continue
                for i in range(low, high + 1):
                    h = xxhash.xxh3_64_intdigest(data[i : i + span])
                    rows.append((h - (1 << 64) if h >> 63 else h, th, tk, i, p["settled"], None, None))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["key", "th", "tk", "place", "settled", "left", "right"])

    rows = arrow_map(held, contexts, "key long, th long, tk int, place long, settled boolean, left binary, right binary", 100)
    rows = written(rows, "repeat-contexts")
    dealt = rows.where("left is not null").repartition("key").sortWithinPartitions("key", "th", "tk", "place")
    edges = dealt.mapInArrow(_edges(span), "th long, tk int, low long, high long")
    points = rows.where("left is null").select(F.col("key").alias("h"), "th", "tk", F.col("place").alias("i"), "settled").distinct()
    twice = points.groupBy("h").agg(F.count("*").alias("c"), F.max("settled").alias("s")).where("c > 1 or s").select("h")
    single = points.where("not settled").join(twice, "h").select("th", "tk", F.col("i").alias("low"), F.col("i").alias("high"))
    return covered.unionByName(edges).unionByName(single)


def covered_bytes(ranges: list[tuple[int, int]], span: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes that strings starting in these ranges cover."""
    runs: list[tuple[int, int]] = []
    for low, high in sorted(ranges):
        if runs and low <= runs[-1][1]:
            runs[-1] = (runs[-1][0], max(runs[-1][1], high + span))
        else:
            runs.append((low, high + span))
    return runs


KIND = pa.struct([("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])


def cut(documents: DataFrame, span: int = SPAN, crowd: int = CROWD, with_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]): documents without the bytes that a repeated string covers.

    Null texts count as empty; texts shorter than a string keep all; of repeated rows every string is repeated; an empty table gives
    no rows; further columns are ignored.
    """
    texts = clashing(documents, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit(""))).withColumn("th", F.xxhash64("text")).withColumn("tk", F.hash("text"))
    ranges = starts(texts.select("th", "tk", "text"), span, crowd).groupBy("th", "tk").agg(F.collect_list(F.struct("low", "high")).alias("ranges"))

    @F.arrow_udf("struct<n_bytes:bigint,n_removed:bigint,n_spans:bigint,kept_sha256:string,kept:binary>")
    def kept(zs: pa.Array, lists: pa.Array) -> pa.Array:
        unpress, out = zstandard.ZstdDecompressor(), []
        for z, found in zip(zs, lists, strict=True):
            data = unpress.decompress(z.as_py())
            runs = covered_bytes([(r["low"], r["high"]) for r in found.as_py()], span) if found.is_valid else []
            parts, at = [], 0
            for a, b in runs:
                parts.append(data[at:a])
                at = b
            rest = b"".join([*parts, data[at:]])
            out.append({"n_bytes": len(data), "n_removed": len(data) - len(rest), "n_spans": len(runs), "kept_sha256": hashlib.sha256(rest).hexdigest(), "kept": rest if with_text else None})
        return pa.array(out, KIND)

    both = texts.select("doc_id", "th", "tk", pressed("text", texts).alias("z")).join(ranges, ["th", "tk"], "left").select("doc_id", kept("z", "ranges").alias("k"))
    return both.select("doc_id", "k.n_bytes", "k.n_removed", "k.n_spans", "k.kept_sha256", *(["k.kept"] if with_text else []))


def op5_repeats(spark, sf_dir: str) -> DataFrame:
    return cut(spark.read.parquet(f"{sf_dir}/documents.parquet"))
