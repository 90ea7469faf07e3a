"""Benchmark decontamination by spaced seeds.

A seed reads words at fixed places and ignores those between, so a substituted word there does not hide a passage. The three SEEDS of
six words are lossless for the rule below in items of 16 words and more: wherever 4 of 20 aligned words differ, one of them fits
between the differences. Items of at most SHORT_WORDS words are sought by three seeds of three words, those of one or two words by
all their words.

1. The seed hashes of all items are a table. Their bits are gathered in a filter of at most 2^MOST_BITS bits, which goes to all tasks.
2. Every place of every document is hashed by the same seeds. Places that pass the filter are kept with the words around them, WINDOW on
   either side; places close to one another share a segment. That is all that leaves the scan, so documents are read once however
   large the benchmark is.
3. Training and test hashes are joined, a row for each segment, item and hash however often they hold it. A hit puts the segment's
   words over the item on its diagonal, the place in the document less that in the item; segment and item meet by further joins and the
   aligned words are compared.

A document holds an item if WINDOW aligned words (all of a shorter item), at least SIMILARITY of them equal, are found. Items of fewer
than `least` words are left out; a least of 1 leaves out none.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import arrow_map, clashing, fresh, written

SEEDS = ((0, 1, 2, 3, 5, 6), (0, 1, 2, 4, 8, 9), (0, 4, 5, 8, 10, 11))
SHORT = ((0, 1, 2), (0, 1, 3), (0, 2, 3))
TINY = ((0,), (0, 1))
#: All seeds; a seed's number is its place here.
ALL = SEEDS + SHORT + TINY
SHORT_WORDS = 15
WINDOW = 20
SIMILARITY = 0.8
#: Words of the shortest item that is sought: shorter ones can't be told from common phrases.
LEAST = 5
#: Bits of the filter a seed hash gets, and the most bits of the filter as a power of two (16 MB).
BITS_EACH = 32
MOST_BITS = 27
#: Bits of its coarse copy, which fits a core's cache.
COARSE_BITS = 22
#: Places in a segment times places in an item of one hash, beyond which all diagonals between the outermost are compared.
MOST_EACH = 64
#: Places of the longest seed.
PLACES = 6
WORD = re.compile(r"\w+")
MULTIPLIERS = np.array([xxhash.xxh64_intdigest(b"place %d" % k) | 1 for k in range(8)], np.uint64)


class _Hashes(dict):
    """word -> 64-bit hash; starts afresh when full, which bounds it."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def words(text: str | None, known: _Hashes) -> np.ndarray:
    found = WORD.findall((text or "").lower())
    return np.fromiter(map(known.__getitem__, found), np.uint64, len(found))


def scaled(tokens: np.ndarray) -> list[np.ndarray]:
    """The words' hashes times each place's multiplier, made once for all seeds."""
    return [tokens * m for m in MULTIPLIERS[:PLACES]]


def seeded(products: list[np.ndarray], seed: int) -> np.ndarray:
    """The seed's hash at every place it fits."""
    at = ALL[seed]
    n = len(products[0]) - at[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, int(MULTIPLIERS[7]) * (seed + 1) & 0xFFFFFFFFFFFFFFFF, np.uint64)
    for x, k in zip(products, at, strict=False):
        h += x[k : k + n]
    h ^= h >> np.uint64(32)
    return h * MULTIPLIERS[6]


def seeds_for(n: int) -> range:
    """Numbers of the seeds that find an item of n words."""
    if n > SHORT_WORDS:
        return range(len(SEEDS))
    if n > len(TINY):
        return range(len(SEEDS), len(SEEDS) + len(SHORT))
    return range(len(ALL) - len(TINY) + n - 1, len(ALL) - len(TINY) + n)


def run_starts(*keys: np.ndarray) -> np.ndarray:
    """Where runs of rows equal in all keys begin."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def seed_table(items: DataFrame, least: int) -> DataFrame:
    """(h, seed, ik, places): every seed of every item (ik: hash of its number and text, text), a row for each hash."""

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        known, hashes, numbers, owners, places, ends = _Hashes(), [], [], [], [], []
        for k, text in enumerate(batch.column(1)):
            tokens = words(text.as_py(), known)
            products = scaled(tokens)
            for seed in seeds_for(len(tokens)) if len(tokens) >= max(1, least) else ():
                h = seeded(products, seed)
                order = np.argsort(h, kind="stable")
                starts = run_starts(h[order])
                hashes.append(h[order][starts])
                numbers += [seed] * len(starts)
                owners += [k] * len(starts)
                places.append(order.astype(np.int32))
                ends.append(np.diff(starts, append=len(h)))
        joined = [np.concatenate(x) if x else np.zeros(0, kind) for x, kind in ((hashes, np.uint64), (places, np.int32), (ends, np.int64))]
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(joined[2]))), pa.int32()), pa.array(joined[1]))
        return pa.RecordBatch.from_arrays([pa.array(joined[0].view(np.int64)), pa.array(numbers, pa.int32()), batch.column(0).take(pa.array(owners, pa.int64())), lists], names=["h", "seed", "ik", "places"])

    return arrow_map(items.select("ik", "text"), of, "h long, seed int, ik long, places array<int>")


def seed_filter(seeds: DataFrame) -> tuple[np.ndarray, int]:
    """(bits as bytes, their number as a power of two) with two bits set for every hash: the upper and the lower end of it."""
    bits = min(MOST_BITS, max(16, math.ceil(math.log2(BITS_EACH * max(1, seeds.count())))))
    ends = F.array(F.shiftrightunsigned("h", 64 - bits), F.col("h").bitwiseAND(F.lit((1 << bits) - 1)))
    set_ = seeds.select(F.explode(ends).alias("i")).groupBy(F.shiftright("i", 3).alias("at")).agg(F.bit_or(F.expr("shiftleft(1, cast(i & 7 as int))")).alias("b")).toArrow()  # at most 2^(MOST_BITS - 3) rows
    out = np.zeros(1 << (bits - 3), np.uint8)
    out[set_.column("at").to_numpy()] = set_.column("b").to_numpy()
    return out, bits


def passing(h: np.ndarray, coarse: np.ndarray, fine: np.ndarray, bits: int) -> np.ndarray:
    """Places whose hash passes the filter."""
    at = np.flatnonzero(coarse[h >> np.uint64(64 - min(bits, COARSE_BITS))])
    for end in (lambda x: x >> np.uint64(64 - bits), lambda x: x & np.uint64((1 << bits) - 1)):
        i = end(h[at])
        at = at[(fine[i >> np.uint64(3)] >> (i & np.uint64(7)).astype(np.uint8)) & 1 != 0]
    return at


def segments(docs: DataFrame, sent, bits: int, used: list[int]) -> DataFrame:
    """(sk, doc_id, th, at, tokens binary, hits array<struct<h, ps>>): runs of a document's words around places that pass the filter; sk
    is a hash of the other columns."""
    state: dict = {}

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not state:
            fine = np.frombuffer(sent.value, np.uint8)
            every = np.unpackbits(fine, bitorder="little")
            state["coarse"] = every.reshape(1 << min(bits, COARSE_BITS), -1).any(axis=1)
            state["fine"], state["known"] = fine, _Hashes()
        keys, rows, ats, texts, hashes, places, counts = [], [], [], [], [], [], []
        for k, (doc, th, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True)):
            tokens = words(text.as_py(), state["known"])
            products = scaled(tokens)
            found = []
            for seed in used:
                h = seeded(products, seed)
                at = passing(h, state["coarse"], state["fine"], bits)
                if len(at):
                    found.append((at, h[at]))
            if not found:
                continue
            at, h = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.argsort(at, kind="stable")
            at, h = at[order], h[order]
            places.append(at)
            hashes.append(h)
            edges = (np.flatnonzero(np.diff(at) > 2 * WINDOW) + 1).tolist()
            for start, end in zip([0, *edges], [*edges, len(at)], strict=True):
                low = max(0, int(at[start]) - WINDOW)
                piece = tokens[low : int(at[end - 1]) + WINDOW].tobytes()
                rows.append(k)
                ats.append(low)
                texts.append(piece)
                counts.append(end - start)
                keys.append(xxhash.xxh64_intdigest(piece + b"%d %d %d" % (low, th, doc if doc is not None else -1)))
        at = pa.array(rows, pa.int64())
        sk = pa.array(np.array(keys, np.uint64).view(np.int64))
        h, p = np.concatenate([*hashes, np.zeros(0, np.uint64)]), np.concatenate([*places, np.zeros(0, np.int64)]).astype(np.int32)
        owner = np.repeat(np.arange(len(counts)), np.array(counts, np.int64))
        order = np.lexsort((h, owner))
        h, p, owner = h[order], p[order], owner[order]
        starts = run_starts(owner, h)
        ps = pa.ListArray.from_arrays(pa.array(np.append(starts, len(h)), pa.int32()), pa.array(p))
        flat = pa.StructArray.from_arrays([pa.array(h[starts].view(np.int64)), ps], ["h", "ps"])
        offsets = np.concatenate(([0], np.cumsum(np.bincount(owner[starts], minlength=len(counts)))))
        return pa.RecordBatch.from_arrays([sk, batch.column(0).take(at), batch.column(1).take(at), pa.array(ats, pa.int32()), pa.array(texts, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)], names=["sk", "doc_id", "th", "at", "tokens", "hits"])

    return arrow_map(docs, of, "sk long, doc_id long, th long, at int, tokens binary, hits array<struct<h:long,ps:array<int>>>")


def meetings(found: DataFrame, seeds: DataFrame) -> DataFrame:
    """(sk, ik, ds): a row for each hash that a segment and an item share, with diagonals that hold all those it names."""
    hits = found.select("sk", F.explode("hits").alias("x")).select("sk", "x.h", "x.ps").distinct()
    named = F.array_distinct(F.flatten(F.transform("ps", lambda p: F.transform("places", lambda q: p - q))))
    between = F.sequence(F.array_min("ps") - F.array_max("places"), F.array_max("ps") - F.array_min("places"))
    few = F.size("ps").cast("long") * F.size("places") <= MOST_EACH
    return hits.join(seeds.select("h", "ik", "places"), "h").select("sk", "ik", F.when(few, named).otherwise(between).alias("ds"))


def aligned(tokens: np.ndarray, item: np.ndarray, at: int, diagonals: list[int]) -> tuple[int, int, int] | None:
    """(equal words, first word, aligned words) of the best window in which a segment that begins at word `at` holds the item."""
    best = None
    need = min(WINDOW, len(item))
    for d in sorted(diagonals):
        start, stop = max(0, at - d), min(len(item), at + len(tokens) - d)
        if stop - start < need:
            continue
        equal = np.concatenate(([0], np.cumsum(tokens[d + start - at : d + stop - at] == item[start:stop])))
        within = equal[need:] - equal[:-need]
        k = int(within.argmax())
        if within[k] >= math.ceil(SIMILARITY * need - 1e-9) and (best is None or (int(within[k]), -(d + start + k)) > (best[0], -best[1])):
            best = (int(within[k]), d + start + k, need)
    return best


def _overlaps(documents: DataFrame, benchmark: DataFrame, least: int) -> DataFrame:
    """(doc_id, th, item_id, similarity, first_word, aligned); th is the hash of the document's text."""
    spark = documents.sparkSession
    items = written(clashing(benchmark, "item_id", "text").where("text is not null").distinct().withColumn("ik", F.xxhash64("item_id", "text")), "seed-items")
    docs = clashing(documents, "doc_id", "text").where("text is not null").select("doc_id", F.xxhash64("text").alias("th"), "text")
    seeds = written(seed_table(items, least), "seed-hashes")
    used = sorted(r.seed for r in seeds.select("seed").distinct().collect())  # at most one row a seed
    fine, bits = seed_filter(seeds)
    found = written(segments(docs, spark.sparkContext.broadcast(fine.tobytes()), bits, used), "seed-segments")
    met = meetings(found, seeds).groupBy("sk", "ik").agg(F.array_distinct(F.flatten(F.collect_set("ds"))).alias("diagonals"))
    pairs = met.join(found.drop("hits"), "sk").join(items.select("ik", "item_id", F.col("text").alias("item")), "ik")

    def verified(batch: pa.RecordBatch) -> pa.RecordBatch:
        known, at, best = _Hashes(), [], []
        for k in range(batch.num_rows):
            one = aligned(np.frombuffer(batch.column("tokens")[k].as_py(), np.uint64), words(batch.column("item")[k].as_py(), known), batch.column("at")[k].as_py(), batch.column("diagonals")[k].as_py())
            if one is not None:
                at.append(k)
                best.append(one)
        rows = pa.array(at, pa.int64())
        equal, first, need = ([b[i] for b in best] for i in range(3))
        columns = [*(batch.column(c).take(rows) for c in ("doc_id", "th", "item_id")), pa.array([e / n for e, n in zip(equal, need, strict=True)], pa.float64()), pa.array(first, pa.int32()), pa.array(need, pa.int32())]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "th", "item_id", "similarity", "first_word", "aligned"])

    return arrow_map(pairs, verified, "doc_id long, th long, item_id long, similarity double, first_word int, aligned int")


def overlaps(documents: DataFrame, benchmark: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, item_id, similarity double, first_word int, aligned int): an item that a document holds, with its best window.

    Words are runs of letters, digits and underscores, lower-cased. Null and empty texts hold nothing; repeated rows of documents or
    items give one row, as do rows that share a doc_id but not a text; of windows equally alike the first counts; texts and items of
    any length are read whole; empty tables give no rows; further columns are ignored.
    """
    best = F.max_by(F.struct("similarity", "first_word", "aligned"), F.struct("similarity", -F.col("first_word"), "aligned")).alias("b")
    return _overlaps(documents, benchmark, least).groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.*")


def clean(documents: DataFrame, benchmark: DataFrame, least: int = LEAST) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns; rows without doc_id stay; rows that share a doc_id are judged
    each by its own text."""
    doc, th = fresh(documents, "__doc"), fresh(documents, "__th")
    bad = written(_overlaps(documents, benchmark, least).select(F.col("doc_id").alias(doc), F.col("th").alias(th)).distinct(), "seed-found")
    return documents.join(bad, (F.col("doc_id") == F.col(doc)) & (F.xxhash64("text") == F.col(th)), "left_anti")


def op3_decontaminate(spark, sf_dir: str) -> DataFrame:
    table = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return overlaps(table("documents"), table("benchmark"))
