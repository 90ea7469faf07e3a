"""Substring dedup by content-defined chunks.

A gear hash h = (h << 1) + GEAR[byte] rolls over a text's UTF-8 bytes; in 32 bits it forgets all but the last 32 bytes. A chunk
ends where the hash's top bits are zero, no sooner than MIN_BYTES after the last cut and only between characters. An insertion
moves bytes but not the cuts around it, so repeated passages fall into the same chunks wherever they stand. Chunks are told apart
by 96 bits of digest: among 10^13 chunks a chance collision is to be expected in about one corpus of 1,500. Of every chunk the first place
(least doc_id, then least offset) is kept. Later places are removed when they stand in an unbroken run of such places of at least
MIN_RUN bytes, so short chunks that chance to be equal stay; min_run = 0 removes every later chunk.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import arrow_map, clashing, fresh, pressed, text_bytes, unpressed, written

MIN_BYTES = 16
MASK_BITS = 4
MIN_RUN = 100
#: The gear table: one 32-bit number a byte value, drawn by hashing the value.
GEAR = np.array([xxhash.xxh32_intdigest(bytes([b]), 7) for b in range(256)], np.uint32)


def cuts(data: bytes, min_bytes: int = MIN_BYTES, mask_bits: int = MASK_BITS) -> list[int]:
    """Ends of the chunks of data; the last is len(data)."""
    n = len(data)
    if n <= min_bytes:
        return [n] if n else []
    raw = np.frombuffer(data, np.uint8)
    h = GEAR[raw]
    for k in (1, 2, 4, 8, 16):  # doubling: after these, h[i] covers the 32 bytes up to i
        longer = h.copy()
        longer[k:] += h[:-k] << np.uint32(k)
        h = longer
    at = np.flatnonzero(h >> np.uint32(32 - mask_bits) == 0) + 1
    at = at[(at < n) & (at >= min_bytes)]
    at = at[(raw[at] & 0xC0) != 0x80]
    found, last = [], 0
    for x in at.tolist():
        if x - last >= min_bytes:
            found.append(x)
            last = x
    return [*found, n]


def digests(data: bytes, ends: list[int]) -> list[bytes]:
    digest, at, found = xxhash.xxh3_128_digest, 0, []
    for e in ends:
        found.append(digest(data[at:e])[:12])
        at = e
    return found


def chunked(documents: DataFrame, min_bytes: int = MIN_BYTES, mask_bits: int = MASK_BITS) -> DataFrame:
    """(d1 long, d2 int, doc_id, at int): every chunk of every whole text, once a text: its first place there."""

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        all_digests, counts, starts = [], [], []
        for data in text_bytes(batch.column(1)):
            ends = cuts(data, min_bytes, mask_bits)
            firsts: dict[bytes, int] = {}
            for d, at in zip(digests(data, ends), [0, *ends], strict=False):
                firsts.setdefault(d, at)
            counts.append(len(firsts))
            all_digests += firsts
            starts += firsts.values()
        ids = batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), counts)))
        told = np.frombuffer(b"".join(all_digests), np.dtype([("d1", "<i8"), ("d2", "<i4")]))
        return pa.RecordBatch.from_arrays([pa.array(told["d1"].copy()), pa.array(told["d2"].copy()), ids, pa.array(starts, pa.int32())], names=["d1", "d2", "doc_id", "at"])

    return arrow_map(clashing(documents, "doc_id", "text").where("doc_id is not null"), of, "d1 long, d2 int, doc_id long, at int")


def repeats(documents: DataFrame, min_bytes: int = MIN_BYTES, mask_bits: int = MASK_BITS) -> DataFrame:
    """(doc_id, later array<struct<at, d1>>): the chunks of a document that stand in an earlier one.

    First documents are found by a pre-aggregated min, so a chunk that a third of all documents hold costs one row a task, and are
    written: the join that follows has a plain exchange on either side, whose hot keys Spark splits. A document's list is bounded by
    its own length.
    """
    chunks = chunked(documents, min_bytes, mask_bits)
    ends = chunks.groupBy("d1", "d2").agg(F.min("doc_id").alias("f_doc"), F.max("doc_id").alias("l_doc")).where("f_doc <> l_doc")
    firsts = written(ends.select("d1", "d2", "f_doc"), "chunk-firsts")
    later = chunks.join(firsts, ["d1", "d2"]).where("doc_id <> f_doc")
    return later.groupBy("doc_id").agg(F.collect_list(F.struct("at", "d1")).alias("later"))


def removed_runs(data: bytes, later: set[tuple[int, int]], min_run: int, min_bytes: int, mask_bits: int) -> list[tuple[int, int]]:
    """Maximal runs, at least min_run bytes long, of chunks that are in `later` (offset, first half of the digest) or stand in this text
    before. The digests are compared again with this very text, so that rows that share a doc_id but not a text are told apart."""
    ends = cuts(data, min_bytes, mask_bits)
    runs: list[tuple[int, int]] = []
    seen: set[bytes] = set()
    at = 0
    for e, d in zip(ends, digests(data, ends), strict=True):
        if d in seen or (later and (at, int.from_bytes(d[:8], "little", signed=True)) in later):
            if runs and runs[-1][1] == at:
                runs[-1] = (runs[-1][0], e)
            else:
                runs.append((at, e))
        seen.add(d)
        at = e
    return [r for r in runs if r[1] - r[0] >= min_run]


def dedup(documents: DataFrame, min_run: int = MIN_RUN, min_bytes: int = MIN_BYTES, mask_bits: int = MASK_BITS) -> DataFrame:
    """documents with `text` cut and `dedup` struct<n_bytes long, n_removed long, spans array<struct<at, to>>> added (byte offsets).

    Null texts stay null and count as empty; rows without doc_id lose only what repeats within them; rows of one doc_id are one document
    to one another, so repeated rows are cut alike and keep what only they hold; an empty table gives no rows; a text of any length is
    chunked whole; columns besides doc_id and text are carried along.
    """
    spans_kind = pa.list_(pa.struct([("at", pa.int32()), ("to", pa.int32())]))

    @F.arrow_udf("struct<text:string,n_bytes:bigint,n_removed:bigint,spans:array<struct<at:int,to:int>>>")
    def cut(zs: pa.Array, later: pa.Array) -> pa.Array:
        texts, sizes, removed, spans = [], [], [], []
        for z, chunks in zip(zs, later, strict=True):
            data = unpressed(z.as_py())
            known = {(x["at"], x["d1"]) for x in chunks.as_py() or ()}
            found = removed_runs(data, known, min_run, min_bytes, mask_bits) if data else []
            kept, at = [], 0
            for a, b in found:
                kept.append(data[at:a])
                at = b
            texts.append(None if data is None else b"".join([*kept, data[at:]]).decode())
            sizes.append(len(data or b""))
            removed.append(sum(b - a for a, b in found))
            spans.append([{"at": a, "to": b} for a, b in found])
        return pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, spans_kind)], ["text", "n_bytes", "n_removed", "spans"])

    names = [c for c in documents.columns if c != "dedup"]
    doc, later, done, z = (fresh(documents, n) for n in ("__doc", "__later", "__cut", "__z"))
    marks = repeats(documents, min_bytes, mask_bits).select(F.col("doc_id").alias(doc), F.col("later").alias(later))
    small = documents.select(*[F.col(f"`{c}`") for c in names if c != "text"], pressed("text", documents).alias(z))
    both = small.join(marks, F.col("doc_id") == F.col(doc), "left").withColumn(done, cut(z, later))
    kept = [F.col(f"{done}.text").alias(c) if c == "text" else F.col(f"`{c}`") for c in names]
    return both.select(*kept, F.struct(F.col(f"{done}.n_bytes"), F.col(f"{done}.n_removed"), F.col(f"{done}.spans")).alias("dedup"))


def op10_chunk_dedup(spark, sf_dir: str) -> DataFrame:
    found = dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.col("dedup.n_bytes").alias("n_bytes"), F.col("dedup.n_removed").alias("n_removed"), F.size("dedup.spans").cast("long").alias("n_spans"), "text")
