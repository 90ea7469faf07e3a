"""Embedding near-dedup by a pivot-permutation index.

A vector is described by its NEAREST reference points (pivots), the head of its permutation. Inverted lists are kept not for single
pivots but for sets of SHARED of them: vectors meet in a list exactly when their shared-pivot count reaches SHARED, so the
count is the retrieval. Vectors that meet are verified by their cosine in double precision.

Pivots are fitted on a bounded sample of SAMPLE vectors: they are taken in hashed order, skipping any too close to one taken, so a
dense cluster does not swallow the reference points. Their number grows with the square root of the rows up to MOST_PIVOTS. Every
vector is indexed. Equal vectors are one class with a count. Lists of more than BLOCK classes are compared in pairs of blocks, so no
task holds more than two blocks. A pair that meets in several lists counts in the one of its least shared pivots.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import clashing, components, written

COSINE = 0.98
NEAREST = 6
SHARED = 3
SAMPLE = 4096
MOST_PIVOTS = 1024
APART = 0.8
BLOCK = 2000
#: Most lengths of vectors that are compared, each by pivots of its own.
LENGTHS = 100


def _valid(e: str = "embedding"):
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(e).isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(e, lambda x: x != 0)


def unit(vectors: np.ndarray) -> np.ndarray:
    v = np.asarray(vectors, np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def pivots(classes: DataFrame, dim: int, rows: int) -> np.ndarray:
    """At most MOST_PIVOTS unit vectors, chosen from at most SAMPLE."""
    sample = classes.where(F.size("embedding") == dim).orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding").collect()  # bounded by SAMPLE
    v = unit(np.array([r[0] for r in sample], np.float64))
    wanted = min(MOST_PIVOTS, max(64, 2 * math.isqrt(rows)))
    chosen = np.zeros((0, dim))
    for x in v:
        if len(chosen) == wanted:
            break
        if not len(chosen) or (chosen @ x).max() < APART:
            chosen = np.vstack((chosen, x))
    return chosen


def described(classes: DataFrame, dims: dict[int, np.ndarray], nearest: int) -> DataFrame:
    """classes with `near`: the NEAREST pivots' numbers in ascending order."""
    sent = classes.sparkSession.sparkContext.broadcast(dims)

    @F.arrow_udf("array<int>")
    def near(column: pa.Array) -> pa.Array:
        out: list = [None] * len(column)
        sizes = np.diff(column.offsets.to_numpy())
        for dim in np.unique(sizes):
            p = sent.value.get(int(dim))
            at = np.flatnonzero(sizes == dim)
            if p is None:
                continue
            flat = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            k = min(nearest, len(p))
            score = unit(flat) @ p.T
            top = np.sort(np.argpartition(-score, k - 1, axis=1)[:, :k], axis=1)
            for i, t in zip(at.tolist(), top.tolist(), strict=True):
                out[i] = t
        return pa.array(out, pa.list_(pa.int32()))

    return classes.withColumn("near", near("embedding"))


def _list_keys(shared: int):
    @F.arrow_udf("array<bigint>")
    def keys(column: pa.Array) -> pa.Array:
        out = []
        for x in column.to_pylist():
            out.append([sum(p << (16 * (shared - 1 - i)) for i, p in enumerate(c)) for c in combinations(x, min(shared, len(x)))] if x else [])
        return pa.array(out, pa.list_(pa.int64()))

    return keys


def _linked(v: np.ndarray, near: list[list[int]], key: int, shared: int, left: np.ndarray, right: np.ndarray, cosine: float) -> np.ndarray:
    """Matrix of left x right members that are linked and for which this list is the one that counts."""
    ok = v[left] @ v[right].T >= cosine
    if not ok.any():
        return ok
    mine = [key >> (16 * (shared - 1 - i)) & 0xFFFF for i in range(shared)]
    bits = [{p for p in x if p < mine[-1] and p not in mine} for x in near]
    names = {p: i for i, p in enumerate(sorted(set().union(*bits)))}
    if names:
        has = np.zeros((len(near), len(names)), np.float32)
        for r, s in enumerate(bits):
            for p in s:
                has[r, names[p]] = 1
        ok &= has[left] @ has[right].T == 0
    return ok


def _roots(links: np.ndarray) -> np.ndarray:
    """Least index reachable, for a symmetric matrix of links."""
    root = np.arange(len(links))
    links = links | np.eye(len(links), dtype=bool)
    while True:
        new = np.where(links, root[None, :], len(links)).min(axis=1)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _compare(cosine: float, shared: int):
    """Arrow rows sorted by unit of work -> per member its links in that unit and the least member it hangs together with."""

    def work(rows: dict[str, list]) -> pa.RecordBatch | None:
        ids = np.array(rows["vec_id"], np.int64)
        order = np.argsort(ids)
        ids = ids[order]
        v = unit(np.array([rows["embedding"][i] for i in order], np.float64))
        n = np.array(rows["n"], np.int64)[order]
        near = [rows["near"][i] for i in order]
        block = np.array(rows["block"])[order]
        a, b, key = rows["b1"][0], rows["b2"][0], rows["key"][0]
        width = min(shared, len(near[0]))
        left, right = np.flatnonzero(block == a), np.flatnonzero(block == b)
        ok = _linked(v, near, key, width, left, right, cosine)
        full = np.zeros((len(ids), len(ids)), bool)
        full[np.ix_(left, right)] = ok
        full |= full.T
        np.fill_diagonal(full, False)
        degree = full @ n
        at = np.flatnonzero(full.any(axis=1))
        if not len(at):
            return None
        roots = ids[_roots(full)]
        return pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(degree[at].astype(np.int64)), pa.array(roots[at])], names=["vec_id", "links", "root"])

    names = ["label", "dim", "key", "b1", "b2", "block", "vec_id", "n", "near", "embedding"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, {c: [] for c in names}
        for batch in batches:
            columns = {c: batch.column(c).to_pylist() for c in names}
            for i in range(batch.num_rows):
                mark = tuple(columns[c][i] for c in names[:5])
                if mark != now:
                    if len(rows["vec_id"]) > 1 and (out := work(rows)) is not None:
                        yield out
                    now, rows = mark, {c: [] for c in names}
                for c in names:
                    rows[c].append(columns[c][i])
        if len(rows["vec_id"]) > 1 and (out := work(rows)) is not None:
            yield out

    return run


def links(embeddings: DataFrame, cosine: float = COSINE, nearest: int = NEAREST, shared: int = SHARED, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links long, component_id long): one row per row of embeddings (vec_id, embedding, label).

    Vectors that are null, empty, zero or hold nulls or non-finite components, and those without a label, link with nothing and are
    their own component; so do vectors of another length. Repeated rows count as other vectors; equal vectors are described once,
    so ties between pivots fall alike for them. An empty table gives no rows; further columns are ignored. Vectors of over LENGTHS lengths in one table are an error.
    """
    rows = clashing(embeddings, "vec_id", "embedding", "label").withColumn("embedding", F.col("embedding").cast("array<double>"))
    rows = rows.withColumn("ok", _valid() & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    marks = [F.xxhash64("embedding").alias("h1"), F.hash("embedding").alias("h2")]
    valid = rows.where("ok").select("vec_id", "label", F.size("embedding").alias("dim"), *marks, "embedding")
    groups = ["label", "dim", "h1", "h2"]
    classes = written(valid.groupBy(*groups).agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("n"), F.first("embedding").alias("embedding")), "vector-classes")
    # lengths that two classes of a label share: vectors of others have nothing to meet. Tables of embeddings have one or few lengths
    lengths = classes.groupBy("label", "dim").agg(F.count("*").alias("c")).where("c > 1").groupBy("dim").agg(F.sum("c").alias("c")).orderBy(F.desc("c"), "dim").limit(LENGTHS + 1).collect()
    if len(lengths) > LENGTHS:
        raise ValueError(f"embeddings of more than {LENGTHS} lengths")
    dims = {int(r["dim"]): pivots(classes, int(r["dim"]), int(r["c"])) for r in lengths}
    index = written(described(classes, dims, nearest), "vector-index")
    lists = index.select("label", "dim", "vec_id", F.explode(_list_keys(shared)("near")).alias("key"))
    sizes = lists.groupBy("label", "dim", "key").agg(F.count("*").alias("m")).where("m > 1")
    met = lists.join(sizes, ["label", "dim", "key"])
    blocks = F.ceil(F.col("m") / F.lit(block)).cast("int")
    mine = F.pmod(F.xxhash64("vec_id"), blocks).cast("int")
    met = met.withColumn("block", mine).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    met = met.select("label", "dim", "key", F.least("block", "other").alias("b1"), F.greatest("block", "other").alias("b2"), "block", "vec_id")
    units = met.join(index.select("vec_id", "n", "near", "embedding"), "vec_id")
    at = ["label", "dim", "key", "b1", "b2"]
    dealt = units.repartition(*at).sortWithinPartitions(*at).select(*at, "block", "vec_id", "n", "near", "embedding")
    found = written(dealt.mapInArrow(_compare(cosine, shared), "vec_id long, links long, root long"), "vector-links")
    roots = components(found.select(F.col("vec_id").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("vec_id"), "root")
    degrees = found.groupBy("vec_id").agg(F.sum("links").alias("links"))
    told = classes.select(*groups, "vec_id", "n").join(degrees, "vec_id", "left").join(roots, "vec_id", "left")
    told = told.select(*groups, (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "vec_id").alias("component_id"))
    mapped = valid.select("vec_id", *groups).join(told, groups).select("vec_id", "n_links", "component_id")
    alone = rows.where("not coalesce(ok, false)").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return mapped.unionByName(alone)


def op9_embeddings(spark, sf_dir: str) -> DataFrame:
    found = links(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
