"""SimHash near-duplicates found through pivot distance tables.

Every fingerprint's Hamming distances to many reference fingerprints (pivots) are computed once; fingerprints are then compared
through these distances, and only what they cannot tell apart is compared bit by bit. Two kinds of pivots are used:

* Block pivots: one base fingerprint, and it with one of `blocks` blocks of bits turned. Half the difference of a fingerprint's
  distances to the base and to a block pivot is its distance from the base within that block. Fingerprints at most 2 apart differ in
  the distances of at most 2 blocks, so of 4 quarters of the blocks two agree in all. Candidates are pairs that agree in the distances
  of one of the 6 pairs of quarters. Blocks have 4 bits, or 2 or 1 where the table is so large that a key's lists would grow too long.
* Spread pivots are unrelated fingerprints. By the triangle inequality |d(x,p) - d(y,p)| <= d(x,y), a candidate pair whose largest
  coordinate difference is over 2 is discarded. What survives is verified bit by bit.

A key with more than `crowd` distinct fingerprints is not paired up. Each of its fingerprints reports itself and its 64 one-bit
neighbours; fingerprints meet at a common neighbour exactly when they are at most 2 apart, and every meeting point is linked as
a star. That is 65 rows a fingerprint whatever the size of the crowd, and exact.

similar() serves similarities too low for 2 bits. Texts of shingle similarity 0.8 differ in some 15 % of fingerprint bits, which no
exact key survives, so it takes 256 bits and many keys, each a set of masked-pivot coordinates; the keys' length grows with the
logarithm of the rows, their number follows from the wanted recall. Spread pivots discard nothing at that distance and are left out.
In keys with more than a few rows, where a crowd of copies of one text would name all its pairs, a sketch of the shingle set (the
least shingle of each of BINS bins, as a byte) decides which are candidates. Both only name candidates: each pair is verified by the
shingle sets themselves before it is linked.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import arrow_map, clashing, components, fresh, written

SEED = 42
SHINGLE = 3
DISTANCE = 2
#: Distinct fingerprints of a key that are paired up.
CROWD = 256
#: Shingles hashed at a time; bounds the memory a very long text takes.
STRIDE = 1 << 16
BASE = 0x9E3779B97F4A7C15


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    words = text.lower().split()  # bytes.lower() touches A-Z only, bytes.split() cuts at 0x20 and 0x09-0x0D
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(line, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - shingle + 1
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, STRIDE):
        to = min(n, at + STRIDE)
        hashes = np.fromiter((digest(line[s:e], SEED) for s, e in zip(starts[at:to].tolist(), ends[at + shingle - 1 : to + shingle - 1].tolist(), strict=True)), np.uint64, to - at)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def shingle_set(text: bytes, shingle: int) -> np.ndarray:
    """Hashes of a text's distinct shingles in ascending order; a text shorter than a shingle is one."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    last = ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(line[s:e], SEED) for s, e in zip(begins[:n].tolist(), last.tolist(), strict=True)), np.uint64, n))


def wide_fingerprint(hashes: np.ndarray, words_: int = 4) -> np.ndarray:
    """A SimHash of 64 * words_ bits over a set of shingles: the hash is mixed anew for every further 64."""
    counts = np.zeros(64 * words_, np.int64)
    for at in range(0, len(hashes), STRIDE // words_):
        h = hashes[at : at + STRIDE // words_]
        mixed = np.empty((len(h), words_), np.uint64)
        for k in range(words_):
            if k:
                h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
                h ^= h >> np.uint64(29)
            mixed[:, k] = h
        counts += np.unpackbits(mixed.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)


def sketch(hashes: np.ndarray) -> bytes:
    """Of ascending hashes: their number in 4 bytes, then for each bin a byte of its least hash, 0 if it has none."""
    out = np.zeros(BINS, np.uint8)
    bins, first = np.unique(hashes % np.uint64(BINS), return_index=True)
    out[bins.astype(np.int64)] = hashes[first] // np.uint64(BINS) % np.uint64(255) + np.uint64(1)
    return len(hashes).to_bytes(4, "little") + out.tobytes()


def maybe_alike(a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """For rows of sketches: whether the sets may be `similarity` alike. The share of common bins is that of a sample of the union without
    replacement; it may be SLACK standard deviations too small."""
    n = a[:, :4].copy().view(np.uint32)[:, 0].astype(float) + b[:, :4].copy().view(np.uint32)[:, 0]
    x, y = a[:, 4:], b[:, 4:]
    used = np.maximum(1, ((x | y) != 0).sum(axis=1))
    same = ((x == y) & (x != 0)).sum(axis=1)
    union = np.maximum(n / (1 + similarity), used)
    spread = np.sqrt(similarity * (1 - similarity) / used * np.maximum(0.05, 1 - used / union))
    return same / used >= similarity - SLACK * spread - 1 / used


def fingerprints(documents: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp long): the SimHash of every whole text; null and empty texts have fingerprint 0."""

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1).cast(pa.binary())
        fps = np.fromiter((fingerprint(x.as_py() or b"", shingle) for x in texts), np.uint64, len(texts))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return arrow_map(clashing(documents, "doc_id", "text"), of, "doc_id long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _spread(n: int) -> list[int]:
    return [xxhash.xxh64_intdigest(b"pivot %d" % i, SEED) for i in range(n)]


def blocks_for(rows: int, crowd: int = CROWD) -> int:
    """Blocks whose fullest expected list (all distances at their most frequent value) has at most `crowd` of so many fingerprints."""
    usual = lambda width: math.comb(width, width // 2) / 2**width
    return next((m for m in (16, 32) if rows * usual(64 // m) ** (m // 2) <= crowd), 64)


def pivot_table(fps: DataFrame, spread: int = 16, blocks: int = 16) -> DataFrame:
    """fp with b0, b1, ... (distances from the base within each block) and p0, p1, ... (distances to the spread pivots)."""
    distance = lambda p: F.bit_count(F.col("fp").bitwiseXOR(F.lit(_signed(p))))
    width = 64 // blocks
    turned = [BASE ^ (((1 << width) - 1) << (width * j)) for j in range(blocks)]
    first = fps.select("fp", distance(BASE).alias("base"), *[distance(p).alias(f"t{j}") for j, p in enumerate(turned)], *[distance(p).cast("tinyint").alias(f"p{i}") for i, p in enumerate(_spread(spread))])
    within = lambda j: F.shiftright(F.col("base") - F.col(f"t{j}") + width, 1).cast("tinyint").alias(f"b{j}")
    return first.select("fp", *[within(j) for j in range(blocks)], *[f"p{i}" for i in range(spread)])


def _keys(blocks: int) -> Column:
    """The 6 pairs of quarters of the block distances, each packed into one long."""
    bits, quarter = (64 // blocks).bit_length(), blocks // 4

    def packed(a: int, b: int) -> Column:
        chosen = [*range(a * quarter, (a + 1) * quarter), *range(b * quarter, (b + 1) * quarter)]
        key = F.lit(0).cast("long")
        for at, j in enumerate(chosen):
            key = key.bitwiseOR(F.shiftleft(F.col(f"b{j}").cast("long"), bits * at))
        return key

    return F.array(*[F.struct(F.lit(n).cast("tinyint").alias("part"), packed(a, b).alias("key")) for n, (a, b) in enumerate(combinations(range(4), 2))])


def candidates(few: DataFrame, spread: int) -> DataFrame:
    """(a, b): pairs of fingerprints of one key (few: part, key, fp, p0, ...) whose largest difference of pivot distances is at most 2."""
    pivots = [f"p{i}" for i in range(spread)]
    right = few.select("part", "key", *[F.col(c).alias(f"r_{c}") for c in ("fp", *pivots)])
    same = (F.col("l.part") == F.col("r.part")) & (F.col("l.key") == F.col("r.key")) & (F.col("l.fp") < F.col("r.r_fp"))
    for p in pivots:
        same &= F.abs(F.col(f"l.{p}") - F.col(f"r.r_{p}")) <= DISTANCE
    return few.alias("l").join(right.alias("r"), same).select(F.col("l.fp").alias("a"), F.col("r.r_fp").alias("b"))


def links(fps: DataFrame, crowd: int = CROWD, spread: int = 16, blocks: int = 16) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) that are at most 2 bits apart, enough to connect all such pairs."""
    pivots = [f"p{i}" for i in range(spread)]
    keyed = pivot_table(fps, spread, blocks).select("fp", *pivots, F.explode(_keys(blocks)).alias("k")).select("fp", *pivots, "k.part", "k.key")
    sizes = written(keyed.groupBy("part", "key").agg(F.count("*").alias("n")).where("n > 1"), "simhash-sizes")
    met = written(keyed.join(sizes, ["part", "key"]), "simhash-keys")
    pairs = candidates(met.where(F.col("n") <= crowd), spread).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE)
    many = met.where(F.col("n") > crowd).select("fp").distinct()
    turned = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_signed(1 << j))) for j in range(64)])
    points = many.select("fp", F.explode(turned).alias("point"))
    heads = points.groupBy("point").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1").select("point", "b")
    stars = points.join(heads, "point").where("fp <> b").select(F.col("fp").alias("a"), "b")
    return pairs.unionByName(stars).distinct()


def near_duplicates(documents: DataFrame, shingle: int = SHINGLE, crowd: int = CROWD) -> DataFrame:
    """(doc_id, fp long, component_id): documents whose fingerprints are linked at 2 or fewer bits share the smallest doc_id.

    Null and empty texts have fingerprint 0 and are linked like any other; repeated rows of one doc_id share its component; an
    empty table gives no rows; further columns are ignored.
    """
    fps = written(fingerprints(documents, shingle), "simhash")
    classes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n")), "simhash-classes")
    roots = components(links(classes.select("fp"), crowd, blocks=blocks_for(classes.count(), crowd))).withColumnRenamed("node", "fp")
    # classes of one document that nothing is linked to need no row here
    told = classes.join(roots, "fp", "left").where("n > 1 or root is not null").withColumn("root", F.coalesce("root", "fp"))
    firsts = told.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    named = told.join(firsts, "root").select("fp", "component_id")
    return fps.join(named, "fp", "left").select("doc_id", "fp", F.coalesce("component_id", "doc_id").alias("component_id"))


#: Of similar(): share of the pairs at the least similarity that meet in some key, bits, rows of a list from which sketches decide too, bins of a
#: sketch, and rows of a list compared in one piece.
RECALL = 0.99
BITS = 256
FEW = 32
BINS = 512
LIST = 4096
#: Standard deviations that a candidate's distance may lie beyond the nominal one; 1 in 700 pairs at the least similarity is beyond 3.
SLACK = 3
#: Keys of the first round, which ties the closest, so that the second need not verify all pairs of a crowd.
FIRST = 8


def _angle(similarity: float) -> float:
    """Share of bits in which the fingerprints of texts of this shingle similarity differ."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def _most(bits: int, similarity: float) -> int:
    """Bits in which texts of this similarity differ at most, but for chance beyond SLACK."""
    differ = _angle(similarity)
    return int(bits * differ + SLACK * math.sqrt(bits * differ * (1 - differ)))


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    apart = np.zeros((len(a), len(b)), np.int16)
    for k in range(a.shape[1]):
        apart += np.bitwise_count(a[:, None, k] ^ b[None, :, k])
    return apart


def _chosen(bits: int, parts: int) -> np.ndarray:
    """For each part the places of the fingerprint bits that make its key."""
    draw = np.random.default_rng(SEED)
    return np.array([draw.choice(BITS, bits, replace=False) for _ in range(parts)])


def _lists(similarity: float, one: bool, bits: int, parts: int):
    """Rows sorted by unit (part, key, b1, b2) -> candidates: pairs of other roots near enough in bits and by sketches, if the rows have any; with `one`
    only a row's nearest in the unit. A pair that meets in several parts counts in the first, which is told by its differing bits. A unit
    holds two blocks of a list, or one block twice, and compares all rows of one with all of the
    other."""
    thin = _most(BITS, similarity)
    masks = np.packbits(np.array([np.isin(np.arange(BITS), c) for c in _chosen(bits, parts)]), axis=1, bitorder="little").view(np.uint64)

    def work(part: int, block: np.ndarray, ids: np.ndarray, roots: np.ndarray, fps: np.ndarray, more: np.ndarray, b1: int, b2: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if (roots == roots[0]).all():
            return
        order = np.argsort(ids)
        block, ids, roots, fps, more = block[order], ids[order], roots[order], fps[order], more[order]
        left, right = np.flatnonzero(block == b1), np.flatnonzero(block == b2)
        for at in range(0, len(left), 512):
            mine = left[at : at + 512]
            apart = _apart(fps[mine], fps[right])
            ok = (apart <= thin) & (roots[mine, None] != roots[None, right])
            if b1 == b2:
                ok &= right[None, :] < mine[:, None]
            if one:
                i = np.flatnonzero(ok.any(axis=1))
                j = np.where(ok[i], apart[i], np.int16(BITS + 1)).argmin(axis=1)
            else:
                i, j = np.nonzero(ok)
                if more.shape[1] and len(i):
                    near = np.concatenate([maybe_alike(more[mine[i[k : k + 10_000]]], more[right[j[k : k + 10_000]]], similarity) for k in range(0, len(i), 10_000)])
                    i, j = i[near], j[near]
                if part and len(i):
                    pieces = [fps[mine[i[k : k + 5000]]] ^ fps[right[j[k : k + 5000]]] for k in range(0, len(i), 5000)]
                    first = np.concatenate([((d[:, None] & masks[None, :part]) != 0).any(axis=2).all(axis=1) for d in pieces])
                    i, j = i[first], j[first]
            a, b = ids[mine[i]], ids[right[j]]
            yield np.maximum(a, b), np.minimum(a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark, rows = None, []

        def flush() -> Iterator[pa.RecordBatch]:
            if sum(len(r[0]) for r in rows) > 1:
                for a, b in work(mark[0], *(np.concatenate(c) for c in zip(*rows, strict=True)), *mark[2:4]):
                    if len(a):
                        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for b in batches:
            unit = [b.column(k).to_numpy() for k in range(4)] + [b.column("sketched").to_numpy(zero_copy_only=False)]
            block, who, root = (b.column(k).to_numpy() for k in range(4, 7))
            words = np.stack([b.column(7 + k).to_numpy() for k in range(BITS // 64)], axis=1).view(np.uint64)
            edges = np.flatnonzero(np.logical_or.reduce([u[1:] != u[:-1] for u in unit])) + 1
            for s, e in zip([0, *edges.tolist()], [*edges.tolist(), b.num_rows], strict=True):
                now = tuple(u[s] for u in unit)
                if now != mark:
                    yield from flush()
                    mark, rows = now, []
                held = b.column("more").slice(s, e - s)
                more = np.frombuffer(b"".join(held.to_pylist()), np.uint8).reshape(e - s, -1) if now[4] else np.zeros((e - s, 0), np.uint8)
                rows.append((block[s:e], who[s:e], root[s:e], words[s:e], more))
        yield from flush()

    return run


def _keyed(classes: DataFrame, bits: int, parts: int) -> DataFrame:
    """classes (sig, root, f0, ...) once a key, with part and key."""
    words, columns_ = BITS // 64, classes.columns

    def keys(batch: pa.RecordBatch) -> pa.RecordBatch:
        base = np.array([xxhash.xxh64_intdigest(b"base %d" % k, SEED) for k in range(words)], np.uint64)
        fps = np.stack([batch.column(2 + k).to_numpy() for k in range(words)], axis=1).view(np.uint64)
        side = np.unpackbits((fps ^ base).view(np.uint8), axis=1, bitorder="little")  # which side of each masked pivot
        n = batch.num_rows
        out = [side[:, c].astype(np.int64) @ (np.int64(1) << np.arange(bits, dtype=np.int64)) for c in _chosen(bits, parts)]
        columns = [pa.array(np.repeat(np.arange(parts, dtype=np.int32), n)), pa.array(np.concatenate(out) if out else np.zeros(0, np.int64)), *[pa.array(np.tile(c.to_numpy(), parts)) for c in batch.columns]]
        return pa.RecordBatch.from_arrays(columns, names=["part", "key", *columns_])

    return arrow_map(classes, keys, "part int, key long, " + ", ".join(f"{c} long" for c in columns_), 2000)


def _candidates(classes: DataFrame, sketches: DataFrame, bits: int, parts: int, similarity: float, one: bool) -> DataFrame:
    """(a, b): distinct candidate pairs of sigs. Lists of more than FEW rows are judged by `sketches` (sig, more) too, and those of
    more than LIST are compared in pairs of blocks, each a unit of its own; no pair of a list is left out."""
    keyed = _keyed(classes, bits, parts)
    crowds = keyed.groupBy("part", "key").agg(F.count("*").alias("m")).where(F.col("m") > FEW)
    nowhere = crowds.sparkSession.range(1).select(F.lit(-1).alias("part"), F.lit(0).cast("long").alias("key"), F.lit(1).cast("long").alias("m"))  # keeps the plan's shape without crowds
    crowds = written(crowds.unionByName(nowhere), "simhash-crowds")
    told = keyed.join(crowds, ["part", "key"], "left")
    few = told.where("m is null").withColumn("more", F.lit(None).cast("binary"))
    many = keyed.join(crowds, ["part", "key"])
    many = many.withColumn("more", F.lit(None).cast("binary")) if one else many.join(sketches, "sig")
    every = few.unionByName(many.select(*few.columns))
    blocks = F.coalesce(F.ceil(F.col("m") / F.lit(LIST)).cast("int"), F.lit(1))
    split = every.withColumn("n", blocks).withColumn("block", F.pmod(F.xxhash64("sig"), F.col("n")).cast("int"))
    split = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    unit = ["part", "key", "b1", "b2"]
    split = split.select("part", "key", F.least("block", "other").alias("b1"), F.greatest("block", "other").alias("b2"), "block", *classes.columns, F.col("more").isNotNull().alias("sketched"), "more")
    dealt = split.repartition(*unit).sortWithinPartitions(*unit)
    return written(dealt.mapInArrow(_lists(similarity, one, bits, parts), "a long, b long").distinct(), "simhash-candidates")


def _verified(pairs: DataFrame, classes: DataFrame, texts: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """Those of the pairs of sigs whose shingle sets are `similarity` alike: common shingles by all that stand in either."""

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(x.as_py() or b"", shingle) for x in batch.column(1).cast(pa.binary())]
        sigs = pa.array([_signed(xxhash.xxh64_intdigest(h.tobytes(), SEED)) for h in sets], pa.int64())
        return pa.RecordBatch.from_arrays([sigs, pa.array([h.view(np.int64) for h in sets], pa.list_(pa.int64()))], names=["sig", "shingles"])

    named = pairs.select(F.explode(F.array("a", "b")).alias("sig")).distinct()
    wanted = classes.join(named, "sig").select(F.col("head.doc_id").alias("_head")).distinct()
    sets = arrow_map(texts.join(wanted, texts["doc_id"] == wanted["_head"], "left_semi"), of, "sig long, shingles array<bigint>")
    sets = written(sets.dropDuplicates(["sig"]), "simhash-sets")
    side = lambda name, to: sets.select(F.col("sig").alias(name), F.col("shingles").alias(to))
    both = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b")
    common, total = F.size(F.array_intersect("x", "y")), F.size("x") + F.size("y")
    alike = (F.least(F.size("x"), F.size("y")) >= similarity * F.greatest(F.size("x"), F.size("y")) - 1e-9) & (common >= similarity * (total - common) - 1e-9)
    return written(both.where(alike).select("a", "b"), "simhash-links")


def similar(documents: DataFrame, similarity: float = 0.8, shingle: int = 5, recall: float = RECALL) -> DataFrame:
    """(doc_id, th, component_id, component_th): documents (th: hash of the text) whose sets of word shingles are `similarity` alike or
    more share the smallest of them.

    Candidates are pairs that meet in a key and differ in few of 256 fingerprint bits; only those whose shingle sets reach the
    similarity are linked. A first round ties each row to one candidate a key, a second takes all candidates that the first left
    in different components. Equal sets are one class. Null and empty texts have no shingles and are alike; repeated rows
    share a component, texts that share a doc_id need not; rows without doc_id are left out; an empty table gives no rows; texts of any
    length are read whole; further columns are ignored.
    """
    names = [f"f{k}" for k in range(BITS // 64)]
    texts = clashing(documents, "doc_id", "text").where("doc_id is not null").withColumn("th", F.xxhash64("text"))

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(x.as_py() or b"", shingle) for x in batch.column(1).cast(pa.binary())]
        sigs = pa.array([_signed(xxhash.xxh64_intdigest(h.tobytes(), SEED)) for h in sets], pa.int64())
        fps = [wide_fingerprint(h, len(names)) for h in sets]
        thin = [pa.array(np.array([f[k] for f in fps], np.uint64).view(np.int64)) for k in range(len(names))]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), sigs, *thin, pa.array(map(sketch, sets), pa.binary())], names=["doc_id", "th", "sig", *names, "more"])

    prints = written(arrow_map(texts, of, "doc_id long, th long, sig long, " + ", ".join(f"{n} long" for n in names) + ", more binary"), "simhash-wide")
    classes = written(prints.groupBy("sig").agg(F.min(F.struct("doc_id", "th")).alias("head"), *[F.first(n).alias(n) for n in [*names, "more"]]), "simhash-classes")
    sketches = classes.select("sig", "more")
    rows = max(2, classes.count())
    bits = max(12, math.ceil(math.log2(rows)) - 2)
    differ = _angle(similarity)
    parts = math.ceil(math.log(1 - recall) / math.log(1 - (1 - differ) ** bits))
    first = _candidates(classes.select("sig", F.col("sig").alias("root"), *names), sketches, bits, min(FIRST, parts), similarity, True)
    links = _verified(first, classes, texts, similarity, shingle)
    tied = components(links).withColumnRenamed("node", "sig")
    rest = _candidates(classes.join(tied, "sig", "left").select("sig", F.coalesce("root", "sig").alias("root"), *names), sketches, bits, parts, similarity, False)
    rest = rest.join(first, ["a", "b"], "left_anti")
    roots = components(links.unionByName(_verified(rest, classes, texts, similarity, shingle))).withColumnRenamed("node", "sig")
    told = classes.join(roots, "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    firsts = told.groupBy("root").agg(F.min("head").alias("first"))
    named = told.select("sig", "root").join(firsts, "root").select("sig", F.col("first.doc_id").alias("component_id"), F.col("first.th").alias("component_th"))
    return prints.select("doc_id", "th", "sig").join(named, "sig").select("doc_id", "th", "component_id", "component_th")


def one_of_each(documents: DataFrame, similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """documents without those that similar() gives another representative than themselves. Of each component the document with the
    smallest doc_id (of texts that share it the one of least hash) stays, with rows that repeat it as a whole; rows without doc_id stay."""
    found = similar(documents, similarity, shingle).where("doc_id <> component_id or th <> component_th")
    doc, th = fresh(documents, "__doc"), fresh(documents, "__th")
    gone = written(found.select(F.col("doc_id").alias(doc), F.col("th").alias(th)).distinct(), "simhash-gone")
    return documents.join(gone, (F.col("doc_id") == F.col(doc)) & (F.xxhash64("text") == F.col(th)), "left_anti")


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
