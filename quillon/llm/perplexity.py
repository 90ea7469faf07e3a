"""Quality classifier: an interpolated modified Kneser-Ney model of characters, trained on trusted text.

Trusted are documents labelled quality 1 and not toxic. One in CALIBRATION of them, chosen by hashed doc_id, sets the thresholds;
all others train the model. A text is read as symbols of 12 bits: a character below OWN_IDS is one, any other two that give it without
loss. An n-gram is packed into a long, ORDER symbols. Counts of the highest order are
gathered from every training document, combined in the map tasks and summed in shards by n-gram; lower orders use continuation
counts, and each order's discounts, context totals and interpolated probabilities come from joins of these count tables. A
document's perplexity is exp of its mean negative log-probability a symbol. A language's threshold is the QUANTILE of its
calibration documents; languages with fewer than LEAST of them use the threshold over all.

The finished table is sent to the tasks in shards by the two characters before the scored one, none larger than SHARD_ROWS rows
(orders 1 and 2, which any shard needs, are in all). One shard is one scan; a larger model takes more scans, never a larger broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import bounded, clashing, fresh, held, pressed, released, unpressed, written

ORDER = 5
BITS = 12
#: Characters below are one symbol (all alphabets of Europe and the Near East); others are two, their upper bits and their lower LOW_BITS.
OWN_IDS = 1984
LOW_BITS = 10
CALIBRATION = 5
QUANTILE = 0.98
LEAST = 20
#: Characters at the language's usual rate that every text is taken to begin with: a short text needs more to be rejected.
PRIOR = 40
SHARD_ROWS = 4_000_000
#: Most languages whose thresholds are broadcast.
LANGUAGES = 10_000
#: Characters scored or counted at a time, and n-grams a task holds before it passes its counts on.
SLICE = 1 << 18
HELD = 500_000
UNIFORM = math.log(1 / (1 << BITS))


def ids(text: str) -> np.ndarray:
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    far = cp >= OWN_IDS
    if not far.any():
        return cp
    at = np.arange(len(cp)) + np.concatenate(([0], np.cumsum(far[:-1])))  # where each character begins
    out = np.empty(len(cp) + int(far.sum()), np.int64)
    out[at] = np.where(far, OWN_IDS + (cp >> LOW_BITS), cp)
    out[at[far] + 1] = (1 << BITS) - (1 << LOW_BITS) + (cp[far] & ((1 << LOW_BITS) - 1))
    return out


def grams(texts: list[str], order: int = ORDER) -> Iterator[tuple[int, np.ndarray]]:
    """(index of the text, packed n-grams that end at each of its symbols), long texts in slices; a text begins after zeros."""
    for k, text in enumerate(texts):
        last = np.zeros(order - 1, np.int64)
        for at in range(0, len(text), SLICE):
            x = np.concatenate((last, ids(text[at : at + SLICE])))
            n = len(x) - order + 1
            packed = np.zeros(n, np.int64)
            for j in range(order):
                packed = packed << BITS | x[j : j + n]
            last = x[n:]
            yield k, packed


def trusted(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, lang, fold, z) of trusted documents; z is the text compressed, since all texts pass the join's shuffle."""

    good = trusted_ids(labels)
    # a merge join at every size: whether labels would fit a broadcast is a matter of the table at hand
    return documents.where("doc_id is not null").select("doc_id", "lang", pressed("text", documents).alias("z")).join(good.hint("merge"), "doc_id")


def trusted_ids(labels: DataFrame) -> DataFrame:
    """(doc_id, fold) of documents that some label calls good and none toxic or bad."""
    told = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    return told.where("quality = 1 and toxic = 0").select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(CALIBRATION)).cast("int").alias("fold"))


def counted(trusted_texts: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram long, c long) over all training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        counts: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            u, at = np.unique(np.concatenate([g for g, _ in counts]), return_inverse=True)
            return u, np.bincount(at, np.concatenate([c for _, c in counts])).astype(np.int64)

        waiting: list[np.ndarray] = []
        chars = 0

        def count() -> None:
            nonlocal chars, size
            if waiting:
                u, c = np.unique(np.concatenate(waiting), return_counts=True)
                counts.append((u, c))
                size += len(u)
                waiting.clear()
            chars = 0

        for batch in batches:
            for x in batch.column(0):
                for _, g in grams([(unpressed(x.as_py()) or b"").decode()], order):
                    waiting.append(g)
                    chars += len(g)
                    if chars >= SLICE:
                        count()
                if size > HELD:
                    u, c = merged()
                    counts, size = [(u, c)], len(u)
                    if size > HELD // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(c)], names=["gram", "c"])
                        counts, size = [], 0
        count()
        if counts:
            u, c = merged()
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(c)], names=["gram", "c"])

    return trusted_texts.select("z").mapInArrow(run, "gram long, c long").groupBy("gram").agg(F.sum("c").alias("c"))


def _discounts(counts: DataFrame) -> list[float]:
    n1, n2, n3, n4 = (float(x or 0) for x in counts.agg(*[F.count_if(F.col("c") == k) for k in (1, 2, 3, 4)]).first())
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    raw = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 0.75, 3 - 4 * y * n4 / n3 if n3 else 1.0]
    return [min(max(d, 0.05), k - 0.05) for k, d in zip((1, 2, 3), raw, strict=True)]  # small counts can give figures out of range


def model(trusted_texts: DataFrame, order: int = ORDER) -> DataFrame:
    """(n int, gram long, logp double, back double): per order the interpolated log-probability of each n-gram seen, and of each
    context of n characters the log of the weight it leaves to the order below (rows with logp null are contexts only)."""
    counts = {order: written(counted(trusted_texts, order), "kn-counts")}
    for n in range(order - 1, 0, -1):
        counts[n] = written(counts[n + 1].groupBy(F.col("gram").bitwiseAND(F.lit((1 << BITS * n) - 1)).alias("gram")).agg(F.count("*").alias("c")), f"kn-{n}")
    probs: dict[int, DataFrame] = {}
    backs: dict[int, DataFrame] = {}
    for n in range(1, order + 1):
        d = _discounts(counts[n])
        off = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        context = F.shiftright("gram", BITS) if n > 1 else F.lit(0).cast("long")
        rows = counts[n].select("gram", "c", off.alias("d"), context.alias("ctx"))
        totals = rows.groupBy("ctx").agg(F.sum("c").alias("total"), (F.sum("d") / F.sum("c")).alias("left"))
        rows = rows.join(totals, "ctx")
        if n == 1:
            lower = rows.withColumn("lower", F.lit(math.exp(UNIFORM)))
        else:
            below = probs[n - 1].select(F.col("gram").alias("low"), F.col("p").alias("lower"))
            lower = rows.withColumn("low", F.col("gram").bitwiseAND(F.lit((1 << BITS * (n - 1)) - 1))).join(below, "low")
        probs[n] = written(lower.select("gram", ((F.col("c") - F.col("d")) / F.col("total") + F.col("left") * F.col("lower")).alias("p")), f"kn-p{n}")
        backs[n - 1] = totals.select(F.col("ctx").alias("gram"), F.log("left").alias("back"))
    table = None
    for n in range(0, order + 1):
        p = probs[n].select("gram", F.log("p").alias("logp")) if n else None
        b = backs[n] if n < order else None
        rows = p.withColumn("back", F.lit(None).cast("double")) if b is None else b.select("gram", F.lit(None).cast("double").alias("logp"), "back") if p is None else p.join(b, "gram", "full")
        rows = rows.select(F.lit(n).alias("n"), "gram", "logp", "back")
        table = rows if table is None else table.unionByName(rows)
    return written(table, "kn-model")


def _shard(two: np.ndarray, shards: int) -> np.ndarray:
    return (two * 0x9E3779B1 >> 13) % shards


class Scorer:
    """A shard of the model as sorted arrays."""

    def __init__(self, rows: pa.Table, order: int, shard: int, shards: int):
        self.order, self.shard, self.shards = order, shard, shards
        n, gram, logp, back = (rows.column(c).to_numpy() for c in ("n", "gram", "logp", "back"))
        self.logp, self.back = {}, {}
        for k in range(order + 1):
            for out, value in ((self.logp, logp), (self.back, back)):
                at = np.flatnonzero((n == k) & ~np.isnan(value))
                at = at[np.argsort(gram[at])]
                out[k] = (gram[at], value[at].astype(np.float32))

    @staticmethod
    def look(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        known, values = table
        if not len(known):
            return np.zeros(len(keys), bool), np.zeros(len(keys), np.float32)
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        return known[at] == keys, values[at]

    def nll(self, packed: np.ndarray) -> float:
        if self.shards > 1:
            packed = packed[_shard(packed >> BITS & ((1 << 2 * BITS) - 1), self.shards) == self.shard]
        total, rest = 0.0, packed
        for k in range(self.order, 0, -1):
            hit, logp = self.look(self.logp[k], rest & ((1 << BITS * k) - 1))
            total += logp[hit].sum(dtype=np.float64)
            rest = rest[~hit]
            if not len(rest):
                return -total
            has, back = self.look(self.back[k - 1], rest >> BITS & ((1 << BITS * (k - 1)) - 1))
            total += back[has].sum(dtype=np.float64)
        return -(total + UNIFORM * len(rest))


def _scorer(payload: bytes, order: int, shard: int, shards: int) -> Scorer:
    return held(("kn", hash(payload), shard), lambda: Scorer(pa.ipc.open_stream(payload).read_all(), order, shard, shards))


def _sent(rows: DataFrame):
    """Rows of the model as a broadcast value; at most SHARD_ROWS and those of orders 1 and 2."""
    sink, arrow = pa.BufferOutputStream(), rows.toArrow()
    with pa.ipc.new_stream(sink, arrow.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(arrow)
    return rows.sparkSession.sparkContext.broadcast(sink.getvalue().to_pybytes())


def _scoring(sent, order: int, shard: int, shards: int):
    @F.arrow_udf("struct<n:bigint,nll:double>")
    def score(texts: pa.Array) -> pa.Array:
        scorer = _scorer(sent.value, order, shard, shards)
        n, nll = np.zeros(len(texts), np.int64), np.zeros(len(texts))
        for at, x in enumerate(texts):
            for _, packed in grams([x.as_py() or ""], order):
                n[at] += len(packed)
                nll[at] += scorer.nll(packed)
        return pa.StructArray.from_arrays([pa.array(n), pa.array(nll)], ["n", "nll"])

    return score


def scores(documents: DataFrame, table: DataFrame, order: int = ORDER, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(doc_id, th, lang, n, nll): one row per doc_id, hash of the text and language; n counts symbols."""
    bounded(documents.sparkSession)
    shards = max(1, math.ceil(table.where("n > 2").count() / shard_rows))
    parts = None
    for s in range(shards):
        rows = table
        if shards > 1:
            two = F.when(F.col("logp").isNotNull(), F.shiftright("gram", BITS)).otherwise(F.col("gram")).bitwiseAND(F.lit((1 << 2 * BITS) - 1))
            mine = (F.pmod(F.shiftright(two * 0x9E3779B1, 13), F.lit(shards)) == s)
            # a row with both figures serves its n-gram's shard and, as a context, the shard of its own last two characters
            last = F.pmod(F.shiftright(F.col("gram").bitwiseAND(F.lit((1 << 2 * BITS) - 1)) * 0x9E3779B1, 13), F.lit(shards)) == s
            rows = table.where((F.col("n") <= 2) | mine | last)
        sent = _sent(rows)
        score = _scoring(sent, order, s, shards)
        part = documents.select("doc_id", F.xxhash64("text").alias("th"), "lang", score("text").alias("s")).select("doc_id", "th", "lang", "s.n", "s.nll")
        part = part.groupBy("doc_id", "th", "lang").agg(F.max("n").alias("n"), F.max("nll").alias("nll"))
        parts = part if parts is None else parts.unionByName(part)
    return parts if shards == 1 else parts.groupBy("doc_id", "th", "lang").agg(F.max("n").alias("n"), F.sum("nll").alias("nll"))


def judged(documents: DataFrame, labels: DataFrame, quantile: float = QUANTILE, order: int = ORDER, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(doc_id, th, lang, n, perplexity, threshold, kept) for every document.

    Null and empty texts have no perplexity and are not kept. A null language is one of its own. Repeated rows (same doc_id, text and
    language) are judged once; rows that share only the doc_id are judged each. Without trusted labels nothing can be told: all
    texts that are not empty are kept and the threshold is null. An empty table gives no rows; further columns are ignored.
    """
    documents, labels = clashing(documents, "doc_id", "text", "lang"), clashing(labels, "doc_id", "quality", "toxic")
    good = trusted(documents, labels)
    found = written(scores(documents, model(good.where("fold <> 0"), order), order, shard_rows), "kn-scores")
    calm = found.where("n > 0").join(trusted_ids(labels).where("fold = 0"), "doc_id")
    means = calm.groupBy(F.col("lang").alias("l")).agg((F.sum("nll") / F.sum("n")).alias("mean"), F.count("*").alias("docs"))
    both = calm.agg((F.sum("nll") / F.sum("n")).alias("mean_all"))
    spoken = found.select("lang").distinct()
    langs = spoken.join(means, spoken["lang"].eqNullSafe(means["l"]), "left").drop("l").withColumnRenamed("lang", "l").join(F.broadcast(both), how="left")
    # thresholds are a row a language: sent to all tasks while there are few, joined like any table beyond
    send = F.broadcast if spoken.count() <= LANGUAGES else (lambda d: d)
    usual = langs.select("l", F.when(F.col("docs") >= LEAST, F.col("mean")).otherwise(F.col("mean_all")).alias("mean"), F.coalesce(F.col("docs") >= LEAST, F.lit(False)).alias("own"))
    named = found.join(send(usual), found["lang"].eqNullSafe(usual["l"])).drop("l")
    smooth = (F.col("nll") + F.lit(PRIOR) * F.col("mean")) / (F.col("n") + F.lit(PRIOR))
    named = named.withColumn("level", F.when(F.col("n") > 0, smooth))
    levels = named.where("n > 0").join(trusted_ids(labels).where("fold = 0"), "doc_id")
    own = levels.groupBy(F.col("lang").alias("l")).agg(F.percentile_approx("level", quantile, 10000).alias("limit"))
    everyone = levels.agg(F.percentile_approx("level", quantile, 10000).alias("limit_all"))
    limits = named.join(send(own), named["lang"].eqNullSafe(own["l"]), "left").join(F.broadcast(everyone), how="left")
    limit = F.when(F.col("own"), F.col("limit")).otherwise(F.col("limit_all"))
    return limits.select("doc_id", "th", "lang", "n", F.when(F.col("n") > 0, F.exp(F.col("nll") / F.col("n"))).alias("perplexity"), F.exp(F.col("level")).alias("level"), F.exp(limit).alias("threshold"), F.coalesce((F.col("n") > 0) & (F.coalesce(F.col("level") <= limit, F.lit(True))), F.lit(False)).alias("kept"))


def _opened(column: str):
    @F.arrow_udf("string")
    def text(zs: pa.Array) -> pa.Array:
        return pa.array([(unpressed(z.as_py()) or b"").decode() for z in zs], pa.string())

    return text(column)


def kept(documents: DataFrame, labels: DataFrame, quantile: float = QUANTILE, order: int = ORDER, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The documents that judged() keeps, with all their columns.

    Thresholds come from the calibration documents, then every document is scored and decided on where it is read: whole texts pass no
    shuffle but that of the trusted ones. A model of several shards, or more than LANGUAGES languages, takes a join with judged().
    """
    doc, th, lang, s = (fresh(documents, n) for n in ("__doc", "__th", "__lang", "__s"))
    columns, labels = clashing(documents, "doc_id", "text", "lang"), clashing(labels, "doc_id", "quality", "toxic")
    good = written(trusted(columns, labels), "kn-trusted")
    table = model(good.where("fold <> 0"), order)
    if table.where("n > 2").count() > shard_rows:
        named = judged(documents, labels, quantile, order, shard_rows).where("kept").select(F.col("doc_id").alias(doc), F.col("th").alias(th), F.col("lang").alias(lang))
        same = F.col("doc_id").eqNullSafe(F.col(doc)) & (F.xxhash64("text") == F.col(th)) & F.col("lang").eqNullSafe(F.col(lang))
        return documents.join(named, same, "left_semi")
    calm = written(scores(good.where("fold = 0").select("doc_id", "lang", _opened("z").alias("text")), table, order).where("n > 0"), "kn-calibration")
    means = calm.groupBy(F.col("lang").alias("l")).agg((F.sum("nll") / F.sum("n")).alias("mean"), F.count("*").alias("docs")).where(F.col("docs") >= LEAST)
    both = calm.agg((F.sum("nll") / F.sum("n")).alias("mean_all"))
    level = lambda nll, n, mean: (nll + F.lit(PRIOR) * mean) / (n + F.lit(PRIOR))
    leveled = calm.join(F.broadcast(both)).join(means, calm["lang"].eqNullSafe(means["l"]), "left").withColumn("level", level(F.col("nll"), F.col("n"), F.coalesce("mean", "mean_all")))
    own = leveled.where("docs is not null").groupBy("l").agg(F.first("mean").alias("mean"), F.percentile_approx("level", quantile, 10000).alias("limit"))
    every = leveled.agg(F.first("mean_all").alias("mean_all"), F.percentile_approx("level", quantile, 10000).alias("limit_all")).first()  # one row
    limits = written(own.select(F.col("l").alias(lang), F.struct("mean", "limit").alias(th)), "kn-limits")
    send = F.broadcast if limits.count() <= LANGUAGES else (lambda d: d)
    scored = documents.withColumn(s, _scoring(_sent(table), order, 0, 1)("text"))
    found = scored.join(send(limits), F.col("lang").eqNullSafe(F.col(lang)), "left")
    mean, limit = (F.coalesce(F.col(f"{th}.{c}"), F.lit(v)) for c, v in (("mean", every.mean_all), ("limit", every.limit_all)))
    n, nll = F.col(f"{s}.n"), F.col(f"{s}.nll")
    # one expression over both sides of the join: a part of it that names the scores alone would be pushed down and score every text twice
    fits = F.when((n > 0) & limit.isNotNull(), level(nll, n, mean) <= limit).otherwise((n > 0) & limit.isNull())
    return found.where(F.coalesce(fits, F.lit(False))).select(*[F.col(f"`{c}`") for c in documents.columns])


def op8_quality(spark, sf_dir: str) -> DataFrame:
    table = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    found = judged(table("documents"), table("labels"))
    return found.select("doc_id", "lang", F.col("n").alias("n_symbols"), F.round("perplexity", 6).alias("perplexity"), F.round("threshold", 6).alias("threshold"), "kept")
