"""What the operators of this package share: shared scratch tables, arrow mappers and connected components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows and bytes of an Arrow batch that carries whole texts: Spark's defaults of 10,000 rows and 256 MB would not fit a worker.
TEXT_BATCH_ROWS = 500
TEXT_BATCH_BYTES = 8 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded(spark: SparkSession) -> None:
    """From now on Arrow batches of the session stay under TEXT_BATCH_BYTES; a lower setting of the user's stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.fullmatch(r"(\d+)b?", spark.conf.get(name) or "")
    if now is None or int(now[1]) > TEXT_BATCH_BYTES:
        spark.conf.set(name, TEXT_BATCH_BYTES)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where the cluster names none, a local one in local mode (tests), else an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    own = os.path.join(tempfile.gettempdir(), "quillon-checkpoints")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


_WRITTEN: dict[str, list[str]] = {}


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: its lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillon-{name}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.options(compression="zstd", **options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.quillon_path = path
    return out


def discarded(spark: SparkSession, paths: list[str]) -> None:
    """Deletes tables that written() made, in whatever store they are."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
        with contextlib.suppress(ValueError):
            _WRITTEN[spark.sparkContext.applicationId].remove(path)


@contextlib.contextmanager
def temporary(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes at its end what was written within, but for tables passed to the function it gives. What is read later must be passed."""
    mine = _WRITTEN.setdefault(spark.sparkContext.applicationId, [])
    before, kept = set(mine), set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df.quillon_path)
        return df

    try:
        yield keep
    finally:
        discarded(spark, [p for p in mine if p not in before | kept])


def released() -> None:
    """Frees a worker's large model and gives free memory back: workers outlive stages, and the next may need the room."""
    _HELD.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library can give memory back
        ctypes.CDLL(None).malloc_trim(0)


def arrow_map(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table | None], schema: str, rows: int = TEXT_BATCH_ROWS) -> DataFrame:
    """mapInArrow with f called on slices of at most `rows` rows, which bounds a worker's memory whatever the batch size is set to."""
    bounded(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                out = f(batch.slice(at, rows))
                if out is None or out.num_rows == 0:
                    continue
                if isinstance(out, pa.Table):
                    yield from out.to_batches()
                else:
                    yield out

    return df.mapInArrow(run, schema)


def text_bytes(column: pa.Array) -> list[bytes]:
    """A string column's values as UTF-8 bytes; null counts as empty."""
    return [x if x is not None else b"" for x in column.cast(pa.binary()).to_pylist()]


def pressed(column: str, df: DataFrame):
    """A text column of df compressed, since it passes a join's shuffle; null stays null."""
    bounded(df.sparkSession)

    @F.arrow_udf("binary")
    def press(texts: pa.Array) -> pa.Array:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        return pa.array([None if (data := x.as_py()) is None else squeeze(data) for x in texts.cast(pa.binary())], pa.binary())

    return press(column)


def unpressed(z: bytes | None) -> bytes | None:
    return None if z is None else zstandard.ZstdDecompressor().decompress(z)


def clashing(df: DataFrame, *needed: str) -> DataFrame:
    """Only the named columns, whatever else the table carries: extra columns cannot clash with the operators' own names."""
    return df.select(*needed)


_HELD: dict = {}


def held(key, build: Callable):
    """A worker's one large model; a task that brings another frees the last."""
    if key not in _HELD:
        released()
        _HELD[key] = build()
    return _HELD[key]


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have yet."""
    while name in df.columns:
        name = f"_{name}"
    return name


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of undirected edges (a long, b long): rows (node, root), root the smallest node reachable.

    Alternates large-star and small-star steps on written tables, so that every step is two shuffles of at most the number of
    edges and the plan never grows. Ends when a step changes nothing; `rounds` only stops a defect from looping for ever.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    for _ in range(rounds):
        # large star: every neighbour above a node is tied to the smallest of the node and its neighbours
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small star: every neighbour below a node, and the node, are tied to the smallest of them
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        last, now = now, written(small, "edges")
        discarded(now.sparkSession, [last.quillon_path])  # `now` has been made of it and stands on its own
        seen = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first()
        if seen == before:
            break
        before = seen
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
