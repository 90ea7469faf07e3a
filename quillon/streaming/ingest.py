"""Incremental ingest as Structured Streaming: idempotent upserts and tombstones in foreachBatch. Event-time windows are an extension."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillon.operators import merge as M


#: Buckets of a table of records: a batch rewrites those of its keys.
BUCKETS = 16


class RecordTable:
    """A table of records as numbered Parquet versions; the newest complete version is the state. A batch that is replayed writes the same
    version again, so upserts are applied once in effect. Rows lie in BUCKETS by a hash of their key; a version's folder holds the buckets
    it changed, a bucket is read from the newest version that has it, and versions of which none is read any more go."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path, buckets

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, path: str) -> list[str]:
        at, fs = self._fs(path)
        return [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []

    def _newest(self, before: int | None = None) -> dict[int, int]:
        """bucket -> newest complete version that has it."""
        newest: dict[int, int] = {}
        for v in sorted(int(n[2:]) for n in self._names(self.path) if n.startswith("v=")):
            names = self._names(f"{self.path}/v={v}")
            if "_SUCCESS" in names and (before is None or v < before):
                newest |= {int(n.split("=")[1]): v for n in names if n.startswith("bucket=")}
        return newest

    def bucket(self, key: str):
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def read(self, before: int | None = None, only: list[int] | None = None) -> DataFrame | None:
        """The state, or its rows in some buckets."""
        found = [f"{self.path}/v={v}/bucket={b}" for b, v in sorted(self._newest(before).items()) if only is None or b in only]
        found = [f for f in found if any(n.startswith("part-") for n in self._names(f))]
        return self.spark.read.parquet(*found) if found else None

    def write(self, df: DataFrame, version: int, key: str, touched: list[int]) -> None:
        """The rows of the touched buckets; of one that lost all its rows the empty folder says so."""
        made = os.path.join(self.path, f"v={version}")
        df.withColumn("bucket", self.bucket(key)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(made)
        for b in touched:
            at, fs = self._fs(f"{made}/bucket={b}")
            fs.mkdirs(at)
        needed = set(self._newest().values()) | set(self._newest(version).values())  # the last batch may be replayed on what it read
        for name in self._names(self.path):
            if name.startswith("v=") and int(name[2:]) not in needed | {version}:
                at, fs = self._fs(f"{self.path}/{name}")
                fs.delete(at, True)


def apply_batch(table: RecordTable, key: str, arrival: list[str], source: str, deleted: str, columns: list[str], label: str):
    """A foreachBatch function that folds a batch into the table."""

    def run(batch: DataFrame, number: int) -> None:
        version = number + 1
        batch = batch.persist()
        touched = [x.b for x in batch.select(table.bucket(key).alias("b")).distinct().collect()]  # at most a row a bucket
        gone = batch.withColumn("__at", F.struct(*arrival)).groupBy(key).agg(F.max(F.when(F.col(deleted), F.col("__at"))).alias("g")).where("g is not null").select(key)
        new = M.folded(batch, key, arrival, source, deleted, columns, label)
        old = table.read(before=version, only=touched)  # the buckets that the batch touches are rewritten, no other
        if old is None:
            table.write(new, version, key, touched)
            batch.unpersist()
            return
        kept = old.join(gone, key, "left_anti")  # a tombstone resets what was before it
        names = [key, *columns, label, source]
        o = kept.select(F.col(key), F.struct(*names[1:]).alias("o"))
        n = new.select(F.col(key), F.struct(*names[1:]).alias("n"))
        both = o.join(n, key, "full")
        gate = F.col("o").isNull() | (F.col("n").isNotNull() & (M.rank(F.col(f"n.{source}")) >= M.rank(F.col(f"o.{source}"))))
        pick = [F.when(F.col("n").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in columns]
        tags = [F.when(gate, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in (label, source)]
        table.write(both.select(key, *pick, *tags), version, key, touched)
        batch.unpersist()

    return run


def ingest(stream: DataFrame, table: RecordTable, checkpoint: str, key: str, arrival: list[str], source: str, deleted: str, columns: list[str], label: str) -> StreamingQuery:
    """Starts the upsert of a stream of versions and tombstones; a checkpoint moves on only after its batch is written."""
    return stream.writeStream.foreachBatch(apply_batch(table, key, arrival, source, deleted, columns, label)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def window_counts(events: DataFrame, width: str = "1 day", late: str | None = None) -> DataFrame:
    """(window_start, event_type, n) by event time; `late` sets a watermark."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if late:
        timed = timed.withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "event_type", "n")


def run_to_table(df: DataFrame, checkpoint: str) -> DataFrame:
    """Runs a bounded stream of aggregates to its end and returns its result table. Each batch writes the whole result as a table of its
    own; the last one is read, so nothing passes the driver."""
    made: list[str] = []

    def keep(batch: DataFrame, number: int) -> None:
        made.append(f"{checkpoint}-result/{number}")
        batch.write.mode("overwrite").parquet(made[-1])

    df.writeStream.foreachBatch(keep).outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(made[-1])
