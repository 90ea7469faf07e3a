"""Tables that are built once and read by many queries, such as the index: written to the shared folder, kept for the session."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillon.tables import deleted, scratch

_PATHS: dict[tuple[str, str, str], str] = {}
_FRAMES: dict[tuple[str, str, str], DataFrame] = {}


def stored(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _PATHS:
        path = scratch(spark)
        build().write.option("compression", "zstd").parquet(path)
        _PATHS[key] = path
    return spark.read.parquet(_PATHS[key])


def held(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """As stored(), of a frame that build has written itself and that reads what is written."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _FRAMES:
        _FRAMES[key] = build()
    return _FRAMES[key]


def forget(spark: SparkSession) -> None:
    """Deletes what this application has stored."""
    for key in [k for k in _PATHS if k[0] == spark.sparkContext.applicationId]:
        deleted(spark, _PATHS.pop(key))
    for key in [k for k in _FRAMES if k[0] == spark.sparkContext.applicationId]:
        for path in {f.rsplit("/", 1)[0] for f in _FRAMES.pop(key).inputFiles()}:
            deleted(spark, path)
