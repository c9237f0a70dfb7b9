"""Folders for what a job writes and reads again: in ``spark.checkpoint.dir``, which all executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name. A local session that names no shared folder (as in tests) gets one of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = _own.setdefault("path", "file://" + tempfile.mkdtemp(prefix="tickerloom-"))
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


# Spark drops the shuffle files of a query that has ended; without it they lie on the disks until the driver collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is written meanwhile leaves none of its shuffle files behind."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a scratch folder and read back: a job that reads it in several places works it out once."""
    spark, folder = df.sparkSession, scratch(df.sparkSession, name)
    with shuffles_dropped(spark):
        df.write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def stored_by(df: DataFrame, key: str, order: str, name: str) -> DataFrame:
    """``df`` stored with the rows of each ``key`` in one file, in ``order``: an aggregate by ``key`` is nearly done before its shuffle."""
    return stored(df.repartition(key).sortWithinPartitions(key, order), name)
