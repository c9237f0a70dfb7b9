"""Loading of downloaded files: what is new in a folder, into a table, once.

A ledger of the files loaded so far (path, length, time of change) stands in the warehouse. A run lists the folder as a frame, takes the files the
ledger lacks, merges their rows and commits rows and ledger together: a second run reads no file, a run that dies leaves neither. A file that was
changed is new. The guard skips a feed that has run recently enough; every run leaves its row in the run log, failed ones too, and a failure
does not keep later feeds from loading.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.plans import merge, runlog
from tickerloom.sources.warehouse import Warehouse

LEDGER = "archivos_cargados"


@dataclass(frozen=True)
class Feed:
    """Files of one kind: how they are read, what rows they give, and how those enter ``table``."""

    name: str
    table: str
    folder: str
    read: Callable[[SparkSession, list[str]], DataFrame]
    rows: Callable[[DataFrame], DataFrame]
    how: Callable[..., DataFrame] = merge.upsert_overwrite
    guard_days: int | None = None  # a good run of the last so many days (0: today) makes another unnecessary


@dataclass(frozen=True)
class Loaded:
    files: int
    rows: int
    skipped: bool = False


def _plain(path: Column) -> Column:
    """Paths without scheme, as listings and readers write it differently."""
    return F.regexp_replace(path, r"^[A-Za-z0-9]+:/+", "/")


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """Files under a folder: ruta, bytes, modificado. Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select(_plain(F.col("path")).alias("ruta"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modificado"), F.col("path").alias("_path"))


def new_files(wh: Warehouse, feed: Feed) -> DataFrame:
    """Files of the feed's folder that the ledger does not have in this state."""
    seen = wh.read(LEDGER).filter(F.col("carga") == feed.name).select("ruta", "bytes", "modificado")
    return listing(wh.spark, feed.folder).join(seen, ["ruta", "bytes", "modificado"], "left_anti")


def load(wh: Warehouse, feed: Feed, as_of: dt.date | None = None) -> Loaded:
    """Merge the feed's new files into its table."""
    if as_of is not None and feed.guard_days is not None and runlog.has_run(wh.read("log_ejecuciones"), feed.name, as_of, feed.guard_days):
        return Loaded(0, 0, True)
    with wh.logged(feed.name) as log:
        fresh = new_files(wh, feed)
        found = fresh.collect()  # names of new files, which the reader needs
        log.rows = 0
        if not found:
            return Loaded(0, 0)
        raw = feed.read(wh.spark, [f["_path"] for f in found])
        counts = raw.groupBy(_plain(F.col("_metadata.file_path")).alias("ruta")).agg(F.count("*").alias("filas"))
        known = wh.spark.createDataFrame([tuple(f)[:3] for f in found], "ruta string, bytes long, modificado timestamp")
        ledger = known.join(counts, "ruta", "left").select(
            F.lit(feed.name).alias("carga"), "ruta", "bytes", "modificado", F.coalesce("filas", F.lit(0)).alias("filas"), F.current_timestamp().alias("cargado")
        )
        wh.upsert(feed.table, feed.rows(raw), feed.how, alongside=(LEDGER, ledger))
        entered = wh.read(LEDGER).filter(F.col("carga") == feed.name).join(known, ["ruta", "bytes", "modificado"], "left_semi")
        log.rows = entered.agg(F.coalesce(F.sum("filas"), F.lit(0))).first()[0]
        return Loaded(len(found), log.rows)


def load_all(wh: Warehouse, feeds: list[Feed], as_of: dt.date | None = None) -> dict[str, Loaded | Exception]:
    """Every feed in order; one that fails is logged and reported, and the next ones load."""
    done: dict[str, Loaded | Exception] = {}
    for feed in feeds:
        try:
            done[feed.name] = load(wh, feed, as_of)
        except Exception as error:  # in the run log and in what is returned
            done[feed.name] = error
    return done
