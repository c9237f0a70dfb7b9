"""Run log: one appended row per run, repeat guards and the state of every job."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.functions.expr import AsOf
from tickerloom.schemas import TABLES


def log_row(
    spark: SparkSession, script: str, started: dt.datetime, ended: dt.datetime, status: str, rows: int | None, error: str | None
) -> DataFrame:
    return spark.createDataFrame([(script, started, ended, status, rows, error)], TABLES["log_ejecuciones"].schema)


class Run:
    """A job while it runs: set ``rows`` inside the block; leaving it stores one row, errors included, and hides none.

    Times are UTC, like the days of the guards.
    """

    def __init__(self, spark: SparkSession, script: str, append: Callable[[DataFrame], None]):
        self.spark, self.script, self.append, self.rows = spark, script, append, None

    def __enter__(self) -> Run:
        self.started = utc_now()
        return self

    def __exit__(self, kind, error, trace) -> bool:
        failed = isinstance(error, Exception)
        if error is None or failed:
            self.append(log_row(self.spark, self.script, self.started, utc_now(), "error" if failed else "ok", self.rows, str(error) if failed else None))
        return False


def utc_now() -> dt.datetime:
    return dt.datetime.now(dt.timezone.utc)


def ran_since(log: DataFrame, as_of: AsOf, days: int = 0) -> DataFrame:
    """Jobs with a good run since midnight of the day ``days`` before ``as_of``: (script, corridas_ok).

    ``days=0`` is "ran today" by the calendar; a run yesterday evening does not count.
    """
    day = F.date_sub(as_of if not isinstance(as_of, dt.date) else F.lit(as_of), days).cast("timestamp")
    good = log.filter((F.col("estado") == "ok") & (F.col("inicio") >= day))
    return good.groupBy("script").agg(F.count("*").alias("corridas_ok"))


def has_run(log: DataFrame, script: str, as_of: dt.date, days: int = 0) -> bool:
    return not ran_since(log.filter(F.col("script") == script), as_of, days).isEmpty()


def run_status(log: DataFrame) -> DataFrame:
    """Last run, last good run and error count of each job."""
    ok = F.col("estado") == "ok"
    return log.groupBy("script").agg(
        F.max("inicio").alias("ultima_corrida"),
        F.max(F.when(ok, F.col("inicio"))).alias("ultima_corrida_ok"),
        F.count_if(F.col("estado") == "error").alias("errores_totales"),
    )


def last_errors(log: DataFrame, n: int = 5) -> DataFrame:
    return log.filter(F.col("estado") == "error").orderBy(F.col("inicio").desc(), "script").limit(n).select(
        "script", "inicio", "error_detalle"
    )
