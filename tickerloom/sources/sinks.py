"""Outputs: gold views and tables, CSV exports and alert rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def publish_view(df: DataFrame, name: str) -> None:
    """Replace a temporary view: recomputed at every read."""
    df.createOrReplaceTempView(name)


def publish_table(df: DataFrame, name: str) -> None:
    """Replace a stored table with a fresh result."""
    df.write.mode("overwrite").saveAsTable(name)


def export_csv(df: DataFrame, path: str, key: str | None = None) -> None:
    """CSV with a header; with ``key`` one folder per key (one price file set per symbol)."""
    # a key's rows go to few files, and a very frequent key to several tasks
    writer = (df.hint("rebalance", key) if key else df).write.mode("overwrite").option("header", True)
    (writer.partitionBy(key) if key else writer).csv(path)


def alert_rows(monitored: DataFrame, source: str) -> DataFrame:
    """(origen, ticker_usd, alerta) with one row per reason, only where there is one."""
    return monitored.select(F.lit(source).alias("origen"), "ticker_usd", F.explode("alertas").alias("alerta"))


def write_alerts(alerts: DataFrame, path: str) -> None:
    """The alerts of the day as JSON lines; a day without alerts leaves an empty result, not yesterday's."""
    alerts.write.mode("overwrite").json(path)
