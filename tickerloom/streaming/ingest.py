"""File streams into the warehouse, and streaming forms of headline de-duplication and sentiment.

On bounded input each gives the answer of its batch counterpart.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tickerloom.functions.expr import ladder
from tickerloom.operators.news import TONE_THRESHOLD, WINDOW_DAYS
from tickerloom.plans import merge
from tickerloom.sources.warehouse import Warehouse


def file_stream(spark: SparkSession, path: str, schema: str, file_format: str = "json", max_files: int = 1000, **options) -> DataFrame:
    """New files of a folder as a stream, a bounded number per micro-batch."""
    reader = spark.readStream.format(file_format).schema(schema).option("maxFilesPerTrigger", max_files)
    for key, value in options.items():
        reader = reader.option(key, value)
    return reader.load(path)


def upsert_stream(
    stream: DataFrame, warehouse: Warehouse, table: str, checkpoint: str, how: Callable[..., DataFrame] = merge.upsert_overwrite
) -> StreamingQuery:
    """Merge every micro-batch into a table by key, each exactly once: its number is committed with its rows under the checkpoint's name."""

    def write(batch: DataFrame, number: int) -> None:
        warehouse.upsert(table, batch, how, stream=(checkpoint, number))

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def fresh_headlines(stream: DataFrame, delay: str = "7 days") -> DataFrame:
    """Each (ticker, headline) once: the streaming form of keeping only headlines not stored yet."""
    return stream.withWatermark("fecha_publicacion", delay).dropDuplicatesWithinWatermark(["ticker_usd", "titular"])


def sliding_sentiment(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """Counts and signed mean confidence per ticker over seven-day windows sliding by a day.

    A window ends at midnight; ``hasta`` is its last day. The batch sentiment of a day covers that day and the
    seven before it, so windows here are eight days wide.
    """
    label, score = F.col("sentimiento"), F.col("score_sentimiento")
    signed = F.when(label == "positive", score).when(label == "negative", -score).otherwise(0.0)
    mean = F.col("sent_score_promedio")
    return (
        stream.withWatermark("fecha_publicacion", delay)
        .groupBy("ticker_usd", F.window("fecha_publicacion", f"{WINDOW_DAYS + 1} days", "1 day"))
        .agg(
            F.count("*").alias("sent_titulares_total"),
            F.count_if(label == "positive").alias("sent_positivas"),
            F.count_if(label == "negative").alias("sent_negativas"),
            F.count_if(label == "neutral").alias("sent_neutrales"),
            F.avg(signed).alias("sent_score_promedio"),
        )
        .select(
            "ticker_usd", F.date_sub(F.to_date("window.end"), 1).alias("hasta"), "sent_titulares_total", "sent_positivas",
            "sent_negativas", "sent_neutrales", "sent_score_promedio",
            ladder([(mean >= TONE_THRESHOLD, "Positivo"), (mean <= -TONE_THRESHOLD, "Negativo")], "Neutral/Mixto").alias("sent_clasificacion"),
        )
    )
