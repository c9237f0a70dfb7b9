"""JSON records with a channel for those that cannot be used.

A record is parsed once with a given schema. What is not JSON, does not fit the schema or fails a check goes to the rejects with every reason, with
the text as it came and the columns that tell where it came from; nothing is dropped silently and one bad line never stops a load.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TEXT, RECORD, REASONS = "texto", "registro", "motivos"
EMPTY, BROKEN = "vacío", "ilegible"


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines of text files (one record each) with the file they stand in."""
    return spark.read.option("recursiveFileLookup", "true").text(path).select(F.col("value").alias(TEXT), F.col("_metadata.file_path").alias("archivo"))


def judged(lines: DataFrame, schema: str, checks: dict[str, Column] | None = None, text: str = TEXT) -> DataFrame:
    """The lines with their ``registro`` (a struct of ``schema``) and ``motivos``: empty where the record is good.

    ``checks`` names conditions on ``registro`` that must be true; unknown counts as failed.
    """
    bare = F.trim(F.col(text))
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_ilegible", "allowNonNumericNumbers": "false"}
    parsed = lines.withColumn(RECORD, F.from_json(F.col(text), f"{schema}, _ilegible string", options))
    empty = F.coalesce(bare == "", F.lit(True))
    broken = ~empty & (F.col(RECORD).isNull() | F.col(f"{RECORD}._ilegible").isNotNull() | ~F.coalesce(bare.startswith("{"), F.lit(False)))
    reasons = [F.when(empty, EMPTY), F.when(broken, BROKEN)]
    reasons += [F.when(~empty & ~broken & ~F.coalesce(condition, F.lit(False)), name) for name, condition in (checks or {}).items()]
    return parsed.withColumn(REASONS, F.array_compact(F.array(*reasons)))


def good(judged_lines: DataFrame) -> DataFrame:
    """Fields of the usable records."""
    fields = [c for c in judged_lines.schema[RECORD].dataType.names if c != "_ilegible"]
    return judged_lines.filter(F.size(REASONS) == 0).select(*[F.col(f"{RECORD}.{c}").alias(c) for c in fields])


def rejected(judged_lines: DataFrame) -> DataFrame:
    """The other lines, as they came, with their reasons."""
    return judged_lines.filter(F.size(REASONS) > 0).drop(RECORD)


def reject_counts(judged_lines: DataFrame) -> DataFrame:
    """Lines by reason; a line with several counts under each."""
    return rejected(judged_lines).select(F.explode(REASONS).alias("motivo")).groupBy("motivo").agg(F.count("*").alias("lineas"))
