"""From documents to packed training sequences, in stages that each take what the one before kept.

A stage takes (spark, docs, sf_dir) and returns rows of documents, the last one pieces of sequences. Between stages the rows are written and read
again, so that a lost executor repeats one stage at most. Null and empty texts have no language and leave at the first stage; an empty table stays
empty. Columns besides those of documents are handed on by all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickerloom.llm import exact, language, leaks, near, packing
from tickerloom.llm.shared import stored


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in some language; texts without a letter go."""
    return language.with_language(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space, the one with the smallest doc_id."""
    return exact.without_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by five-word runs (similarity of 0.8 or more), the one with the smallest doc_id."""
    return near.one_of_each_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window stands."""
    return leaks.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences whose mixture of sources is that of the documents."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packed),
]

# Trees of byte contexts, token ids and signatures are beyond SQL; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
