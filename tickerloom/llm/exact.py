"""Exact duplicates by merging sorted runs of digests in a tree.

Each input partition makes one run: digests in order, every digest once with the smallest doc_id and the number of rows. In
round r all runs that agree but for digit r of their number exchange: an entry goes to the run whose digit r is that of its
digest, and the runs that arrive there are merged in order. After all rounds a digest is in one run only, and no run ever
held more than its share of the distinct digests, however large a group of copies is.

Null text counts as empty, all empty texts are equal. Rows with the same doc_id and text count as rows of one group; a null doc_id
is larger than any other. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.llm.shared import BLANKS, free_name, stored, texts_of

KEY = ["digest", "n_bytes", "check"]  # entries are one text only if digest, length and a second hash agree
FAN = 8


def normalised(text):
    return F.regexp_replace(text, BLANKS, " ")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id and the key of the normalised text."""
    return texts_of(docs).withColumn("text", normalised(F.col("text"))).select("doc_id", *_key(F.col("text")))


def _key(text):
    return [F.unhex(F.sha2(text, 256)).alias("digest"), F.octet_length(text).alias("n_bytes"), F.xxhash64(text).alias("check")]


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adjacent entries of one key become one: the first (smallest) keep_id, the sum of the sizes. Holds one batch."""
    rest = None
    for batch in batches:
        part = pa.table(batch.columns, names=batch.schema.names)
        part = part if rest is None else pa.concat_tables([rest, part])
        part = part.combine_chunks()
        if not part.num_rows:
            continue
        new = np.ones(part.num_rows, bool)
        new[1:] = False
        for name in ["run", *KEY]:
            c = part.column(name)
            new[1:] |= pc.not_equal(c.slice(1), c.slice(0, part.num_rows - 1)).to_numpy(zero_copy_only=False)
        first = np.flatnonzero(new)
        sizes = np.add.reduceat(part.column("group_size").to_numpy(), first)
        part = part.take(pa.array(first))
        part = part.set_column(part.column_names.index("group_size"), "group_size", pa.array(sizes))
        rest = part.slice(part.num_rows - 1)
        yield from part.slice(0, part.num_rows - 1).to_batches()
    if rest is not None:
        yield from rest.to_batches()


def merge_tree(keys: DataFrame, fan: int = FAN) -> DataFrame:
    """One row per distinct key: keep_id (smallest doc_id) and group_size, by rounds of exchanges between ``fan`` runs each."""
    wanted = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rounds = 1
    while fan**rounds < wanted:
        rounds += 1
    runs = keys.select(F.pmod(F.spark_partition_id(), F.lit(fan**rounds)).cast("int").alias("run"), *KEY, F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    order = ["run", *KEY, F.col("keep_id").asc_nulls_last()]
    schema = runs.schema
    runs = runs.sortWithinPartitions(*order).mapInArrow(_merged, schema)
    for r in range(rounds):
        unit = fan**r
        digit = F.pmod(F.floor(F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long") / unit), F.lit(fan))
        own = F.pmod(F.floor(F.col("run") / unit), F.lit(fan))
        runs = runs.withColumn("run", (F.col("run") + (digit - own) * unit).cast("int")).select(schema.names)
        runs = runs.repartition(fan**rounds, "run").sortWithinPartitions(*order).mapInArrow(_merged, schema)
    return runs.drop("run")


def exact_groups(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row."""
    keys = stored(digests(docs), "digests")
    groups = merge_tree(keys)
    return keys.join(groups, KEY).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def without_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns. Of rows with the same doc_id and text one stays."""
    text = normalised(F.coalesce(F.col("text"), F.lit("")))
    names = {k: free_name(docs, k) for k in [*KEY, "keep_id"]}
    keyed = docs.select(*docs.columns, *[c.alias(names[k]) for c, k in zip(_key(text), KEY)], F.col("doc_id").cast("long").alias(names["keep_id"]))
    groups = merge_tree(stored(digests(docs), "digests")).select(*[F.col(k).alias(v) for k, v in names.items()])
    same = [keyed[v].eqNullSafe(groups[v]) for v in names.values()]
    return keyed.join(groups, same, "left_semi").dropDuplicates(list(names.values())).select(*docs.columns)
