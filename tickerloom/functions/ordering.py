"""Exact order statistics for groups too large for one task.

A plain ``rank`` or ``percentile`` over (sector) sends a whole sector to one task,
and over nothing at all sends the table there. Here equal values are counted
first (map-side combined), values are cut into buckets by an order-preserving
formula, each (group, bucket) is numbered by itself and the bucket totals, some
thousands of rows per group, supply the offsets. The bucket is a pure function of the
value, so a recomputed task always lands on the same numbers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS_PER_OCTAVE = 1024
# Doubles span 2^-1074 .. 2^1024; the offset keeps every exponent positive.
_EXPONENT_OFFSET = 1100 * BUCKETS_PER_OCTAVE
_INFINITY_BUCKET = 4 * _EXPONENT_OFFSET


def value_bucket(v: Column) -> Column:
    """Order-preserving bucket number of a double: x <= y implies bucket(x) <= bucket(y)."""
    magnitude = F.abs(v)
    finite = F.floor(F.log2(magnitude) * BUCKETS_PER_OCTAVE).cast("long") + _EXPONENT_OFFSET
    size = F.when(magnitude == F.lit(float("inf")), F.lit(_INFINITY_BUCKET)).otherwise(finite)
    return F.when(v == 0, F.lit(0)).when(v > 0, size).otherwise(-size).cast("long")


def value_positions(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """One row per (keys, distinct non-NULL value): n_eq equal rows, n_before smaller rows, n_total rows of the group."""
    keys = list(keys)
    v = F.col(value).cast("double")
    counts = (
        df.select(*keys, v.alias(value))
        .filter(F.col(value).isNotNull() & ~F.isnan(value))
        .groupBy(*keys, value)
        .agg(F.count("*").alias("n_eq"))
        .withColumn("_bucket", value_bucket(F.col(value)))
    )
    before = Window.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    local = counts.withColumn(
        "_local",
        F.coalesce(F.sum("n_eq").over(before.partitionBy(*keys, "_bucket")), F.lit(0)),
    )
    cells = counts.groupBy(*keys, "_bucket").agg(F.sum("n_eq").alias("_n"))
    in_group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    offsets = cells.select(
        *keys,
        "_bucket",
        F.coalesce(
            F.sum("_n").over(in_group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("_offset"),
        F.sum("_n").over(in_group).alias("n_total"),
    )
    return local.join(offsets, [*keys, "_bucket"]).select(
        *keys, value, "n_eq", (F.col("_offset") + F.col("_local")).alias("n_before"), "n_total"
    )


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]
) -> DataFrame:
    """Linearly interpolated quantiles of ``value`` per group; ``probs`` maps output names to probabilities."""
    keys = list(keys)
    positions = value_positions(df, keys, value)
    aggs, finals = [], []
    for name, p in probs.items():
        at = (F.col("n_total") - 1) * F.lit(float(p))
        for part, index in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            hit = (F.col("n_before") <= index) & (index < F.col("n_before") + F.col("n_eq"))
            aggs.append(F.max(F.when(hit, F.col(value))).alias(f"_{name}_{part}"))
        aggs.append(F.max(at - F.floor(at)).alias(f"_{name}_f"))
        lo, hi, f = (F.col(f"_{name}_{s}") for s in ("lo", "hi", "f"))
        finals.append((lo + (hi - lo) * f).alias(name))
    grouped = positions.groupBy(*keys) if keys else positions.groupBy()
    return grouped.agg(*aggs).select(*keys, *finals)


def with_rank_pcts(df: DataFrame, ranks: dict[str, str], id_column: str) -> DataFrame:
    """Add the average-tie percentile rank (0-1] of several columns over the whole frame; NULL values keep a NULL rank.

    ``ranks`` maps columns to output names, ``id_column`` is unique per row. All columns are ranked in one pass as
    (column, value) groups, whatever their number.
    """
    long = df.select(id_column, *[F.col(c).cast("double").alias(c) for c in ranks]).unpivot(
        [id_column], list(ranks), "_m", "_v"
    ).filter(F.col("_v").isNotNull())
    placed = value_positions(long, ["_m"], "_v").select(
        "_m", "_v", ((F.col("n_before") + (F.col("n_eq") + 1) / 2) / F.col("n_total")).alias("_p")
    )
    wide = (
        long.join(placed, ["_m", "_v"])
        .groupBy(id_column)
        .agg(*[F.max(F.when(F.col("_m") == c, F.col("_p"))).alias(out) for c, out in ranks.items()])
    )
    return df.join(wide, id_column, "left")


def with_rank_pct(df: DataFrame, value: str, out: str, keys: Sequence[str] = ()) -> DataFrame:
    """Add the average-tie percentile rank of ``value`` (0-1] within ``keys``; NULL values keep a NULL rank."""
    keys = list(keys)
    ranks = value_positions(df, keys, value).select(
        *keys,
        F.col(value).alias("_v"),
        ((F.col("n_before") + (F.col("n_eq") + 1) / 2) / F.col("n_total")).alias(out),
    )
    left = df.withColumn("_v", F.col(value).cast("double"))
    return left.join(ranks, [*keys, "_v"], "left").drop("_v")


def with_percent_rank(df: DataFrame, value: str, out: str, keys: Sequence[str]) -> DataFrame:
    """Add PERCENT_RANK of ``value`` within ``keys``, NULL values last and tied with each other."""
    keys = list(keys)
    v = F.col(value).cast("double")
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_rows"), F.count(v).alias("_known"))
    ranks = value_positions(df, keys, value).select(*keys, F.col(value).alias("_v"), F.col("n_before").alias("_before"))
    return (
        df.withColumn("_v", v)
        .join(ranks, [*keys, "_v"], "left")
        .join(sizes, keys)
        .withColumn(
            out,
            F.coalesce(
                F.try_divide(F.coalesce(F.col("_before"), F.col("_known")), F.col("_rows") - 1), F.lit(0.0)
            ),
        )
        .drop("_v", "_before", "_rows", "_known")
    )


def with_position(df: DataFrame, keys: Sequence[str], value: str, tie: str, out: str) -> DataFrame:
    """Add the 1-based position within ``keys`` ordered by ``value`` (NULL last), ties in md5 order of ``tie``.

    Ties are cut again by the leading md5 digits, so neither a hot group nor one
    value shared by much of a group is numbered in a single task.
    """
    keys = list(keys)
    placed = (
        df.withColumn("_v", F.coalesce(F.col(value).cast("double"), F.lit(float("inf"))))
        .withColumn("_md5", F.md5(F.col(tie).cast("string").cast("binary")))
        .withColumn("_cell", F.substring("_md5", 1, 3))
    )
    before = value_positions(placed, keys, "_v").select(*keys, "_v", "n_before")
    in_tie = Window.partitionBy(*keys, "_v").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = (
        placed.groupBy(*keys, "_v", "_cell")
        .agg(F.count("*").alias("_n"))
        .withColumn("_earlier", F.coalesce(F.sum("_n").over(in_tie), F.lit(0)))
        .join(before, [*keys, "_v"])
        .select(*keys, "_v", "_cell", (F.col("n_before") + F.col("_earlier")).alias("_base"))
    )
    in_cell = Window.partitionBy(*keys, "_v", "_cell").orderBy("_md5")
    return (
        placed.withColumn("_rn", F.row_number().over(in_cell))
        .join(cells, [*keys, "_v", "_cell"])
        .withColumn(out, F.col("_base") + F.col("_rn"))
        .drop("_v", "_md5", "_cell", "_rn", "_base")
    )
