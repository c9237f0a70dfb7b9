"""Time-series building blocks over rows keyed by (entity, date).

Every window here is partitioned by the entity and ordered by a date that is
unique within it, so one partition never holds more rows than the calendar has days,
however many raw records a hot entity had before they were rolled up.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tickerloom.functions.expr import ratio

# A DATE column has at most this many distinct values (years 1-9999).
DATE_DOMAIN_ROWS = 3_652_059


def by_date(key: str | Sequence[str] = "ticker_usd", date: str = "fecha") -> WindowSpec:
    keys = [key] if isinstance(key, str) else list(key)
    return Window.partitionBy(*keys).orderBy(date)


def trailing(n: int, window: WindowSpec | None = None) -> WindowSpec:
    """The current row and the ``n - 1`` before it."""
    return (window or by_date()).rowsBetween(-(n - 1), 0)


def running(window: WindowSpec | None = None) -> WindowSpec:
    return (window or by_date()).rowsBetween(Window.unboundedPreceding, 0)


def earlier(window: WindowSpec | None = None) -> WindowSpec:
    return (window or by_date()).rowsBetween(Window.unboundedPreceding, -1)


def daily_return(price: str, window: WindowSpec | None = None) -> Column:
    return ratio(F.col(price), F.lag(price).over(window or by_date())) - 1


def newest_first(df: DataFrame, n: int, key: str = "ticker_usd", date: str = "fecha", out: str = "rn") -> DataFrame:
    """The ``n`` newest rows per key, numbered from 1; the cut runs before the shuffle as well."""
    w = Window.partitionBy(key).orderBy(F.col(date).desc())
    return df.withColumn(out, F.row_number().over(w)).filter(F.col(out) <= n)


def known_at_latest(
    df: DataFrame, columns: Sequence[str], key: str = "ticker_usd", date: str = "fecha"
) -> DataFrame:
    """Newest date per key with each column's last non-NULL value: a forward fill read at its last row, as one aggregate."""
    return df.groupBy(key).agg(
        F.max(date).alias(date),
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(date))).alias(c) for c in columns],
    )


def latest_rows(df: DataFrame, key: str = "ticker_usd", date: str = "fecha") -> DataFrame:
    """The newest row per key, as an aggregate (no sort). The date is unique within the key."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(*[F.max_by(c, date).alias(c) for c in rest]).select(*df.columns)


def first_rows(df: DataFrame, key: str = "ticker_usd", date: str = "fecha") -> DataFrame:
    """The oldest row per key, likewise."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(*[F.min_by(c, date).alias(c) for c in rest]).select(*df.columns)


def broadcast_per_date(df: DataFrame) -> DataFrame:
    """Broadcast hint for a table holding one row per calendar date.

    Its rows cannot exceed the DATE domain (a few columns over all of years 1-9999 stay
    under 100 MB), so callers pass only frames of few columns.
    """
    return F.broadcast(df)


def series_by_date(macro: DataFrame, series: dict[str, str]) -> DataFrame:
    """Selected series of a (serie, fecha, valor) table side by side, one row per date."""
    return (
        macro.filter(F.col("serie").isin(*series))
        .groupBy("fecha")
        .agg(*[F.max(F.when(F.col("serie") == s, F.col("valor"))).alias(name) for s, name in series.items()])
    )


def one_key(df: DataFrame) -> WindowSpec:
    """Date order over a table that is a single series (at most one row per date)."""
    return Window.partitionBy(F.lit(0)).orderBy("fecha")


def month_end_closes(prices: DataFrame, price: str = "close") -> DataFrame:
    """Last positive price of each month, dated at the month's end."""
    return (
        prices.filter(F.col(price) > 0)
        .groupBy("ticker_usd", F.last_day("fecha").alias("fin_mes"))
        .agg(F.max_by(price, "fecha").alias(price))
    )


def asof_backward(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    left_on: str,
    right_on: str,
    values: dict[str, str],
    strict: bool = False,
    forward: bool = False,
) -> DataFrame:
    """Attach to each left row the newest right row at or before it (``strict``: before it).

    ``values`` maps right columns to output names. ``forward`` looks for the oldest
    right row at or after instead. Both sides are reduced to distinct (by, date) points before the
    window, so many left rows on one date cost one row there.
    """
    by = list(by)
    reach = by + ["_t"]
    points = left.select(*by, F.col(left_on).alias("_t")).distinct().withColumn("_kind", F.lit(1))
    marks = right.select(
        *by,
        F.col(right_on).alias("_t"),
        F.lit(2 if strict else 0).alias("_kind"),
        F.struct(*[F.col(c).alias(name) for c, name in values.items()]).alias("_v"),
    ).filter(F.col("_t").isNotNull())
    t = F.col("_t").desc() if forward else F.col("_t")
    w = Window.partitionBy(*by).orderBy(t, "_kind").rowsBetween(Window.unboundedPreceding, 0)
    found = (
        points.unionByName(marks, allowMissingColumns=True)
        .withColumn("_v", F.last("_v", ignorenulls=True).over(w))
        .filter(F.col("_kind") == 1)
        .select(*reach, *[F.col(f"_v.{n}").alias(n) for n in values.values()])
    )
    return left.withColumn("_t", F.col(left_on)).join(found, reach, "left").drop("_t")


def calendar_fill(
    prices: DataFrame, calendar: DataFrame, value: str, limit: int = 3, key: str = "ticker_usd"
) -> DataFrame:
    """Align each key to a calendar of trading dates, carrying a value over at most ``limit`` missing dates.

    ``calendar`` has one ``fecha`` per date. Dates outside it are dropped first. Each
    bar emits itself and the gap days it covers, so no key x calendar grid is built.
    Returns key, fecha, idx (position in the calendar) and the value.
    """
    days = calendar.select("fecha", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("fecha")).alias("idx"))
    w = Window.partitionBy(key).orderBy("idx")
    bars = (
        prices.select(key, "fecha", value)
        .filter(F.col(value).isNotNull())
        .join(broadcast_per_date(days), "fecha")
        .withColumn("_next", F.lead("idx").over(w))
    )
    last_idx = days.agg(F.max("idx")).scalar()
    end = F.least(F.col("idx") + limit, F.coalesce(F.col("_next") - 1, last_idx))
    covered = bars.select(key, value, F.explode(F.sequence("idx", end)).alias("idx"))
    return covered.join(broadcast_per_date(days), "idx").select(key, "fecha", "idx", value)


def drawdowns(df: DataFrame, value: str, key: str) -> DataFrame:
    """Add ``maximo`` (running maximum) and ``caida`` (value / running maximum - 1)."""
    return df.withColumn("maximo", F.max(value).over(running(by_date(key)))).withColumn(
        "caida", ratio(value, "maximo") - 1
    )


def drawdown_episodes(df: DataFrame, value: str = "valor", key: str = "serie", threshold: float = -0.10) -> DataFrame:
    """Falls of at least ``threshold`` from a running maximum: (key, pico, piso).

    Each touch of the running maximum starts a stretch; a stretch whose deepest fall
    reaches the threshold is an episode. The peak is the first date of that maximum, the
    trough the first date of the lowest value between the peak and the stretch's end.
    """
    w = by_date(key)
    level = Window.partitionBy(key, "maximo").orderBy("fecha").rowsBetween(Window.unboundedPreceding, 0)
    marked = (
        drawdowns(df.select(key, "fecha", F.col(value).alias("v")).filter(F.col("v").isNotNull()), "v", key)
        .withColumn("tramo", F.sum(F.when(F.col("caida") == 0, 1).otherwise(0)).over(running(w)))
        .withColumn("pico", F.min(F.when(F.col("caida") == 0, F.col("fecha"))).over(level))
        .withColumn("piso_hasta", F.min(F.struct("v", "fecha")).over(level))
    )
    return (
        marked.groupBy(key, "tramo")
        .agg(
            F.min("caida").alias("caida_minima"),
            F.min("pico").alias("episodio_pico"),
            F.max_by("piso_hasta.fecha", "fecha").alias("episodio_piso"),
        )
        .filter(F.col("caida_minima") <= threshold)
        .select(key, "episodio_pico", "episodio_piso", "caida_minima")
    )
