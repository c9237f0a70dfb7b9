"""Research reports: data profile, return profile, event windows and series summaries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.functions.expr import as_of_date, change_pct, ratio
from tickerloom.functions.ordering import exact_quantiles
from tickerloom.functions.series import asof_backward, by_date

BEFORE_ROWS, AFTER_ROWS, PRE_EVENT_ROWS = 60, (20, 60, 120), 126
GROWTH_RANGE, ACCELERATION_RANGE, USABLE_PE = (-50, 100), (-100, 100), (0, 80)


def null_shares(df: DataFrame, columns: list[str]) -> DataFrame:
    """Share of NULLs per column, in one pass: (columna, nulos_pct)."""
    row = df.agg(*[(F.avg(F.col(c).isNull().cast("int")) * 100).alias(c) for c in columns])
    return row.unpivot([], columns, "columna", "nulos_pct")


def describe_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, mean, deviation, range and exact quartiles per column: (columna, n, media, desvio, minimo, p25, p50, p75, maximo)."""
    long = df.select(*columns).unpivot([], columns, "columna", "valor").filter(F.col("valor").isNotNull())
    basic = long.groupBy("columna").agg(
        F.count("*").alias("n"), F.avg("valor").alias("media"), F.stddev_samp("valor").alias("desvio"),
        F.min("valor").alias("minimo"), F.max("valor").alias("maximo"),
    )
    return basic.join(exact_quantiles(long, ["columna"], "valor", {"p25": 0.25, "p50": 0.5, "p75": 0.75}), "columna")


def clip_quantiles(df: DataFrame, column: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Known values of a column cut off at two quantiles, in ``recortado``."""
    bounds = exact_quantiles(df, [], column, {"lo": low, "hi": high}).select(F.struct("lo", "hi").alias("q")).scalar()
    return (
        df.filter(F.col(column).isNotNull())
        .withColumn("_q", bounds)
        .withColumn("recortado", F.least(F.greatest(F.col(column), F.col("_q.lo")), F.col("_q.hi")))
        .drop("_q")
    )


def total_returns(prices: DataFrame, dim: DataFrame) -> DataFrame:
    """Return from the first to the last known price."""
    known = prices.filter(F.col("adj_close").isNotNull())
    return (
        known.groupBy("ticker_usd")
        .agg(change_pct(F.max_by("adj_close", "fecha"), F.min_by("adj_close", "fecha")).alias("retorno_total_pct"))
        .join(dim.select("ticker_usd", "nombre_empresa", "sector"), "ticker_usd")
    )


def rebased(prices: DataFrame, tickers: list[str]) -> DataFrame:
    """Prices of a few tickers with their first one at 100."""
    w = by_date().rowsBetween(Window.unboundedPreceding, 0)
    return prices.filter(F.col("ticker_usd").isin(tickers) & F.col("adj_close").isNotNull()).select(
        "ticker_usd", "fecha", (ratio("adj_close", F.first("adj_close").over(w)) * 100).alias("base_100")
    )


def value_vs_growth(latest: DataFrame) -> DataFrame:
    """Companies growing faster than the median at a P/E below the median. ``latest``: one row per company."""
    pe, growth = F.col("pe_trailing"), F.col("crecimiento_ingresos_anual_pct")
    lo, hi = USABLE_PE
    usable = latest.filter((pe > lo) & (pe < hi) & growth.isNotNull())
    m_pe = exact_quantiles(usable, [], "pe_trailing", {"m": 0.5}).scalar()
    m_growth = exact_quantiles(usable, [], "crecimiento_ingresos_anual_pct", {"m": 0.5}).scalar()
    return usable.filter((growth > m_growth) & (pe < m_pe))


def growth_acceleration(latest: DataFrame) -> DataFrame:
    """Growth against acceleration without the extremes."""
    return latest.filter(
        F.col("crecimiento_ingresos_anual_pct").between(*GROWTH_RANGE) & F.col("aceleracion_ingresos_pct").between(*ACCELERATION_RANGE)
    )


def extremes(df: DataFrame, column: str, n: int = 15, tie: str = "ticker_usd") -> DataFrame:
    """The ``n`` highest and ``n`` lowest rows by a column, marked in ``extremo``."""
    known = df.filter(F.col(column).isNotNull())
    top = known.orderBy(F.col(column).desc(), tie).limit(n).withColumn("extremo", F.lit("alto"))
    bottom = known.orderBy(F.col(column).asc(), tie).limit(n).withColumn("extremo", F.lit("bajo"))
    return top.unionByName(bottom)


def crosstab(df: DataFrame, rows: str, columns: str) -> DataFrame:
    return df.groupBy(rows, columns).agg(F.count("*").alias("n"))


def compression(tech: DataFrame) -> DataFrame:
    """Bollinger width relative to the ticker's own daily movement; low means compressed."""
    return tech.withColumn("compresion", ratio("tech_bb_ancho_pct", "tech_atr14_pct")).filter(F.col("compresion").isNotNull())


def _indexed(series: DataFrame) -> DataFrame:
    """(serie, fecha, valor) with ``idx`` from 1 and ``n`` rows per series."""
    return series.withColumn("idx", F.row_number().over(by_date("serie"))).withColumn(
        "n", F.count("*").over(Window.partitionBy("serie"))
    )


def _anchored(indexed: DataFrame, events: dict[str, dt.date]) -> DataFrame:
    """Each (evento, serie) with the last row before the event; only where a row on or after it exists."""
    listed = F.array(*[F.struct(F.lit(name).alias("evento"), F.lit(day).alias("fecha_evento")) for name, day in events.items()])
    pairs = indexed.select("serie").distinct().select("serie", F.explode(listed).alias("e")).select(
        "serie", "e.evento", "e.fecha_evento"
    )
    eve = asof_backward(
        pairs, indexed, ["serie"], "fecha_evento", "fecha", {"idx": "idx0", "valor": "base", "n": "n"}, strict=True
    )
    return eve.filter(F.col("idx0").isNotNull() & (F.col("idx0") < F.col("n")))


def event_window(series: DataFrame, events: dict[str, dt.date], before: int = BEFORE_ROWS, after: tuple[int, ...] = AFTER_ROWS) -> DataFrame:
    """Return of each series over the rows before an event's eve and over the rows after it.

    ``series``: (serie, fecha, valor); ``events``: date per event name. Rows meet by position.
    """
    indexed = _indexed(series)
    offsets = [-before, *after]
    wanted = _anchored(indexed, events).filter(F.col("idx0") - before >= 1).select(
        "evento", "serie", "base", "idx0", F.explode(F.array(*[F.lit(o) for o in offsets])).alias("o")
    ).withColumn("idx", F.col("idx0") + F.col("o"))
    met = wanted.join(indexed.select("serie", "idx", "valor"), ["serie", "idx"], "left")
    value = lambda o: F.max(F.when(F.col("o") == o, F.col("valor")))
    base = F.max("base")
    return met.groupBy("evento", "serie").agg(
        change_pct(base, value(-before)).alias(f"antes_{before}_pct"),
        *[change_pct(value(o), base).alias(f"mas_{o}_pct") for o in after],
    )


def pre_event_minimum(series: DataFrame, events: dict[str, dt.date], rows: int = PRE_EVENT_ROWS, ahead: int = 60) -> DataFrame:
    """The low of the rows before each event: when, how deep below the preceding high, and the rebound to the eve and beyond."""
    indexed = _indexed(series)
    anchored = _anchored(indexed, events)
    span = anchored.select(
        "evento", "fecha_evento", "serie", "base", "idx0",
        F.explode(F.sequence(F.greatest(F.col("idx0") - (rows - 1), F.lit(1)), F.col("idx0"))).alias("idx"),
    ).join(indexed.select("serie", "idx", "fecha", "valor"), ["serie", "idx"])
    keys = ["evento", "serie"]
    w = Window.partitionBy(*keys).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    low = (
        span.withColumn("maximo", F.max("valor").over(w))
        .groupBy(*keys)
        .agg(
            F.min(F.struct("valor", "idx", "fecha", "maximo")).alias("m"),
            F.max("base").alias("base"), F.max("fecha_evento").alias("fecha_evento"), F.max("idx0").alias("idx0"),
        )
    )
    later = indexed.select("serie", (F.col("idx") - ahead).alias("idx0"), F.col("valor").alias("v_mas"))
    return low.join(later, ["serie", "idx0"], "left").select(
        *keys, F.col("m.fecha").alias("fecha_minimo"), F.datediff("fecha_evento", F.col("m.fecha")).alias("dias_antes"),
        change_pct(F.col("m.valor"), F.col("m.maximo")).alias("caida_pct"),
        change_pct(F.col("base"), F.col("m.valor")).alias("hasta_vispera_pct"),
        change_pct(F.col("v_mas"), F.col("m.valor")).alias(f"hasta_mas_{ahead}_pct"),
    )


def series_summary(series: DataFrame, since: dt.date | Column, months: tuple[int, ...] = (1, 3, 6, 12)) -> DataFrame:
    """Returns over calendar months up to each series' last date, its maximum since a date, and the low after it."""
    start = since if isinstance(since, Column) else F.lit(since)
    last = series.groupBy("serie").agg(F.max("fecha").alias("hoy"), F.max_by("valor", "fecha").alias("ult"))
    points = last.select(
        "serie", "ult", F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.add_months("hoy", -m).alias("t")) for m in months])).alias("p")
    ).select("serie", "ult", "p.m", "p.t")
    past = asof_backward(points, series, ["serie"], "t", "fecha", {"valor": "v"})
    changes = past.groupBy("serie").agg(
        *[F.max(F.when(F.col("m") == m, change_pct("ult", "v"))).alias(f"ret_{m}m_pct") for m in months]
    )
    recent = series.filter(F.col("fecha") >= start)
    top = recent.groupBy("serie").agg(F.min(F.struct((-F.col("valor")).alias("v"), "fecha")).alias("t")).select(
        "serie", (-F.col("t.v")).alias("maximo"), F.col("t.fecha").alias("fecha_maximo")
    )
    low = (
        recent.join(top, "serie").filter(F.col("fecha") >= F.col("fecha_maximo"))
        .groupBy("serie")
        .agg(F.min(F.struct("valor", "fecha")).alias("l"))
    )
    return (
        last.join(changes, "serie").join(top, "serie").join(low, "serie")
        .select(
            "serie", *[f"ret_{m}m_pct" for m in months], "fecha_maximo", change_pct("ult", "maximo").alias("desde_maximo_pct"),
            F.col("l.fecha").alias("fecha_minimo_posterior"), change_pct("ult", F.col("l.valor")).alias("desde_minimo_pct"),
        )
    )


def country_vehicles(
    dim: DataFrame, market: str, country: str, excluded: tuple[str, ...] = (), duplicates: dict[str, str] | None = None
) -> DataFrame:
    """Companies of a country by how they are listed: on its own market, or abroad with that country of origin.

    ``country`` is matched anywhere in the name, whatever its case. ``duplicates`` names, for a symbol, the other one of
    the same company.
    """
    local = F.col("mercado") == market
    abroad = (F.col("mercado") == "usa_otros") & F.col("pais_origen").ilike(f"%{country}%")
    twin = F.lit(None).cast("string")
    for symbol, other in (duplicates or {}).items():
        twin = F.when(F.col("ticker_usd") == symbol, other).otherwise(twin)
    return (
        dim.filter((local & ~F.col("ticker_usd").isin(*excluded)) | abroad)
        .withColumn("vehiculo", F.when(local, "BDR").otherwise("ADR directo"))
        .withColumn("duplica_de", twin)
    )


def country_ranking(vehicles: DataFrame, styles: DataFrame, comps: DataFrame, clean: DataFrame, exposure: DataFrame) -> DataFrame:
    """The companies of a country with checklist, sector discount, currency-clean return and exposures; best first."""
    return (
        styles.select("ticker_usd", "nombre_empresa", "lynch_categoria_auto", "lynch_checklist_score", "lynch_valuacion_peg")
        .join(vehicles.select("ticker_usd", "vehiculo", "duplica_de"), "ticker_usd")
        .join(comps.select("ticker_usd", "comp_pe_vs_sector_pct", "comp_percentil_crecimiento_en_sector"), "ticker_usd")
        .join(clean.select("ticker_usd", "retorno_limpio_pct"), "ticker_usd", "left")
        .join(exposure.drop("dias_muestra"), "ticker_usd")
        .orderBy(F.col("lynch_checklist_score").desc(), F.col("comp_pe_vs_sector_pct").asc_nulls_last(), "ticker_usd")
    )
