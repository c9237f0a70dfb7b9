"""Valuation of each company against its own history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.functions.expr import ladder, ratio, rounded
from tickerloom.functions.series import asof_backward, month_end_closes
from tickerloom.operators.macro import filled_series

PUBLICATION_LAG_DAYS = 75
MIN_MONTHS = 12
CHEAP_PERCENTILE, DEAR_PERCENTILE = 20, 80
PRICE_CURRENCY_WITH_FX = "USD"
EXCLUDED_MARKETS = ("cripto", "etf")


def valuation_index(
    monthly: DataFrame, income: DataFrame, fx: DataFrame | None = None, currencies: DataFrame | None = None,
    lag_days: int = PUBLICATION_LAG_DAYS,
) -> DataFrame:
    """Month-end price over the last *published* net income: (ticker_usd, fin_mes, val); NULL where not positive.

    ``fx``: (serie, fecha, valor), ``currencies``: (ticker_usd, fx_serie) with a NULL series where the
    statement is in the currency of the price.
    """
    published = income.filter(F.col("fecha_balance").isNotNull() & F.col("ganancia_neta").isNotNull()).select(
        "ticker_usd", "ganancia_neta", F.date_add("fecha_balance", lag_days).alias("publicada")
    )
    known = asof_backward(monthly, published, ["ticker_usd"], "fin_mes", "publicada", {"ganancia_neta": "ganancia"})
    earned = F.col("ganancia")
    if fx is not None and currencies is not None:
        rates = fx.select(F.col("serie").alias("fx_serie"), F.col("fecha").alias("fin_mes"), F.col("valor").alias("cambio"))
        known = known.join(currencies, "ticker_usd", "left").join(rates, ["fx_serie", "fin_mes"], "left")
        earned = F.when(F.col("fx_serie").isNull(), earned).otherwise(ratio(earned, "cambio"))
    return known.withColumn("g", earned).select(
        "ticker_usd", "fin_mes", F.when(F.col("g") > 0, ratio("close", "g")).alias("val")
    )


def with_today(index: DataFrame) -> DataFrame:
    """The known months of an index, each with its company's newest value as ``hoy``."""
    history = Window.partitionBy("ticker_usd").orderBy("fin_mes").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return index.filter(F.col("val").isNotNull()).withColumn("hoy", F.last("val").over(history))


def valuation_reading(index: DataFrame, pe_today: DataFrame, min_months: int = MIN_MONTHS, rounded_output: bool = True) -> DataFrame:
    """Where today's valuation lies in the company's own history, scaled to today's P/E.

    ``pe_today``: (ticker_usd, pe_trailing). Tickers whose index has no month at all are absent.
    """
    r = rounded_output
    last = with_today(index).groupBy("ticker_usd").agg(
        F.count("*").alias("val_meses"),
        F.max("hoy").alias("hoy"),
        F.median("val").alias("mediana"),
        F.min("val").alias("minimo"),
        F.max("val").alias("maximo"),
        (F.avg(F.when(F.col("val") <= F.col("hoy"), 1.0).otherwise(0.0)) * 100).alias("percentil"),
    )
    pe = F.col("pe_trailing")
    scale = F.when(pe > 0, ratio(pe, "hoy"))
    enough = F.col("val_meses") >= min_months
    p = F.col("percentil")

    def when_enough(c: Column) -> Column:
        return F.when(enough, c)

    return (
        last.join(pe_today.select("ticker_usd", "pe_trailing"), "ticker_usd", "left")
        .select(
            "ticker_usd", "val_meses",
            when_enough(rounded(p, 1, r)).alias("val_percentil_hoy"),
            when_enough(pe).alias("val_pe_hoy"),
            when_enough(rounded(F.col("mediana") * scale, 2, r)).alias("val_pe_mediana_hist"),
            when_enough(rounded(F.col("minimo") * scale, 2, r)).alias("val_pe_min_hist"),
            when_enough(rounded(F.col("maximo") * scale, 2, r)).alias("val_pe_max_hist"),
            ladder(
                [
                    (~enough, "Sin historia suficiente"),
                    (p <= CHEAP_PERCENTILE, "Barata vs su historia"),
                    (p >= DEAR_PERCENTILE, "Cara vs su historia"),
                ],
                "En su rango normal",
            ).alias("val_lectura"),
        )
    )


def _plan(dim: DataFrame, prices: DataFrame, macro: DataFrame) -> DataFrame:
    """Per company: the fx series to use, or the reason why no valuation can be computed."""
    quoted = prices.filter(F.col("close") > 0).select("ticker_usd").distinct().withColumn("con_precio", F.lit(True))
    available = macro.filter(F.col("serie").startswith("USD")).select(F.col("serie").alias("fx_serie")).distinct()
    balance, quote = F.col("moneda_balance"), F.col("moneda_cotizacion")
    return (
        dim.filter(~F.col("mercado").isin(*EXCLUDED_MARKETS))
        .select("ticker_usd", "moneda_balance", "moneda_cotizacion")
        .join(quoted, "ticker_usd", "left")
        .withColumn(
            "fx_serie", F.when((balance != quote) & (quote == PRICE_CURRENCY_WITH_FX), F.concat(F.lit("USD"), balance))
        )
        .join(available.withColumn("con_fx", F.lit(True)), "fx_serie", "left")
        .withColumn(
            "motivo",
            F.when(F.col("con_precio").isNull(), "Sin precios")
            .when(balance.isNull() | quote.isNull(), "Sin moneda")
            .when(
                (balance != quote) & (quote != PRICE_CURRENCY_WITH_FX),
                F.concat(F.lit("No calculable: precio en "), quote, F.lit(" y balance en "), balance, F.lit(": sin conversion")),
            )
            .when(F.col("fx_serie").isNotNull() & F.col("con_fx").isNull(), F.concat(F.lit("No calculable: sin serie "), "fx_serie")),
        )
        .select("ticker_usd", "fx_serie", "motivo")
    )


def historical_valuation(
    dim: DataFrame, prices: DataFrame, income: DataFrame, macro: DataFrame, pe_today: DataFrame,
    fx_series: list[str], rounded_output: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """(history, reading): monthly approximate P/E per company, and one row per company of the universe.

    ``fx_series`` lists the currency series that may be needed (``USD`` plus the statement currency).
    """
    plan = _plan(dim, prices, macro)
    usable = plan.filter(F.col("motivo").isNull()).select("ticker_usd", "fx_serie")
    monthly = month_end_closes(prices).join(usable.select("ticker_usd"), "ticker_usd", "left_semi")
    months = monthly.select(F.col("fin_mes").alias("fecha")).distinct()
    fx = filled_series(macro, months, fx_series)
    index = valuation_index(monthly, income, fx, usable)
    reading = valuation_reading(index, pe_today, rounded_output=rounded_output)
    out = plan.join(reading, "ticker_usd", "left").select(
        "ticker_usd",
        F.when(F.col("motivo").isNull(), F.coalesce("val_meses", F.lit(0))).alias("val_meses"),
        "val_percentil_hoy", "val_pe_hoy", "val_pe_mediana_hist", "val_pe_min_hist", "val_pe_max_hist",
        F.coalesce("motivo", "val_lectura", F.lit("Sin historia suficiente")).alias("val_lectura"),
    )
    history = (
        with_today(index)
        .join(pe_today.select("ticker_usd", "pe_trailing"), "ticker_usd")
        .filter(F.col("pe_trailing").isNotNull() & (F.col("pe_trailing") != 0))
        .select(
            "ticker_usd", F.col("fin_mes").alias("fecha"),
            rounded(F.col("val") * ratio("pe_trailing", "hoy"), 2, rounded_output).alias("val_pe_aprox"),
        )
    )
    return history, out
