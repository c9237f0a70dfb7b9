"""Sensitivity of returns to macro series, currency-clean returns and the state of the market."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.functions.expr import AsOf, as_of_date, change_pct, ladder, pearson, ratio, rounded
from tickerloom.functions.series import broadcast_per_date, by_date, daily_return, earlier, one_key, series_by_date

MIN_SAMPLE_DAYS = 200


def returns(prices: DataFrame) -> DataFrame:
    """Close-to-close returns between consecutive known rows: (ticker_usd, fecha, retorno)."""
    known = prices.filter(F.col("adj_close").isNotNull()).select("ticker_usd", "fecha", "adj_close")
    return known.withColumn("retorno", daily_return("adj_close")).filter(F.col("retorno").isNotNull()).drop("adj_close")


def _moves(macro: DataFrame, series: dict[str, str], relative: bool) -> DataFrame:
    wide = series_by_date(macro, series)
    w = one_key(wide)

    def move(name: str) -> Column:
        prev = F.lag(name).over(w)
        return ratio(name, prev) - 1 if relative else F.col(name) - prev

    return wide.select("fecha", *[move(n).alias(f"m_{n}") for n in series.values()])


def factor_exposure(
    prices: DataFrame, macro: DataFrame, series: dict[str, str], relative: bool = True, required: list[str] | None = None
) -> DataFrame:
    """Correlation of each ticker's daily return with the daily moves of several series.

    ``series`` maps a series code to its output name; ``relative`` compares returns, otherwise level
    differences. Days where a ``required`` series (default: all) has no move are left out.
    The moves hold one row per date and ride along to the returns.
    """
    names = list(series.values())
    required = names if required is None else required
    moves = broadcast_per_date(_moves(macro, series, relative).dropna(subset=[f"m_{n}" for n in required]))
    return (
        returns(prices)
        .join(moves, "fecha")
        .groupBy("ticker_usd")
        .agg(
            F.count("*").alias("dias_muestra"),
            *[pearson("retorno", f"m_{n}").alias(f"corr_vs_{n}") for n in names],
        )
    )


def rate_sensitivity(
    prices: DataFrame,
    macro: DataFrame,
    short_rate: str = "UST10Y",
    long_rate: str = "UST30Y",
    min_days: int = MIN_SAMPLE_DAYS,
    rounded_output: bool = True,
) -> DataFrame:
    """Correlation of returns with daily rate changes, and its reading. A flat price has no reading."""
    corr = factor_exposure(
        prices, macro, {short_rate: "corta", long_rate: "larga"}, relative=False, required=["corta"]
    ).filter(F.col("dias_muestra") >= min_days)
    c = F.col("corr_vs_corta")
    return corr.select(
        "ticker_usd",
        F.col("dias_muestra").alias("macro_dias_muestra"),
        rounded(c, 3, rounded_output).alias("macro_corr_ret_vs_ust10y"),
        rounded(F.col("corr_vs_larga"), 3, rounded_output).alias("macro_corr_ret_vs_ust30y"),
        ladder(
            [
                (c.isNull(), "Sin dato"),
                (c <= -0.15, "Muy sensible (cae con suba de tasa)"),
                (c <= -0.05, "Sensible (cae con suba de tasa)"),
                (c < 0.05, "Neutral"),
                (c < 0.15, "Se beneficia levemente"),
            ],
            "Se beneficia con suba de tasa",
        ).alias("macro_sensibilidad_tasa"),
    )


def group_mean(values: DataFrame, groups: DataFrame, value: str, group: str) -> DataFrame:
    """Mean of a per-ticker value by a per-ticker label."""
    return values.join(groups.select("ticker_usd", group), "ticker_usd").groupBy(group).agg(
        F.avg(value).alias("promedio"), F.count("*").alias("empresas")
    )


def fx_clean_returns(prices: DataFrame, macro: DataFrame, fx_series: str, tickers: DataFrame) -> DataFrame:
    """Return in the quote currency, of the currency, and net of it, over the window all of them share.

    The window runs from the later of the two first dates to the earlier of the two last ones, taken over
    all ``tickers`` together.
    """
    px = prices.filter(F.col("adj_close").isNotNull()).select("ticker_usd", "fecha", "adj_close")
    px = px.join(tickers.select("ticker_usd").distinct(), "ticker_usd", "left_semi")
    fx = macro.filter(F.col("serie") == fx_series).select("fecha", "valor")
    start = F.greatest(px.agg(F.min("fecha")).scalar(), fx.agg(F.min("fecha")).scalar())
    end = F.least(px.agg(F.max("fecha")).scalar(), fx.agg(F.max("fecha")).scalar())
    inside = F.col("fecha").between(start, end)
    local = px.filter(inside).groupBy("ticker_usd").agg(
        ratio(F.max_by("adj_close", "fecha"), F.min_by("adj_close", "fecha")).alias("g_local")
    )
    g_fx = fx.filter(inside).agg(ratio(F.max_by("valor", "fecha"), F.min_by("valor", "fecha"))).scalar()
    return local.select(
        "ticker_usd",
        ((F.col("g_local") - 1) * 100).alias("retorno_local_pct"),
        ((g_fx - 1) * 100).alias("retorno_fx_pct"),
        ((ratio(F.col("g_local"), g_fx) - 1) * 100).alias("retorno_limpio_pct"),
    )


def implied_fx_gap(local_prices: DataFrame, adr_prices: DataFrame, macro: DataFrame, fx_series: str) -> DataFrame:
    """Currency move implied by a local share and its ADR against the official one, per pair on its own shared window."""
    local = local_prices.filter(F.col("adj_close").isNotNull()).select("ticker_usd", "fecha", F.col("adj_close").alias("p"))
    adr = adr_prices.filter(F.col("close").isNotNull()).select("ticker_usd", "fecha", F.col("close").alias("p"))
    fx = macro.filter(F.col("serie") == fx_series).select("fecha", "valor")
    span = lambda df, tag: df.groupBy("ticker_usd").agg(F.min("fecha").alias(f"{tag}0"), F.max("fecha").alias(f"{tag}1"))
    fx0, fx1 = fx.agg(F.min("fecha")).scalar(), fx.agg(F.max("fecha")).scalar()
    window = span(local, "l").join(span(adr, "a"), "ticker_usd").select(
        "ticker_usd", F.greatest("l0", "a0", fx0).alias("inicio"), F.least("l1", "a1", fx1).alias("fin")
    )

    def growth(df: DataFrame, name: str) -> DataFrame:
        inside = df.join(window, "ticker_usd").filter(F.col("fecha").between(F.col("inicio"), F.col("fin")))
        return inside.groupBy("ticker_usd").agg(ratio(F.max_by("p", "fecha"), F.min_by("p", "fecha")).alias(name))

    # first fx value on or after the start, last one on or before the end: read from the date-filled series
    days = fx.select("fecha", "valor")
    from tickerloom.functions.series import asof_backward

    one = days.withColumn("k", F.lit(0))
    ends = window.withColumn("k", F.lit(0))
    ends = asof_backward(ends, one, ["k"], "fin", "fecha", {"valor": "fx_fin"})
    ends = asof_backward(ends, one, ["k"], "inicio", "fecha", {"valor": "fx_inicio"}, forward=True)
    g_local, g_adr = F.col("g_local"), F.col("g_adr")
    implied = ratio(g_local, g_adr)
    return (
        growth(local, "g_local")
        .join(growth(adr, "g_adr"), "ticker_usd")
        .join(ends.filter(F.col("inicio") <= F.col("fin")).select("ticker_usd", ratio("fx_fin", "fx_inicio").alias("g_fx")), "ticker_usd")
        .select(
            "ticker_usd",
            ((g_local - 1) * 100).alias("retorno_local_pct"),
            ((g_adr - 1) * 100).alias("retorno_adr_pct"),
            ((implied - 1) * 100).alias("ccl_implicito_pct"),
            ((F.col("g_fx") - 1) * 100).alias("oficial_pct"),
            ((ratio(implied, F.col("g_fx")) - 1) * 100).alias("brecha_pct"),
        )
    )


def filled_series(macro: DataFrame, dates: DataFrame, series: list[str]) -> DataFrame:
    """Value of each series at each date of ``dates``, carried forward: (serie, fecha, valor).

    Both sides are date-sized, so the fill stays small whatever the number of tickers.
    """
    wanted = dates.select("fecha").distinct()
    names = macro.filter(F.col("serie").isin(series)).select("serie", "fecha", "valor")
    # every wanted date once per series, without a join
    grid = wanted.select(F.explode(F.array(*[F.lit(s) for s in series])).alias("serie"), "fecha")
    w = by_date("serie").rowsBetween(Window.unboundedPreceding, 0)
    marked = names.withColumn("quiere", F.lit(False)).unionByName(
        grid.withColumn("valor", F.lit(None).cast("double")).withColumn("quiere", F.lit(True))
    ).groupBy("serie", "fecha").agg(F.max("valor").alias("valor"), F.bool_or("quiere").alias("quiere"))
    return (
        marked.withColumn("valor", F.last("valor", ignorenulls=True).over(w))
        .filter(F.col("quiere"))
        .select("serie", "fecha", "valor")
    )


def equal_weight_basket(prices_usd: DataFrame, tickers: DataFrame | None = None) -> DataFrame:
    """Daily rebalanced equal-weight index, starting at 1: (fecha, retorno, log_indice, indice).

    Every ticker is carried forward over dates where others traded, so a missing day counts as a zero return
    after its first price, as in a forward-filled matrix. The mean needs only sums by date: a carried day adds
    nothing to the numerator and one to the denominator.
    """
    px = prices_usd.filter(F.col("adj_close").isNotNull()).select("ticker_usd", "fecha", "adj_close")
    if tickers is not None:
        px = px.join(tickers.select("ticker_usd").distinct(), "ticker_usd", "left_semi")
    moved = px.withColumn("r", daily_return("adj_close"))
    per_day = moved.groupBy("fecha").agg(F.sum("r").alias("suma"), F.count_if(F.col("r").isNull()).alias("debutan"))
    w = one_key(per_day)
    # tickers that already had a price before this date
    active = F.coalesce(F.sum("debutan").over(earlier(w)), F.lit(0))
    mean = F.coalesce(ratio("suma", active), F.lit(0.0))
    return (
        per_day.withColumn("retorno", mean)
        .withColumn("log_indice", F.sum(F.log1p("retorno")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .select("fecha", "retorno", "log_indice", F.exp("log_indice").alias("indice"))
    )


def market_context(macro: DataFrame, series: list[str], as_of: AsOf = None, days: int = 365) -> DataFrame:
    """Last value, 12-month maximum and distance to it for a few series."""
    today = as_of_date(as_of, macro, "fecha")
    return (
        macro.filter(F.col("serie").isin(series) & (F.col("fecha") >= F.date_sub(today, days)))
        .groupBy("serie")
        .agg(F.max_by("valor", "fecha").alias("ultimo"), F.max("valor").alias("maximo"))
        .withColumn("desde_maximo_pct", change_pct("ultimo", "maximo"))
    )
