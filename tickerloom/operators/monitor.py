"""Follow-up of the saved portfolio and of the watchlist."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerloom.functions.expr import AsOf, as_of_date, change_pct, joined, rounded
from tickerloom.functions.series import asof_backward, by_date, newest_first
from tickerloom.operators.signals import MIN_ACTIVE, count_active, evaluate_signals

WEEK_FALL_PCT, SINCE_SELECTION_FALL_PCT = -10, -15
LOW_RSI, HIGH_RSI = 25, 80
REPORT_DAYS, AFTER_REPORT_DAYS = 7, 7
REPORT_CLUSTER_DAYS = 5


def recent_prices(prices: DataFrame, tickers: DataFrame) -> DataFrame:
    """Last known price of each ticker with the ones 1 and 5 rows before."""
    wanted = prices.filter(F.col("adj_close").isNotNull()).join(tickers.select("ticker_usd").distinct(), "ticker_usd", "left_semi")
    rows = newest_first(wanted.select("ticker_usd", "fecha", "adj_close"), 6)

    def at(n: int, c: str) -> Column:
        return F.max(F.when(F.col("rn") == n, F.col(c)))

    return rows.groupBy("ticker_usd").agg(
        at(1, "fecha").alias("fecha_precio"), at(1, "adj_close").alias("precio"),
        at(2, "adj_close").alias("precio_ayer"), at(6, "adj_close").alias("precio_hace_5"),
    )


def report_dates(eps: DataFrame, within: int = REPORT_CLUSTER_DAYS) -> DataFrame:
    """Report dates, dropping one that another date follows within a few days (the same report listed twice)."""
    distinct = eps.filter(F.col("fecha_reporte").isNotNull()).select("ticker_usd", "fecha_reporte").distinct()
    nxt = F.lead("fecha_reporte").over(by_date(date="fecha_reporte"))
    return (
        distinct.withColumn("_sig", nxt)
        .filter(F.col("_sig").isNull() | (F.datediff("_sig", "fecha_reporte") > within))
        .drop("_sig")
    )


def report_reaction(reports: DataFrame, prices: DataFrame) -> DataFrame:
    """Closes around each report: the last before it and the first on or after it. ``reports``: ticker_usd, ultimo_reporte."""
    around = prices.join(reports.select("ticker_usd").distinct(), "ticker_usd", "left_semi").select("ticker_usd", "fecha", "adj_close")
    out = asof_backward(reports, around, ["ticker_usd"], "ultimo_reporte", "fecha", {"adj_close": "precio_pre_reporte"}, strict=True)
    return asof_backward(
        out, around, ["ticker_usd"], "ultimo_reporte", "fecha", {"adj_close": "precio_dia_reporte"}, forward=True
    )


def current_portfolio(saved: DataFrame) -> DataFrame:
    """The newest saved portfolio; on one date the manual one wins."""
    preferred = F.when(F.col("origen") == "manual", 1).otherwise(0)
    newest = saved.agg(
        F.max_by(F.struct("fecha_seleccion", "origen"), F.struct("fecha_seleccion", preferred.alias("p"), "origen")).alias("s")
    )
    return saved.join(F.broadcast(newest.select("s.*")), ["fecha_seleccion", "origen"], "left_semi")


def _errors(quality: DataFrame) -> DataFrame:
    return quality.filter(F.col("severidad") == "error").groupBy("ticker_usd").agg(joined(F.col("regla")).alias("errores_datos"))


def _reasons(*conditional: Column) -> Column:
    return F.array_compact(F.array(*conditional))


def _report_soon(today: Column) -> Column:
    return F.when(
        F.datediff("proximo_reporte", today) <= REPORT_DAYS,
        F.concat(F.lit("presenta resultados el "), F.col("proximo_reporte").cast("string")),
    )


def _num(c: str, fmt: str = "%.1f") -> Column:
    return F.format_string(fmt, F.col(c).cast("double"))


def monitor_portfolio(
    saved: DataFrame, prices: DataFrame, eps: DataFrame, dim: DataFrame, tech: DataFrame, sentiment: DataFrame,
    quality: DataFrame, refuge: DataFrame, as_of: AsOf = None, rounded_output: bool = True,
) -> DataFrame:
    """The current portfolio with its returns, next report, flags and alert reasons (``alertas``, ``n_alertas``)."""
    r = rounded_output
    today = as_of_date(as_of, prices, "fecha")
    own = current_portfolio(saved).select("fecha_seleccion", "origen", "puesto", "ticker_usd", "precio_seleccion")
    upcoming = (
        eps.filter(F.col("eps_reportado").isNull() & (F.col("fecha_reporte") >= today))
        .groupBy("ticker_usd")
        .agg(F.min("fecha_reporte").alias("proximo_reporte"))
    )
    view = (
        own.join(dim.select("ticker_usd", "nombre_empresa"), "ticker_usd")
        .join(recent_prices(prices, own), "ticker_usd", "left")
        .join(tech.select("ticker_usd", "tech_rsi14", "tech_dist_max_52s_pct"), "ticker_usd", "left")
        .join(upcoming, "ticker_usd", "left")
        .join(sentiment.select("ticker_usd", "sent_clasificacion"), "ticker_usd", "left")
        .join(_errors(quality), "ticker_usd", "left")
        .join(refuge.select("ticker_usd", "refugio_segmento"), "ticker_usd", "left")
        .select(
            "fecha_seleccion", "origen", "puesto", "ticker_usd", "nombre_empresa", "precio_seleccion", "fecha_precio",
            F.col("precio").alias("precio_actual"),
            rounded(change_pct("precio", "precio_seleccion"), 1, r).alias("desde_seleccion_pct"),
            rounded(change_pct("precio", "precio_hace_5"), 1, r).alias("ultimas_5_ruedas_pct"),
            "tech_rsi14", "tech_dist_max_52s_pct", "proximo_reporte", "sent_clasificacion", "errores_datos", "refugio_segmento",
        )
    )
    week, since, rsi = F.col("ultimas_5_ruedas_pct"), F.col("desde_seleccion_pct"), F.col("tech_rsi14")
    reasons = _reasons(
        F.when(week <= WEEK_FALL_PCT, F.concat(F.lit("cayó "), _num("ultimas_5_ruedas_pct"), F.lit("% en 5 ruedas"))),
        F.when(since <= SINCE_SELECTION_FALL_PCT, F.concat(_num("desde_seleccion_pct"), F.lit("% desde la selección"))),
        F.when(rsi <= LOW_RSI, F.concat(F.lit("RSI "), _num("tech_rsi14"), F.lit(" (sobreventa fuerte)"))),
        F.when(rsi >= HIGH_RSI, F.concat(F.lit("RSI "), _num("tech_rsi14"), F.lit(" (sobrecompra fuerte)"))),
        _report_soon(today),
        F.when(F.col("sent_clasificacion") == "Negativo", "noticias negativas"),
        F.when(F.col("errores_datos").isNotNull(), F.concat(F.lit("error de datos: "), "errores_datos")),
    )
    return view.withColumn("alertas", reasons).withColumn("n_alertas", F.size("alertas"))


def portfolio_mean(monitored: DataFrame) -> DataFrame:
    """Equal-weight return since selection."""
    return monitored.agg(F.avg("desde_seleccion_pct").alias("promedio_pct"), F.count_if(F.col("n_alertas") > 0).alias("con_alerta"))


def monitor_watchlist(
    watch: DataFrame, prices: DataFrame, macro: DataFrame, eps: DataFrame, dim: DataFrame, tech: DataFrame,
    sentiment: DataFrame, quality: DataFrame, as_of: AsOf = None, rounded_output: bool = True,
) -> DataFrame:
    """The active watchlist with returns, reports, price levels, entry signals and alert reasons."""
    r = rounded_output
    today = as_of_date(as_of, prices, "fecha")
    active = watch.filter(F.col("activo")).select(
        "ticker_usd", "desde", "motivo", "nivel_soporte", "nivel_resistencia", "nivel_salida", "moneda"
    )
    dates = report_dates(eps.join(active.select("ticker_usd"), "ticker_usd", "left_semi"))
    upcoming = dates.filter(F.col("fecha_reporte") > today).groupBy("ticker_usd").agg(F.min("fecha_reporte").alias("proximo_reporte"))
    recent = (
        dates.filter(F.col("fecha_reporte").between(F.date_sub(today, AFTER_REPORT_DAYS), today))
        .groupBy("ticker_usd")
        .agg(F.max("fecha_reporte").alias("ultimo_reporte"))
    )
    signals = count_active(evaluate_signals(active, prices, macro, eps, today))
    view = (
        active.join(dim.select("ticker_usd", "nombre_empresa"), "ticker_usd")
        .join(recent_prices(prices, active), "ticker_usd", "left")
        .join(tech.select("ticker_usd", "tech_rsi14", "tech_dist_max_52s_pct"), "ticker_usd", "left")
        .join(upcoming, "ticker_usd", "left")
        .join(report_reaction(recent, prices), "ticker_usd", "left")
        .join(sentiment.select("ticker_usd", "sent_clasificacion"), "ticker_usd", "left")
        .join(_errors(quality), "ticker_usd", "left")
        .join(signals, "ticker_usd", "left")
        .select(
            "ticker_usd", "nombre_empresa", "desde", "motivo", "nivel_soporte", "nivel_resistencia", "nivel_salida", "moneda",
            "fecha_precio",
            rounded(F.col("precio"), 2, r).alias("precio"),
            rounded(change_pct("precio", "precio_ayer"), 1, r).alias("dia_pct"),
            rounded(change_pct("precio", "precio_hace_5"), 1, r).alias("ultimas_5_ruedas_pct"),
            "tech_rsi14", "tech_dist_max_52s_pct", "proximo_reporte", "ultimo_reporte",
            rounded(change_pct("precio_dia_reporte", "precio_pre_reporte"), 1, r).alias("reaccion_dia_reporte_pct"),
            rounded(change_pct("precio", "precio_pre_reporte"), 1, r).alias("desde_pre_reporte_pct"),
            "sent_clasificacion", "errores_datos",
            F.coalesce("senales", F.lit(0)).alias("senales"), F.coalesce("activas", F.lit(0)).alias("activas"), "nombres",
        )
    )
    price, rsi = F.col("precio"), F.col("tech_rsi14")
    g = lambda c: F.col(c).cast("string")
    reasons = _reasons(
        F.when(
            price <= F.col("nivel_salida"),
            F.concat(F.lit("cerró en "), g("precio"), F.lit(", debajo del nivel de salida "), g("nivel_salida"), F.lit(": la tesis se rompió")),
        ).when(
            price <= F.col("nivel_soporte"),
            F.concat(F.lit("cerró en "), g("precio"), F.lit(", en o debajo del soporte "), g("nivel_soporte")),
        ),
        F.when(
            price >= F.col("nivel_resistencia"),
            F.concat(F.lit("cerró en "), g("precio"), F.lit(", en o arriba de la resistencia "), g("nivel_resistencia")),
        ),
        _report_soon(today),
        F.when(
            F.col("ultimo_reporte").isNotNull(),
            F.concat(
                F.lit("reportó el "), g("ultimo_reporte"), F.lit(": el día del reporte "),
                F.coalesce(_num("reaccion_dia_reporte_pct", "%+.1f"), F.lit("?")), F.lit("%, desde el cierre previo "),
                F.coalesce(_num("desde_pre_reporte_pct", "%+.1f"), F.lit("?")), F.lit("%"),
            ),
        ),
        F.when(F.col("ultimas_5_ruedas_pct") <= WEEK_FALL_PCT, F.concat(F.lit("cayó "), _num("ultimas_5_ruedas_pct"), F.lit("% en 5 ruedas"))),
        F.when((rsi <= LOW_RSI) | (rsi >= HIGH_RSI), F.concat(F.lit("RSI "), _num("tech_rsi14"))),
        F.when(F.col("errores_datos").isNotNull(), F.concat(F.lit("error de datos: "), "errores_datos")),
        F.when(
            F.col("activas") >= MIN_ACTIVE,
            F.concat(
                F.lit("posible punto de entrada: "), g("activas"), F.lit(" de "), g("senales"), F.lit(" señales ("), "nombres", F.lit(")")
            ),
        ),
    )
    return view.withColumn("alertas", reasons).withColumn("n_alertas", F.size("alertas"))
