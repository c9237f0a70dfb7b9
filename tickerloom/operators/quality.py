"""Data-quality marks on prices and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.functions.expr import AsOf, as_of_date
from tickerloom.functions.series import daily_return, known_at_latest

MAX_DAYS_WITHOUT_VOLUME = 5
MAX_DAYS_BEHIND = 7
INCOHERENT_MARGIN_GAP = 10
MAX_EV_TIMES_CAP = 10
LOW_INSTITUTIONAL_PCT = 5
ERROR, WARNING = "error", "advertencia"
CURRENCY_EXEMPT_SECTOR = "Financial Services"


def data_quality(
    prices: DataFrame,
    metrics: DataFrame,
    dim: DataFrame,
    as_of: AsOf = None,
    max_days_without_volume: int = MAX_DAYS_WITHOUT_VOLUME,
    max_days_behind: int = MAX_DAYS_BEHIND,
) -> DataFrame:
    """One row per (ticker, violated rule): ticker_usd, regla, severidad, detalle, valor, referencia, fecha_evaluacion.

    ``valor`` and ``referencia`` carry the numbers (dates as days since 1970) behind the text of ``detalle``.
    """
    today = as_of_date(as_of, prices, "fecha")
    d = dim.select("ticker_usd", "mercado", F.coalesce("sector_corregido", "sector").alias("sector"))

    bad = (F.col("adj_close") <= 0) | (F.col("close") <= 0) | (F.col("high") < F.col("low"))
    per_ticker = prices.groupBy("ticker_usd").agg(
        F.min("fecha").alias("primera"),
        F.max("fecha").alias("ultima"),
        F.count_if((F.col("fecha") >= F.date_sub(today, 30)) & (F.coalesce("volume", F.lit(0)) == 0)).alias("sin_volumen"),
        F.count_if((F.col("fecha") >= F.date_sub(today, 365)) & bad).alias("invalidas"),
    ).join(d, "ticker_usd")
    markets = per_ticker.groupBy("mercado").agg(F.max("ultima").alias("ultima_mercado"))
    newest_metrics = metrics.agg(F.max("fecha").alias("f")).scalar()

    jump = (
        prices.filter(F.col("adj_close") > 0)
        .withColumn("ret", daily_return("adj_close"))
        .filter((F.col("fecha") >= F.date_sub(today, 90)) & ((F.col("ret") >= 1.0) | (F.col("ret") <= -0.5)))
        .groupBy("ticker_usd")
        .agg(F.max_by(F.struct("ret", "fecha"), F.struct(F.abs("ret"), "fecha")).alias("s"))
    )
    m = known_at_latest(
        metrics,
        ["margen_neto_pct", "margen_operativo_pct", "enterprise_value", "market_cap", "institutional_holding_pct"],
    )
    m_dim = m.join(d, "ticker_usd")

    def mark(df, cond, rule, severity, detail, value, reference):
        return df.filter(cond).select(
            "ticker_usd",
            F.lit(rule).alias("regla"),
            F.lit(severity).alias("severidad"),
            detail.alias("detalle"),
            value.cast("double").alias("valor"),
            reference.cast("double").alias("referencia"),
        )

    def text(*parts):
        return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])

    days = F.unix_date
    price_rules = per_ticker.join(markets, "mercado", "left")
    # The rules on one input share one pass: every row offers its marks as an array and explodes the ones that hold.
    offered = F.array(
        *[
            F.when(
                cond,
                F.struct(
                    F.lit(rule).alias("regla"), F.lit(ERROR).alias("severidad"), detail.alias("detalle"),
                    value.cast("double").alias("valor"), ref.cast("double").alias("referencia"),
                ),
            )
            for cond, rule, detail, value, ref in [
                (
                    (F.col("sin_volumen") > max_days_without_volume) & (F.col("mercado") != "cripto"),
                    "cotizacion_sin_movimiento",
                    text(F.col("sin_volumen"), " ruedas con volumen 0 en los ultimos 30 dias"),
                    F.col("sin_volumen"),
                    F.lit(None),
                ),
                (
                    F.datediff("ultima_mercado", "ultima") > max_days_behind,
                    "precio_desactualizado",
                    text("ultima cotizacion ", F.col("ultima"), " (su mercado: ", F.col("ultima_mercado"), ")"),
                    days("ultima"),
                    days("ultima_mercado"),
                ),
                (
                    F.col("invalidas") > 0,
                    "precio_invalido",
                    text(F.col("invalidas"), " filas con precio <= 0 o maximo < minimo"),
                    F.col("invalidas"),
                    F.lit(None),
                ),
            ]
        ]
    )
    marks = [
        price_rules.select("ticker_usd", F.explode(F.array_compact(offered)).alias("r")).select("ticker_usd", "r.*"),
        mark(
            m,
            F.datediff(newest_metrics, F.col("fecha")) > max_days_behind,
            "metricas_desactualizadas",
            ERROR,
            text("ultimas metricas del ", F.col("fecha")),
            days("fecha"),
            F.lit(None),
        ),
        mark(
            jump,
            F.lit(True),
            "salto_de_precio",
            WARNING,
            text(F.round(F.col("s.ret") * 100, 1), "% el ", F.col("s.fecha")),
            F.col("s.ret"),
            days("s.fecha"),
        ),
        mark(
            m,
            (F.col("margen_neto_pct") > 0) & (F.col("margen_neto_pct") >= F.col("margen_operativo_pct") + INCOHERENT_MARGIN_GAP),
            "margen_incoherente",
            WARNING,
            text("margen neto ", F.col("margen_neto_pct"), "% vs operativo ", F.col("margen_operativo_pct"), "%"),
            F.col("margen_neto_pct"),
            F.col("margen_operativo_pct"),
        ),
        mark(
            m_dim,
            (F.col("market_cap") > 0)
            & (F.col("sector") != CURRENCY_EXEMPT_SECTOR)
            & ((F.col("enterprise_value") < 0) | (F.abs("enterprise_value") > MAX_EV_TIMES_CAP * F.col("market_cap"))),
            "moneda_inconsistente",
            WARNING,
            text(
                "valor de empresa ", F.round(F.col("enterprise_value") / 1e9, 1), " mil M vs capitalizacion ",
                F.round(F.col("market_cap") / 1e9, 1), " mil M",
            ),
            F.col("enterprise_value"),
            F.col("market_cap"),
        ),
        mark(
            m.join(per_ticker.select("ticker_usd", "primera"), "ticker_usd"),
            (F.col("institutional_holding_pct") < LOW_INSTITUTIONAL_PCT) & (F.col("primera") > F.date_sub(today, 365)),
            "tenencia_institucional_no_confiable",
            WARNING,
            text("tenencia ", F.col("institutional_holding_pct"), "% y cotiza desde ", F.col("primera")),
            F.col("institutional_holding_pct"),
            days("primera"),
        ),
    ]
    out = marks[0]
    for other in marks[1:]:
        out = out.unionByName(other)
    return out.withColumn("fecha_evaluacion", today)
