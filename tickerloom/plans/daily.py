"""The daily order of work over a warehouse: marks, gold tables, selection, follow-up.

Every step stores its result before the next one reads it, so later steps start from files any executor can
read and a failed run resumes at the step that failed.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.functions.series import known_at_latest
from tickerloom.operators import fundamentals, macro, monitor, news, portfolio, quality, refuge, swings, technical, valuation
from tickerloom.plans import merge
from tickerloom.sources.sinks import alert_rows
from tickerloom.sources.warehouse import Warehouse


class EmptySelection(Exception):
    """No company passed the quality filter."""


def refresh_quality(wh: Warehouse, as_of: dt.date) -> DataFrame:
    with wh.logged("quality_marks") as log:
        marks = quality.data_quality(wh.read("fact_precios_daily"), wh.read("fact_metrics_daily"), wh.read("dim_empresa"), as_of)
        out = wh.publish("silver_calidad_datos", marks)
        log.rows = out.count()
    return out


def refresh_gold(wh: Warehouse, as_of: dt.date, index_code: str = "SP500") -> None:
    """Recompute every gold table; marks must be fresh, the style categories read them."""
    prices, metrics, dim, series = (wh.read(t) for t in ("fact_precios_daily", "fact_metrics_daily", "dim_empresa", "fact_macro_daily"))
    marks = wh.published("silver_calidad_datos")

    def step(name: str, df: DataFrame) -> DataFrame:
        with wh.logged(name) as log:
            out = wh.publish(name, df)
            log.rows = out.count()
        return out

    step("gold_technical", technical.technical(prices))
    step("gold_lynch", fundamentals.style_categories(metrics, dim, marks))
    comps = step("gold_comparables", fundamentals.comparables(metrics, dim))
    step("gold_salud_financiera", fundamentals.financial_health(metrics, wh.read("fact_balance_cashflow_annual"), dim))
    step("gold_macro_sensitivity", macro.rate_sensitivity(prices, series))
    step("gold_sentimiento", news.news_sentiment(wh.read("fact_noticias"), as_of))
    step("gold_insiders", news.insider_signal(wh.read("fact_insider_transacciones"), as_of))
    pivots = step("gold_pivots", swings.with_elliott(swings.zigzag(prices)))
    step("gold_ondas", swings.wave_state(pivots, prices))
    step("gold_refugio_episodios", refuge.kept_episodes(prices, series, dim, index_code))
    step("gold_refugio", refuge.refuge(prices, series, dim, index_code))
    # currency series only: at most one per three-letter code
    fx = [r.serie for r in series.filter(F.col("serie").rlike("^USD[A-Z]{3}$")).select("serie").distinct().collect()]
    history, reading = valuation.historical_valuation(
        dim, prices, wh.read("fact_income_statement_annual"), series, comps.select("ticker_usd", "pe_trailing"), fx
    )
    step("gold_valuacion_historica", history)
    step("gold_valuacion", reading)


def select_portfolio(wh: Warehouse, as_of: dt.date, origin: str | None = None, size: int = portfolio.SIZE, **thresholds) -> DataFrame:
    """The diversified choice, saved under ``origin`` when one is given ('semanal' at most once per week)."""
    prices = wh.read("fact_precios_daily")
    found = portfolio.candidates(
        *(wh.published(g) for g in ("gold_lynch", "gold_comparables", "gold_salud_financiera", "gold_technical")),
        wh.read("fact_consenso_analistas"), wh.published("gold_sentimiento"), prices, wh.published("silver_calidad_datos"), as_of,
    )
    fit = wh.publish("candidatas", portfolio.quality_filter(found, **thresholds))
    chosen = wh.publish("cartera_elegida", portfolio.external_alerts(portfolio.select_diversified(portfolio.rank_candidates(fit), size)))
    if chosen.isEmpty():
        raise EmptySelection("no company passed the quality filter")
    if origin is not None:
        rows = portfolio.portfolio_rows(chosen, prices, origin)
        wh.update("fact_cartera_seleccionada", lambda saved: merge.save_portfolio(saved, rows))
    return chosen


def follow_up(wh: Warehouse, as_of: dt.date) -> DataFrame:
    """Portfolio and watchlist as of a day; returns the alert rows of both."""
    prices, eps, dim = wh.read("fact_precios_daily"), wh.read("fact_eps_trimestral"), wh.read("dim_empresa")
    tech, mood, marks = (wh.published(n) for n in ("gold_technical", "gold_sentimiento", "silver_calidad_datos"))
    with wh.logged("follow_up") as log:
        held = wh.publish(
            "portfolio_view",
            monitor.monitor_portfolio(
                wh.read("fact_cartera_seleccionada"), prices, eps, dim, tech, mood, marks, wh.published("gold_refugio"), as_of
            ),
        )
        watched = wh.publish(
            "watchlist_view",
            monitor.monitor_watchlist(wh.read("seguimiento"), prices, wh.read("fact_macro_daily"), eps, dim, tech, mood, marks, as_of),
        )
        alerts = alert_rows(held, "cartera").unionByName(alert_rows(watched, "seguimiento"))
        log.rows = alerts.select("origen", "ticker_usd").distinct().count()
    return wh.publish("alertas", alerts)


def evaluate(wh: Warehouse, calendar_ticker: str = "AAPL", index_code: str = "SP500") -> DataFrame:
    """Result of every saved portfolio so far."""
    return portfolio.evaluate_portfolios(
        wh.read("fact_cartera_seleccionada"), wh.read("fact_precios_daily"), wh.read("fact_macro_daily"), wh.read("dim_empresa"),
        calendar_ticker, index_code,
    )


def latest_pe(wh: Warehouse) -> DataFrame:
    return known_at_latest(wh.read("fact_metrics_daily"), ["pe_trailing"])
