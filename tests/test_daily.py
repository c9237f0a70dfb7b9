import datetime as dt

import pytest
from pyspark.sql import functions as F

from tickerloom.plans import daily
from tickerloom.sources import adapters as A
from tickerloom.sources.warehouse import Warehouse

SF = "/root/testdata/sf0.001"
LAST = dt.date(2001, 11, 1)


def test_a_day_over_the_warehouse(spark, tmp_path):
    wh = Warehouse(spark, str(tmp_path))
    wh.rewrite("fact_precios_daily", A.bars(spark, SF))
    wh.rewrite("fact_metrics_daily", A.metrics(spark, SF))
    wh.rewrite("dim_empresa", A.dim(spark, SF))
    wh.rewrite("fact_macro_daily", A.macro(spark, SF))
    wh.rewrite("fact_income_statement_annual", A.income(spark, SF))
    wh.rewrite("fact_balance_cashflow_annual", A.balances(spark, SF))
    wh.rewrite("fact_eps_trimestral", A.eps_reports(spark, SF))
    wh.rewrite("fact_consenso_analistas", A.consensus(spark, SF))
    wh.rewrite("fact_noticias", A.news(spark, SF))
    wh.rewrite("fact_insider_transacciones", A.insiders(spark, SF))
    wh.rewrite("seguimiento", A.watchlist(spark, SF))

    marks = daily.refresh_quality(wh, LAST)
    assert marks.count() > 0
    daily.refresh_gold(wh, LAST)
    assert wh.published("gold_technical").count() == wh.read("fact_precios_daily").select("ticker_usd").distinct().count()
    assert wh.published("gold_pivots").count() > 0

    with pytest.raises(daily.EmptySelection):
        daily.select_portfolio(wh, LAST)
    # the small set trails its markets: without the error marks somebody passes
    wh.publish("silver_calidad_datos", marks.filter(F.col("severidad") != "error"))
    for _ in range(2):
        chosen = daily.select_portfolio(wh, LAST, "semanal", min_volume=1, min_history=100)
    saved = wh.read("fact_cartera_seleccionada")
    assert saved.count() == chosen.count() > 0
    assert daily.follow_up(wh, LAST).select("origen").distinct().count() >= 1
    ticker = saved.first().ticker_usd
    assert daily.evaluate(wh, calendar_ticker=ticker).count() <= 1
    log = {(r.script, r.estado) for r in wh.read("log_ejecuciones").collect()}
    assert ("gold_ondas", "ok") in log and ("follow_up", "ok") in log
