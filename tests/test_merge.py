import datetime as dt

import pytest
from conftest import TODAY, bars

from tickerloom.plans import merge as G
from tickerloom.plans import runlog as L
from tickerloom.sources.warehouse import Warehouse

DAY = dt.timedelta(days=1)


def test_overwrite_replaces_whole_rows_and_is_idempotent(table):
    stored = table("fact_precios_daily", bars("A", [1, 2, 3]))
    inc = table("fact_precios_daily", [{**bars("A", [9])[0], "volume": None}])
    once = G.upsert_overwrite(stored, inc, ["ticker_usd", "fecha"])
    twice = G.upsert_overwrite(once, inc, ["ticker_usd", "fecha"])
    rows = sorted(map(tuple, twice.collect()), key=str)
    assert rows == sorted(map(tuple, once.collect()), key=str) and len(rows) == 3
    last, = [r for r in once.collect() if r.fecha == TODAY]
    assert last.close == 9 and last.volume is None


def test_the_last_of_equal_keys_in_a_batch_wins(spark):
    stored = spark.createDataFrame([("A", 0)], "k string, v int")
    inc = spark.createDataFrame([("A", 5, 1), ("A", 3, 2), ("B", 1, 1)], "k string, v int, n int")
    assert {r.k: r.v for r in G.upsert_overwrite(stored, inc, ["k"], order_by="n").collect()} == {"A": 3, "B": 1}


def test_two_writers_share_a_row(table):
    stored = table("fact_metrics_daily", [{"ticker_usd": "A", "fecha": TODAY, "roe_pct": 1.0, "beta": 2.0}])
    inc = table("fact_metrics_daily", [{"ticker_usd": "A", "fecha": TODAY, "beta": 3.0}, {"ticker_usd": "B", "fecha": TODAY, "beta": 4.0}])
    got = {r.ticker_usd: (r.roe_pct, r.beta) for r in G.upsert_coalesce(stored, inc, ["ticker_usd", "fecha"]).collect()}
    assert got == {"A": (1.0, 3.0), "B": (None, 4.0)}


def test_dimension_keeps_manual_and_known_values(table, spark):
    ddl = "ticker_usd string, ticker_cedear string, ticker_yahoo string, ticker_adr_usa string, mercado string, nombre_empresa string, sector string, moneda_balance string, variantes string"
    first = spark.createDataFrame([("A", "A", "A", "X", "usa_otros", "Old", "Tech", "BRL", "A")], ddl)
    one = G.upsert_dimension(table("dim_empresa", []), first)
    one = G.overlay(one, spark.createDataFrame([("A", "Financial Services")], "ticker_usd string, sector_corregido string"), "ticker_usd", "sector_corregido")
    second = spark.createDataFrame([("A", "A", "A", None, "usa_otros", "New", None, None, "A, AC")], ddl)
    row, = G.upsert_dimension(one, second).collect()
    assert (row.nombre_empresa, row.sector, row.moneda_balance, row.ticker_adr_usa, row.variantes) == ("New", "Tech", "BRL", None, "A, AC")
    assert row.sector_corregido == "Financial Services" and row.actualizado_en is not None


def world(table, n):
    dim = table("dim_empresa", [{"ticker_usd": f"T{i}"} for i in range(n)])
    prices = table("fact_precios_daily", [r for i in range(n) for r in bars(f"T{i}", [1])] + bars("ORPHAN", [1]))
    watch = table("seguimiento", [{"ticker_usd": "T0"}])
    return dim, {"fact_precios_daily": prices, "seguimiento": watch}


@pytest.mark.parametrize("keep, gone", [(20, ["ORPHAN", "T20"]), (2, [])])
def test_purge_and_its_safety_valve(table, spark, keep, gone):
    dim, facts = world(table, 21)
    uni = spark.createDataFrame([(f"T{i}",) for i in range(keep)], "ticker_usd string")
    new_dim, new_facts, removed = G.purge_universe(dim, facts, uni)
    assert sorted(r.ticker_usd for r in removed.collect()) == gone
    assert new_dim.count() == (20 if gone else 21) and new_facts["fact_precios_daily"].count() == (20 if gone else 22)
    assert new_facts["seguimiento"].count() == 1


def test_watchlist(table, spark):
    watch = table("seguimiento", [{"ticker_usd": "A", "desde": TODAY - DAY, "motivo": "x", "activo": False}])
    dim = table("dim_empresa", [{"ticker_usd": "A"}, {"ticker_usd": "B"}])
    ddl = "ticker_usd string, desde date, motivo string, moneda string"
    new = spark.createDataFrame([("a", TODAY, "y", None), ("b", TODAY, "z", "USDBRL"), ("unknown", TODAY, "", None)], ddl)
    got = {r.ticker_usd: r for r in G.watch_add(watch, new, dim).collect()}
    assert set(got) == {"A", "B"} and got["A"].desde == TODAY - DAY and got["A"].motivo == "y" and got["A"].activo and got["B"].moneda == "USDBRL"
    assert [r.ticker_usd for r in G.watch_list(G.watch_remove(G.watch_add(watch, new, dim), ["a"])).collect()] == ["B"]


def log(table, *rows):
    return table("log_ejecuciones", [{"script": s, "inicio": t, "fin": t, "estado": e} for s, t, e in rows])


def test_today_is_the_calendar_day(table):
    yesterday = dt.datetime.combine(TODAY - DAY, dt.time(23))
    runs = log(table, ("job", yesterday, "ok"), ("bad", dt.datetime.combine(TODAY, dt.time(9)), "error"), ("old", yesterday - 5 * DAY, "ok"))
    assert not L.has_run(runs, "job", TODAY) and L.has_run(runs, "job", TODAY, 1) and not L.has_run(runs, "bad", TODAY)
    assert not L.has_run(runs, "old", TODAY, 2) and L.has_run(runs, "old", TODAY, 6)
    status = {r.script: r for r in L.run_status(runs).collect()}
    assert status["bad"].ultima_corrida_ok is None and status["bad"].errores_totales == 1 and status["job"].ultima_corrida == yesterday


def test_warehouse_round_trip(spark, table, tmp_path):
    wh = Warehouse(spark, str(tmp_path))
    key = ["ticker_usd", "fecha"]
    assert wh.read("fact_precios_daily").count() == 0
    wh.upsert("fact_precios_daily", table("fact_precios_daily", bars("A", [1.0] * 300)))
    wh.upsert("fact_precios_daily", table("fact_precios_daily", bars("A", [2.0] * 3) + bars("B", [5.0])))
    got = wh.read("fact_precios_daily")
    assert got.count() == 301 and got.select(*key).distinct().count() == 301 and got.filter("close = 2").count() == 3
    wh.upsert("fact_metrics_daily", table("fact_metrics_daily", [{"ticker_usd": "A", "fecha": TODAY, "beta": 1.0}]), G.upsert_coalesce)
    wh.upsert("fact_metrics_daily", spark.createDataFrame([("A", TODAY, 7.0)], "ticker_usd string, fecha date, roe_pct double"), G.upsert_coalesce)
    assert [(r.beta, r.roe_pct) for r in wh.read("fact_metrics_daily").collect()] == [(1.0, 7.0)]
    wh.upsert_dimension(spark.createDataFrame([("A", "usa_otros")], "ticker_usd string, mercado string"))
    assert wh.purge(spark.createDataFrame([("A",)], "ticker_usd string")) == ["B"]
    assert wh.read("fact_precios_daily").count() == 300
    with pytest.raises(ZeroDivisionError), wh.logged("job"):
        1 / 0
    with wh.logged("job") as info:
        info.rows = 4
    assert sorted((r.estado, r.filas_afectadas) for r in wh.read("log_ejecuciones").collect()) == [("error", None), ("ok", 4)]
