import datetime as dt

import numpy as np
from conftest import TODAY, bars, sessions

from tickerloom.operators import monitor as MO
from tickerloom.operators import portfolio as P
from tickerloom.plans import merge

DAY = dt.timedelta(days=1)
CAND = "ticker_usd string, sector string, mercado string, pais_origen string, score_compuesto double"


def greedy(rows, size, cap_s, cap_r):
    """Row-by-row walk, as a check on the cut-down fold."""
    ns, nr, out = {}, {}, []
    for t, sector, _, place, _ in sorted(rows, key=lambda r: (-r[4], r[0])):
        if len(out) == size:
            break
        if ns.get(sector, 0) < cap_s and nr.get(place, 0) < cap_r:
            out.append(t)
            ns[sector] = ns.get(sector, 0) + 1
            nr[place] = nr.get(place, 0) + 1
    return out


def cut(rows, size, cap_s, cap_r):
    """The rows the cuts keep, in plain Python."""
    pair, per_s, per_r, overall = P.reachable_rows(size, cap_s, cap_r)
    rows = sorted(rows, key=lambda r: (-r[4], r[0]))
    for key, k in ((lambda r: (r[1], r[3]), pair), (lambda r: r[1], per_s), (lambda r: r[3], per_r)):
        seen, kept = {}, []
        for r in rows:
            seen[key(r)] = seen.get(key(r), 0) + 1
            if seen[key(r)] <= k:
                kept.append(r)
        rows = kept
    return rows[:overall]


def make(rng, n, sectors, places):
    hot = rng.random() < 0.5
    pick = lambda kind, k: f"{kind}0" if hot and rng.random() < 0.6 else f"{kind}{rng.integers(k)}"
    return [(f"T{i:04d}", pick("s", sectors), "usa_otros", pick("p", places), float(rng.integers(0, 30))) for i in range(n)]


def test_the_cuts_never_lose_a_pick():
    rng = np.random.default_rng(0)
    for _ in range(1500):
        rows = make(rng, int(rng.integers(1, 250)), int(rng.integers(1, 15)), int(rng.integers(1, 15)))
        size, cs, cr = int(rng.integers(1, 12)), int(rng.integers(1, 4)), int(rng.integers(1, 4))
        assert greedy(cut(rows, size, cs, cr), size, cs, cr) == greedy(rows, size, cs, cr)


def test_selection_matches_the_walk(spark):
    rng = np.random.default_rng(1)
    for size, cs, cr in ((9, 2, 2), (5, 1, 3)):
        rows = make(rng, 300, 6, 8)
        got = P.select_diversified(spark.createDataFrame(rows, CAND), size, cs, cr).orderBy("puesto").collect()
        assert [r.ticker_usd for r in got] == greedy(rows, size, cs, cr)
        assert [r.puesto for r in got] == list(range(1, len(got) + 1))


def test_local_panels_are_one_region_and_missing_values_one_group(spark):
    rows = [("A", "x", "brasil", "Brazil", 9.0), ("B", "y", "brasil", "Chile", 8.0), ("C", "z", "brasil", "Peru", 7.0), ("PDD", "w", "usa_otros", "Ireland", 6.0),
            ("E", None, "usa_otros", None, 5.0), ("F", None, "usa_otros", None, 4.0), ("G", None, "usa_otros", "X", 3.0)]
    got = {r.ticker_usd: r.region for r in P.select_diversified(spark.createDataFrame(rows, CAND)).collect()}
    assert got == {"A": "brasil", "B": "brasil", "PDD": "China", "E": None, "F": None}


def test_ranking_is_neutral_only_after_ranking(spark):
    ddl = ("ticker_usd string, lynch_checklist_score int, comp_pe_vs_sector_pct double, lynch_categoria_auto string, ganancia_no_recurrente boolean, "
           "salud_score int, salud_evaluables int")
    rows = [("A", 3, -50.0, "Ciclica", False, 4, 5), ("B", 1, 10.0, "Estable", False, 0, 0), ("C", 1, 90.0, "Estable", True, 5, 5), ("D", 2, None, "Estable", False, 2, 4)]
    got = {r.ticker_usd: r for r in P.rank_candidates(spark.createDataFrame(rows, ddl)).collect()}
    assert got["A"].pct_barata == 0.5 and got["C"].pct_barata == 0.5 and abs(got["B"].pct_barata - 2 / 3) < 1e-12 and got["D"].pct_barata is None
    assert got["B"].pct_checklist == 1.5 / 4 and got["B"].pct_salud is None
    assert abs(got["B"].score_compuesto - (1.5 / 4 + 2 / 3) / 2) < 1e-12


def test_quality_filter_treats_unknowns(spark):
    ddl = ("ticker_usd string, salud_clasificacion string, crecimiento_ganancia_anual_pct double, margen_neto_pct double, vol_prom_30d double, dias_precio long, errores_datos string")
    ok = ("Sólida", 1.0, 5.0, 60_000.0, 300, None)
    rows = [("OK", *ok), ("NOCLASS", None, *ok[1:]), ("RISK", "Riesgo", *ok[1:]), ("NOGROWTH", ok[0], None, *ok[2:]), ("ERR", *ok[:5], "x"), ("THIN", *ok[:3], 10.0, *ok[4:])]
    assert {r.ticker_usd for r in P.quality_filter(spark.createDataFrame(rows, ddl)).collect()} == {"OK", "NOCLASS"}


def test_weekly_portfolio_is_saved_once(table):
    row = lambda d, origin, t: {"fecha_seleccion": d, "origen": origin, "ticker_usd": t, "puesto": 1}
    monday = dt.date(2026, 11, 16)
    saved = table("fact_cartera_seleccionada", [])
    for d in (monday, monday + 2 * DAY):
        saved = merge.save_portfolio(saved, table("fact_cartera_seleccionada", [row(d, "semanal", "AAA")]))
    assert [r.fecha_seleccion for r in saved.collect()] == [monday]
    saved = merge.save_portfolio(saved, table("fact_cartera_seleccionada", [row(monday + 7 * DAY, "semanal", "BBB"), row(monday, "manual", "C")]))
    saved = merge.save_portfolio(saved, table("fact_cartera_seleccionada", [row(monday, "manual", "D")]))
    assert sorted((r.origen, r.ticker_usd) for r in saved.collect()) == [("manual", "D"), ("semanal", "AAA"), ("semanal", "BBB")]
    assert merge.week_already_saved(saved, monday + 4 * DAY).collect()[0].ya and not merge.week_already_saved(saved, monday - DAY).collect()[0].ya


def test_last_of_two_close_report_dates(table):
    eps = table("fact_eps_trimestral", [{"ticker_usd": "UBER", "fecha_reporte": TODAY + k * DAY} for k in (8, 9, 100)])
    assert sorted(r.fecha_reporte for r in MO.report_dates(eps).collect()) == [TODAY + 9 * DAY, TODAY + 100 * DAY]


def gold(spark):
    return (
        spark.createDataFrame([], "ticker_usd string, tech_rsi14 double, tech_dist_max_52s_pct double"),
        spark.createDataFrame([], "ticker_usd string, sent_clasificacion string"),
        spark.createDataFrame([], "ticker_usd string, regla string, severidad string"),
    )


def test_watchlist_reports_a_possible_entry(table, spark):
    closes = [10.0] * 84 + [9.0, 8.0, 7.0, 6.0, 5.8, 5.7, 5.65] + [5.6] + [6.2, 6.8, 7.4, 8.0, 8.4, 8.8, 9.0, 9.2]
    lows = [c * 0.99 for c in closes]
    lows[91] = 5.0
    prices = table("fact_precios_daily", bars("BBD", closes, [1000] * 91 + [6000] + [1500] * 8, lows=lows))
    macro = table("fact_macro_daily", [{"serie": "USDBRL", "fecha": d, "valor": 5.6 - 0.01 * i} for i, d in enumerate(sessions(8))])
    watch = table("seguimiento", [{"ticker_usd": "BBD", "desde": TODAY, "moneda": "USDBRL", "activo": True, "nivel_salida": 9.5, "nivel_soporte": 9.9},
                                  {"ticker_usd": "OFF", "desde": TODAY, "activo": False}])
    dim = table("dim_empresa", [{"ticker_usd": t, "nombre_empresa": t} for t in ("BBD", "OFF")])
    eps = table("fact_eps_trimestral", [{"ticker_usd": "BBD", "fecha_reporte": sessions(3)[0]}])
    row, = MO.monitor_watchlist(watch, prices, macro, eps, dim, *gold(spark), TODAY).collect()
    assert row.activas >= 3 and row.senales == 5
    text = "; ".join(row.alertas)
    assert "posible punto de entrada" in text and "moneda_estable" in text and "nivel de salida 9.5" in text and "soporte" not in text
    assert row.ultimo_reporte == sessions(3)[0] and row.reaccion_dia_reporte_pct == round((8.8 / 8.8 - 1) * 100 + (closes[-3] / closes[-4] - 1) * 100, 1)


def test_manual_portfolio_wins_and_alerts_are_named(table, spark):
    rows = [{"fecha_seleccion": TODAY, "origen": o, "ticker_usd": t, "puesto": 1, "precio_seleccion": 20.0} for o, t in (("semanal", "W"), ("manual", "M"))]
    rows.append({"fecha_seleccion": TODAY - 30 * DAY, "origen": "manual", "ticker_usd": "OLD", "puesto": 1, "precio_seleccion": 1.0})
    prices = table("fact_precios_daily", bars("M", [14, 14, 14, 14, 14, 12]) + bars("W", [1] * 6))
    eps = table("fact_eps_trimestral", [{"ticker_usd": "M", "fecha_reporte": TODAY + 3 * DAY}])
    refuge = spark.createDataFrame([("M", "Refugio")], "ticker_usd string, refugio_segmento string")
    dim = table("dim_empresa", [{"ticker_usd": t, "nombre_empresa": t} for t in "MW"])
    row, = MO.monitor_portfolio(table("fact_cartera_seleccionada", rows), prices, eps, dim, *gold(spark), refuge, TODAY).collect()
    assert row.ticker_usd == "M" and row.refugio_segmento == "Refugio"
    assert row.alertas == ["cayó -14.3% en 5 ruedas", "-40.0% desde la selección", f"presenta resultados el {TODAY + 3 * DAY}"]


def test_evaluation_by_hand(table):
    d = sessions(5)
    px = {"AAPL": [10, 10, 10, 10, 20], "B": [10, 10, 20, 20, 30], "C": [5, 5, 5, 5, 5], "COIN": [1, 1, 1, 1, 99]}
    prices = table("fact_precios_daily", [r for t, v in px.items() for r in bars(t, v)])
    dim = table("dim_empresa", [{"ticker_usd": t, "mercado": "cripto" if t == "COIN" else "usa_otros"} for t in px])
    saved = table("fact_cartera_seleccionada", [{"fecha_seleccion": d[2], "origen": "manual", "ticker_usd": t, "precio_seleccion": p} for t, p in (("AAPL", 10), ("B", 20))])
    macro = table("fact_macro_daily", [{"serie": "SP500", "fecha": x, "valor": v} for x, v in ((d[1], 100), (d[3], 105), (d[4], 110))])
    row, = P.evaluate_portfolios(saved, prices, macro, dim).collect()
    assert (row.cartera_pct, row.universo_mediana_pct, row.sp500_pct, row.vs_universo_pp, row.empresas) == (75.0, 50.0, 10.0, 25.0, 2)
