"""Queries over selection, follow-up, signals, falls and swings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickerloom.catalog.base import QUERIES, query
from tickerloom.catalog.fundamentals import (
    COMPS_SQL,
    HEALTH_SQL,
    SENT_SQL,
    STYLE_SQL,
    UPSIDE_SQL,
    comps_of,
    health_of,
    sentiment_of,
    styles_of,
    upside_of,
)
from tickerloom.catalog.prices import QUALITY_BODY, TECH_SQL, quality_of
from tickerloom.operators import monitor as MO
from tickerloom.operators import portfolio as P
from tickerloom.operators import refuge as RF
from tickerloom.operators import research as R
from tickerloom.operators import signals as SG
from tickerloom.operators import swings as SW
from tickerloom.operators import technical as T
from tickerloom.sources import adapters as A
from tickerloom.sources.scratch import stored, stored_by

# Provided volumes are small and histories short; the thresholds keep their meaning at another level.
MIN_VOLUME, MIN_HISTORY, MIN_REFUGE_DAYS = 10, 200, 300

# What each subject says about a company, met by name; a subject with nothing to say leaves its columns unknown.
CANDIDATES_SQL = f"""
WITH history AS (SELECT ticker_usd, count(*) AS dias_precio, avg(if(today - fecha <= 30, volume, NULL)) AS vol_prom_30d FROM bars, (SELECT max(fecha) AS today FROM bars) GROUP BY 1),
doubts AS (SELECT ticker_usd, array_to_string(list_sort(list(regla) FILTER (WHERE severidad = 'error')), ', ') AS errores_datos, count_if(severidad = 'advertencia') AS n_adv,
                  count_if(regla = 'margen_incoherente') > 0 AS one_off FROM ({QUALITY_BODY.format(behind=7)}) GROUP BY 1),
opinion AS (SELECT DISTINCT ON (ticker_usd) ticker_usd, COLUMNS('^rec_'), precio_objetivo_mediana FROM consensus ORDER BY ticker_usd, fecha DESC),
health AS (SELECT ticker_usd, margen_neto_pct, COLUMNS('^salud_') FROM ({HEALTH_SQL})),
peers AS (SELECT ticker_usd, COLUMNS('^comp_p') FROM ({COMPS_SQL})),
chart AS (SELECT ticker_usd, COLUMNS('^tech_') FROM ({TECH_SQL})),
mood AS (SELECT ticker_usd, COLUMNS('^sent_') FROM ({SENT_SQL})),
style AS (SELECT * EXCLUDE (margen_neto_pct) FROM ({STYLE_SQL}) WHERE mercado <> 'cripto')
SELECT *, coalesce(one_off, false) AS ganancia_no_recurrente
FROM health JOIN peers USING (ticker_usd) JOIN style USING (ticker_usd) LEFT JOIN history USING (ticker_usd) LEFT JOIN opinion USING (ticker_usd) LEFT JOIN chart USING (ticker_usd)
     LEFT JOIN mood USING (ticker_usd) LEFT JOIN doubts USING (ticker_usd)"""


FILTERED_SQL = f"""
SELECT * FROM ({CANDIDATES_SQL}) WHERE (salud_clasificacion IS NULL OR salud_clasificacion <> 'Riesgo') AND crecimiento_ganancia_anual_pct > -20
  AND margen_neto_pct > 0 AND vol_prom_30d >= {MIN_VOLUME} AND dias_precio >= {MIN_HISTORY} AND errores_datos IS NULL"""

RANKED_SQL = f"""
SELECT *, (coalesce(pct_checklist, 0) + coalesce(pct_barata, 0) + coalesce(pct_salud, 0))
          / nullif(CAST(pct_checklist IS NOT NULL AS INTEGER) + CAST(pct_barata IS NOT NULL AS INTEGER) + CAST(pct_salud IS NOT NULL AS INTEGER), 0) AS score_compuesto
FROM (SELECT *, (rank() OVER (ORDER BY lynch_checklist_score) + (count(*) OVER (PARTITION BY lynch_checklist_score) - 1) / 2e0) / count(*) OVER () AS pct_checklist,
             CASE WHEN lynch_categoria_auto = 'Ciclica' OR ganancia_no_recurrente THEN 0.5
                  WHEN inv IS NOT NULL THEN (rank() OVER (ORDER BY inv ASC NULLS LAST) + (count(*) OVER (PARTITION BY inv) - 1) / 2e0) / count(inv) OVER () END AS pct_barata,
             CASE WHEN sr IS NOT NULL THEN (rank() OVER (ORDER BY sr ASC NULLS LAST) + (count(*) OVER (PARTITION BY sr) - 1) / 2e0) / count(sr) OVER () END AS pct_salud
      FROM (SELECT *, -comp_pe_vs_sector_pct AS inv, CAST(salud_score AS DOUBLE) / nullif(salud_evaluables, 0) AS sr FROM ({FILTERED_SQL})))"""


def candidates_of(spark, sf):
    """Bars and monthly sums are rolled up from the lines once each; the sums lie by ticker, as five readers add them up per ticker."""
    b = stored(A.bars(spark, sf).drop("open"), "bars")
    months = stored_by(A.lines_by_month(spark, sf).drop("net", "et"), "ticker_usd", "p", "months")
    m = A.metrics(spark, sf, months)
    return P.candidates(
        styles_of(spark, sf, m, b), comps_of(spark, sf, m), health_of(spark, sf, m, months), T.technical(b, rounded_output=False),
        A.consensus(spark, sf, months), sentiment_of(spark, sf), b, quality_of(spark, sf, b, m), A.last_day(spark, sf),
    )


def filtered_of(spark, sf):
    return P.quality_filter(candidates_of(spark, sf), MIN_VOLUME, MIN_HISTORY)


def ranked_of(spark, sf):
    return P.rank_candidates(filtered_of(spark, sf))


@query(
    "portfolio_candidates",
    "ticker_usd sector mercado pais_origen lynch_categoria_auto lynch_checklist_score:i comp_pe_vs_sector_pct:f4 salud_score:i salud_evaluables:i salud_clasificacion "
    "tech_rsi14:f4 tech_tendencia precio_objetivo_mediana:f4 rec_buy:i rec_sell:i sent_score_promedio:f4 sent_clasificacion dias_precio:i vol_prom_30d:f4 errores_datos "
    "ganancia_no_recurrente:b",
    CANDIDATES_SQL,
)
def portfolio_candidates(spark, sf):
    return candidates_of(spark, sf)


@query("quality_filter", "ticker_usd salud_clasificacion margen_neto_pct:f4 vol_prom_30d:f4 dias_precio:i", FILTERED_SQL)
def quality_filter(spark, sf):
    return filtered_of(spark, sf)


@query("composite_ranking", "ticker_usd pct_checklist:f6 pct_barata:f6 pct_salud:f6 score_compuesto:f6", RANKED_SQL)
def composite_ranking(spark, sf):
    return ranked_of(spark, sf)


@query(
    "external_alerts",
    "ticker_usd alerta_analistas:b alerta_sentimiento:b alerta_historia_corta:b alerta_datos:b",
    f"""SELECT ticker_usd, coalesce(rec_sell, 0) + coalesce(rec_strong_sell, 0) > coalesce(rec_buy, 0) + coalesce(rec_strong_buy, 0) AS alerta_analistas,
       coalesce(sent_clasificacion = 'Negativo', false) AS alerta_sentimiento, coalesce(dias_precio < 1000, false) AS alerta_historia_corta, coalesce(n_adv, 0) > 0 AS alerta_datos
FROM ({CANDIDATES_SQL})""",
)
def external_alerts(spark, sf):
    return P.external_alerts(candidates_of(spark, sf))


WALK_SQL = """
walk AS (
  SELECT CAST(0 AS BIGINT) AS k, CAST([] AS VARCHAR[]) AS ts, CAST([] AS VARCHAR[]) AS ss, CAST([] AS VARCHAR[]) AS rs
  UNION ALL
  SELECT k2, CASE WHEN ok THEN list_append(ts, ticker_usd) ELSE ts END, CASE WHEN ok THEN list_append(ss, sector) ELSE ss END, CASE WHEN ok THEN list_append(rs, region) ELSE rs END
  FROM (SELECT w.*, r2.ticker_usd, r2.sector, r2.region, r2.k AS k2,
               len(list_filter(w.ss, lambda x: x = r2.sector)) < 2 AND len(list_filter(w.rs, lambda x: x = r2.region)) < 2 AND len(w.ts) < 9 AS ok
        FROM walk w JOIN r r2 ON r2.k = w.k + 1) x),
chosen AS (SELECT t.ticker_usd, t.puesto, r.* EXCLUDE (ticker_usd) FROM (SELECT unnest(ts) AS ticker_usd, generate_subscripts(ts, 1) AS puesto FROM (SELECT * FROM walk ORDER BY k DESC LIMIT 1)) t
           JOIN r ON r.ticker_usd = t.ticker_usd)"""
REGION_SQL = "CASE WHEN mercado IN ('argentina_local', 'brasil') THEN mercado ELSE pais_origen END AS region"
SELECTED_SQL = f"""
WITH RECURSIVE r AS MATERIALIZED (SELECT ticker_usd, sector, {REGION_SQL}, score_compuesto, row_number() OVER (ORDER BY score_compuesto DESC, ticker_usd) AS k FROM ({RANKED_SQL})),
{WALK_SQL}"""


@query("portfolio_select", "ticker_usd puesto:i sector region score_compuesto:f6", SELECTED_SQL + " SELECT * FROM chosen")
def portfolio_select(spark, sf):
    return P.select_diversified(ranked_of(spark, sf))


@query(
    "select_by_volume",
    "ticker_usd puesto:i sector region",
    """
WITH RECURSIVE r AS MATERIALIZED (
  SELECT ticker_usd, sector, """
    + REGION_SQL
    + """, row_number() OVER (ORDER BY v DESC, ticker_usd) AS k
  FROM (SELECT d.ticker_usd, sector, mercado, pais_origen, v FROM dim d JOIN (SELECT ticker_usd, sum(volume) AS v FROM bars GROUP BY 1) b ON b.ticker_usd = d.ticker_usd)),"""
    + WALK_SQL
    + " SELECT * FROM chosen",
)
def select_by_volume(spark, sf):
    traded = A.bars(spark, sf).groupBy("ticker_usd").agg(F.sum("volume").cast("double").alias("score_compuesto"))
    return P.select_diversified(A.dim(spark, sf).join(traded, "ticker_usd"))


@query(
    "save_portfolio",
    "fecha_seleccion origen ticker_usd puesto:i precio_seleccion:f6",
    SELECTED_SQL
    + """ SELECT max(f) OVER () AS fecha_seleccion, 'manual' AS origen, c.ticker_usd, puesto, precio_seleccion
FROM chosen c JOIN (SELECT ticker_usd, max(fecha) AS f, arg_max(adj_close, fecha) AS precio_seleccion FROM bars GROUP BY 1) b ON b.ticker_usd = c.ticker_usd""",
)
def save_portfolio(spark, sf):
    chosen = P.external_alerts(P.select_diversified(ranked_of(spark, sf)))
    return P.portfolio_rows(chosen, A.bars(spark, sf), "manual")


@query(
    "evaluate_portfolios",
    "fecha_seleccion origen empresas:i hasta dias:i cartera_pct:f4 universo_mediana_pct:f4 sp500_pct:f4 vs_universo_pp:f4",
    """
WITH quote AS (SELECT ticker_usd, max(fecha) AS last_day, arg_max(adj_close, fecha) AS last_price FROM bars GROUP BY 1),
slices AS (SELECT fecha_seleccion, origen, avg(last_price / precio_seleccion) AS own, count(*) AS empresas, max(last_day) AS hasta FROM saved JOIN quote USING (ticker_usd) GROUP BY ALL),
days AS (SELECT DISTINCT fecha_seleccion FROM saved),
sessions AS (SELECT fecha_seleccion, b.fecha FROM days ASOF JOIN (SELECT fecha FROM bars WHERE ticker_usd = 'S1') b ON fecha_seleccion >= b.fecha),
everybody AS (SELECT fecha_seleccion, median(last_price / adj_close) AS typical FROM sessions JOIN bars USING (fecha) JOIN quote USING (ticker_usd) SEMI JOIN (SELECT ticker_usd FROM dim WHERE mercado NOT IN ('etf', 'cripto')) USING (ticker_usd)
              WHERE adj_close > 0 GROUP BY 1),
level AS (SELECT fecha, valor FROM macro WHERE serie = 'SP500'),
market AS (SELECT fecha_seleccion, (SELECT arg_max(valor, fecha) FROM level) / valor AS index_ FROM days ASOF JOIN level ON fecha_seleccion >= fecha)
SELECT fecha_seleccion, origen, empresas, hasta, date_diff('day', fecha_seleccion, hasta) AS dias, own * 100 - 100 AS cartera_pct, typical * 100 - 100 AS universo_mediana_pct,
       index_ * 100 - 100 AS sp500_pct, (own - typical) * 100 AS vs_universo_pp
FROM slices JOIN everybody USING (fecha_seleccion) JOIN market USING (fecha_seleccion)""",
)
def evaluate_portfolios(spark, sf):
    return P.evaluate_portfolios(
        A.saved_portfolios(spark, sf), A.bars(spark, sf), A.macro(spark, sf), A.dim(spark, sf), calendar_ticker="S1", rounded_output=False
    )


def _rolled_up(spark, sf):
    """Bars and metrics for queries that read them in many places: rolled up from the lines once each."""
    return stored(A.bars(spark, sf), "bars"), stored(A.metrics(spark, sf), "metrics")


@query(
    "stretch_groups",
    "ticker_usd tech_rsi14:f4 upside_pct:f4 pasa_calidad:b grupo pe_trailing:f4 comp_pe_vs_sector_pct:f4 roe_pct:f4 sent_clasificacion",
    f"""
SELECT l.ticker_usd, t.tech_rsi14, u.upside_pct, ok AS pasa_calidad,
       CASE WHEN NOT ok THEN 'No pasa calidad' WHEN coalesce(t.tech_rsi14 >= 70, false) OR coalesce(u.upside_pct < 0, false) THEN 'Calidad, estirada' ELSE 'Calidad, no estirada' END AS grupo,
       c.pe_trailing, c.comp_pe_vs_sector_pct, c.roe_pct, se.sent_clasificacion
FROM (SELECT l.ticker_usd, coalesce((salud_clasificacion IS NULL OR salud_clasificacion <> 'Riesgo') AND crecimiento_ganancia_anual_pct > -20 AND s.margen_neto_pct > 0, false) AS ok
      FROM ({STYLE_SQL}) l JOIN ({HEALTH_SQL}) s ON s.ticker_usd = l.ticker_usd) l
JOIN ({COMPS_SQL}) c ON c.ticker_usd = l.ticker_usd LEFT JOIN ({SENT_SQL}) se ON se.ticker_usd = l.ticker_usd
LEFT JOIN ({TECH_SQL}) t ON t.ticker_usd = l.ticker_usd LEFT JOIN ({UPSIDE_SQL}) u ON u.ticker_usd = l.ticker_usd""",
)
def stretch_groups(spark, sf):
    b, m = _rolled_up(spark, sf)
    waves = SW.wave_state(SW.zigzag(b), b)
    return P.stretch_groups(
        styles_of(spark, sf, m, b), health_of(spark, sf, m), T.technical(b, rounded_output=False), upside_of(spark, sf, b), waves, comps_of(spark, sf, m), sentiment_of(spark, sf)
    )


@query(
    "watch_states", "ticker_usd estado onda_pierna_actual pasa_liquidez:b",
    f"""
SELECT l.ticker_usd, CASE WHEN tech_rsi14 <= 30 THEN 'Cayendo, sobrevendida' WHEN w.tipo = 'H' THEN 'Cayendo' ELSE 'Rebotando' END AS estado,
       CASE w.tipo WHEN 'H' THEN 'Baja' WHEN 'L' THEN 'Suba' END AS onda_pierna_actual, coalesce(tech_volumen_prom_30d >= 50000, false) AS pasa_liquidez
FROM ({HEALTH_SQL}) l JOIN ({COMPS_SQL}) c ON c.ticker_usd = l.ticker_usd LEFT JOIN ({TECH_SQL}) t ON t.ticker_usd = l.ticker_usd LEFT JOIN swing_state w ON w.ticker_usd = l.ticker_usd""",
)
def watch_states(spark, sf):
    return stretch_groups(spark, sf)


@query(
    "monitor_portfolio",
    "fecha_seleccion origen ticker_usd puesto:i fecha_precio precio_actual:f6 desde_seleccion_pct:f4 ultimas_5_ruedas_pct:f4 tech_rsi14:f4 proximo_reporte sent_clasificacion errores_datos n_alertas:i",
    f"""
WITH slice AS (SELECT fecha_seleccion, origen FROM saved ORDER BY fecha_seleccion DESC, origen <> 'manual' LIMIT 1),
closes AS (SELECT ticker_usd, max(fecha) AS fecha_precio, list(adj_close ORDER BY fecha DESC) AS c FROM bars GROUP BY 1),
due AS (SELECT ticker_usd, min(fecha_reporte) AS proximo_reporte FROM eps WHERE eps_reportado IS NULL AND fecha_reporte >= (SELECT max(fecha_precio) FROM closes) GROUP BY 1),
errors AS (SELECT ticker_usd, array_to_string(list_sort(list(regla)), ', ') AS errores_datos FROM ({QUALITY_BODY.format(behind=7)}) WHERE severidad = 'error' GROUP BY 1),
chart AS (SELECT ticker_usd, tech_rsi14 FROM ({TECH_SQL})), mood AS (SELECT ticker_usd, sent_clasificacion FROM ({SENT_SQL})),
held AS (SELECT * EXCLUDE (c), c[1] AS precio_actual, c[1] * 100 / precio_seleccion - 100 AS desde_seleccion_pct, c[1] * 100 / c[6] - 100 AS ultimas_5_ruedas_pct
         FROM saved SEMI JOIN slice USING (fecha_seleccion, origen) SEMI JOIN dim USING (ticker_usd) LEFT JOIN closes USING (ticker_usd) LEFT JOIN due USING (ticker_usd) LEFT JOIN errors USING (ticker_usd)
              LEFT JOIN chart USING (ticker_usd) LEFT JOIN mood USING (ticker_usd))
SELECT *, len(list_filter([errores_datos IS NOT NULL, sent_clasificacion = 'Negativo', tech_rsi14 >= 80, tech_rsi14 <= 25, desde_seleccion_pct <= -15, ultimas_5_ruedas_pct <= -10,
                           date_diff('day', (SELECT max(fecha) FROM bars), proximo_reporte) <= 7], lambda said: coalesce(said, false))) AS n_alertas FROM held""",
)
def monitor_portfolio(spark, sf):
    b = A.bars(spark, sf)
    refuge = RF.refuge(b, A.macro(spark, sf), A.dim(spark, sf), min_days=MIN_REFUGE_DAYS)
    return MO.monitor_portfolio(
        A.saved_portfolios(spark, sf), b, A.eps_reports(spark, sf), A.dim(spark, sf), T.technical(b, rounded_output=False),
        sentiment_of(spark, sf), quality_of(spark, sf), refuge, A.last_day(spark, sf), rounded_output=False,
    )


WATCH_REPORTS_SQL = """
SELECT DISTINCT ticker_usd, fecha_reporte FROM eps e
WHERE NOT EXISTS (SELECT 1 FROM eps o WHERE o.ticker_usd = e.ticker_usd AND o.fecha_reporte > e.fecha_reporte AND o.fecha_reporte <= e.fecha_reporte + {within})"""


@query("report_dates", "ticker_usd fecha_reporte", WATCH_REPORTS_SQL.format(within=95))
def report_dates(spark, sf):
    return MO.report_dates(A.eps_reports(spark, sf), within=95)


@query(
    "asof_around_reports",
    "ticker_usd ultimo_reporte precio_pre_reporte:f6 precio_dia_reporte:f6",
    """
SELECT ticker_usd, fecha_reporte AS ultimo_reporte, arg_max(adj_close, fecha) FILTER (WHERE fecha < fecha_reporte) AS precio_pre_reporte,
       arg_min(adj_close, fecha) FILTER (WHERE fecha >= fecha_reporte) AS precio_dia_reporte
FROM (SELECT e.ticker_usd, e.fecha_reporte, b.fecha, b.adj_close FROM eps e JOIN bars b ON b.ticker_usd = e.ticker_usd) GROUP BY 1, 2""",
)
def asof_around_reports(spark, sf):
    reports = A.eps_reports(spark, sf).select("ticker_usd", F.col("fecha_reporte").alias("ultimo_reporte"))
    return MO.report_reaction(reports, A.bars(spark, sf))


WATCH_SQL = f"""
WITH reports AS ({WATCH_REPORTS_SQL.format(within=5)}), clock AS (SELECT max(fecha) AS today FROM bars),
closes AS (SELECT ticker_usd, max(fecha) AS fecha_precio, list(adj_close ORDER BY fecha DESC) AS c FROM bars GROUP BY 1),
ahead AS (SELECT ticker_usd, min(fecha_reporte) AS proximo_reporte FROM reports, clock WHERE fecha_reporte > today GROUP BY 1),
behind AS (SELECT ticker_usd, max(fecha_reporte) AS ultimo_reporte FROM reports, clock WHERE today - fecha_reporte BETWEEN 0 AND 7 GROUP BY 1),
eve AS (SELECT behind.ticker_usd, adj_close AS pre FROM behind ASOF JOIN bars ON behind.ticker_usd = bars.ticker_usd AND ultimo_reporte > fecha),
day_ AS (SELECT behind.ticker_usd, adj_close AS dia FROM behind ASOF JOIN bars ON behind.ticker_usd = bars.ticker_usd AND ultimo_reporte <= fecha)
SELECT ticker_usd, fecha_precio, c[1] AS precio, c[1] * 100 / c[2] - 100 AS dia_pct, c[1] * 100 / c[6] - 100 AS ultimas_5_ruedas_pct, proximo_reporte, ultimo_reporte,
       dia * 100 / pre - 100 AS reaccion_dia_reporte_pct, c[1] * 100 / pre - 100 AS desde_pre_reporte_pct
FROM watch SEMI JOIN dim USING (ticker_usd) LEFT JOIN closes USING (ticker_usd) LEFT JOIN ahead USING (ticker_usd) LEFT JOIN behind USING (ticker_usd) LEFT JOIN eve USING (ticker_usd)
     LEFT JOIN day_ USING (ticker_usd) WHERE activo"""


@query(
    "watchlist_levels",
    "ticker_usd fecha_precio precio:f4 dia_pct:f4 ultimas_5_ruedas_pct:f4 proximo_reporte ultimo_reporte reaccion_dia_reporte_pct:f4 desde_pre_reporte_pct:f4",
    WATCH_SQL,
)
def watchlist_levels(spark, sf):
    return _watch(spark, sf)


def _watch(spark, sf):
    b, m = _rolled_up(spark, sf)
    return MO.monitor_watchlist(
        A.watchlist(spark, sf, b), b, A.macro(spark, sf), A.eps_reports(spark, sf), A.dim(spark, sf), T.technical(b, rounded_output=False),
        sentiment_of(spark, sf), quality_of(spark, sf, b, m), A.last_day(spark, sf), rounded_output=False,
    )


SIGNALS_SQL = {
    "moneda_estable": """
SELECT w.ticker_usd, 'moneda_estable' AS senal, n >= 6 AND coalesce((v1 / v6 - 1) * 100 <= 0, false) AS activa FROM watch w JOIN (
  SELECT serie, count(*) AS n, max(valor) FILTER (WHERE k = 1) AS v1, max(valor) FILTER (WHERE k = 6) AS v6
  FROM (SELECT *, row_number() OVER (PARTITION BY serie ORDER BY fecha DESC) AS k FROM macro WHERE fecha <= (SELECT max(fecha) FROM bars)) WHERE k <= 6 GROUP BY 1) m ON m.serie = w.moneda""",
    "capitulacion": """
SELECT ticker_usd, 'capitulacion' AS senal, count(*) >= 40 AND bool_or(k <= 10 AND volume >= 3 * prom AND (close - low) / nullif(high - low, 0) >= 0.5) IS TRUE AS activa FROM (
  SELECT *, CASE WHEN count(volume) OVER (w ROWS BETWEEN 90 PRECEDING AND 1 PRECEDING) >= 30 THEN avg(volume) OVER (w ROWS BETWEEN 90 PRECEDING AND 1 PRECEDING) END AS prom
  FROM (SELECT *, row_number() OVER (PARTITION BY ticker_usd ORDER BY fecha DESC) AS k FROM bars QUALIFY k <= 100) WINDOW w AS (PARTITION BY ticker_usd ORDER BY fecha)) GROUP BY 1""",
    "dejo_de_hacer_minimos": """
SELECT ticker_usd, 'dejo_de_hacer_minimos' AS senal, max(n) >= 10 AND (max(minimo) / max(adj_close) FILTER (WHERE k BETWEEN km AND km + 60) - 1) * 100 <= -15 AND max(km) - 1 >= 3
       AND (max(adj_close) FILTER (WHERE k = 1) / max(minimo) - 1) * 100 >= 3 AS activa
FROM (SELECT *, min(CASE WHEN k <= 20 THEN adj_close END) OVER (PARTITION BY ticker_usd) AS minimo, arg_min(k, ROW(CASE WHEN k <= 20 THEN adj_close ELSE 1e300 END, -k)) OVER (PARTITION BY ticker_usd) AS km,
             count(*) OVER (PARTITION BY ticker_usd) AS n
      FROM (SELECT *, row_number() OVER (PARTITION BY ticker_usd ORDER BY fecha DESC) AS k FROM bars QUALIFY k <= 80)) GROUP BY 1""",
    "post_reporte": """
SELECT t.ticker_usd, 'post_reporte' AS senal, coalesce((ult / pre - 1) * 100 >= -3, false) AS activa
FROM (SELECT ticker_usd, arg_max(adj_close, fecha) AS ult FROM bars GROUP BY 1) t LEFT JOIN (
  SELECT e.ticker_usd, arg_max(b.adj_close, b.fecha) AS pre
  FROM (SELECT ticker_usd, max(fecha_reporte) AS r FROM eps WHERE fecha_reporte <= (SELECT max(fecha) FROM bars) AND fecha_reporte >= (SELECT max(fecha) FROM bars) - 10 GROUP BY 1) e
  JOIN bars b ON b.ticker_usd = e.ticker_usd AND b.fecha < e.r GROUP BY 1) p ON p.ticker_usd = t.ticker_usd""",
    "rsi_recupera": """
SELECT ticker_usd, 'rsi_recupera' AS senal, count(*) >= 20 AND coalesce(bool_or(k <= 15 AND rsi < 30), false) AND coalesce(max(rsi) FILTER (WHERE k = 1) > 30, false) AS activa FROM (
  SELECT *, CASE WHEN nd >= 14 THEN CASE WHEN l = 0 AND g > 0 THEN 100 ELSE 100 - 100 / (1 + g / nullif(l, 0)) END END AS rsi FROM (
    SELECT *, avg(greatest(delta, 0)) FILTER (WHERE delta IS NOT NULL) OVER (w ROWS 13 PRECEDING) AS g, avg(greatest(-delta, 0)) FILTER (WHERE delta IS NOT NULL) OVER (w ROWS 13 PRECEDING) AS l,
           count(delta) OVER (w ROWS 13 PRECEDING) AS nd
    FROM (SELECT *, adj_close - lag(adj_close) OVER (PARTITION BY ticker_usd ORDER BY fecha) AS delta
          FROM (SELECT *, row_number() OVER (PARTITION BY ticker_usd ORDER BY fecha DESC) AS k FROM bars QUALIFY k <= 60))
    WINDOW w AS (PARTITION BY ticker_usd ORDER BY fecha))) GROUP BY 1""",
}
ALL_SIGNALS_SQL = " UNION ALL ".join(f"SELECT ticker_usd, senal, activa FROM ({s})" for s in SIGNALS_SQL.values())
SIGNAL_COLUMNS = "ticker_usd senal activa:b"


@query(
    "watchlist_alerts",
    "ticker_usd activas:i senales:i n_alertas:i",
    f"""
SELECT v.ticker_usd, s.activas, s.senales,
       CAST(coalesce(precio <= nivel_salida, false) OR coalesce(precio <= nivel_soporte, false) AS INTEGER) + CAST(coalesce(precio >= nivel_resistencia, false) AS INTEGER)
       + CAST(coalesce(proximo_reporte - (SELECT max(fecha) FROM bars) <= 7, false) AS INTEGER) + CAST(ultimo_reporte IS NOT NULL AS INTEGER)
       + CAST(coalesce(ultimas_5_ruedas_pct <= -10, false) AS INTEGER) + CAST(coalesce(tech_rsi14 <= 25 OR tech_rsi14 >= 80, false) AS INTEGER)
       + CAST(e.ticker_usd IS NOT NULL AS INTEGER) + CAST(s.activas >= 3 AS INTEGER) AS n_alertas
FROM ({WATCH_SQL}) v JOIN watch w ON w.ticker_usd = v.ticker_usd JOIN (SELECT ticker_usd, count(*) AS senales, count(*) FILTER (WHERE activa) AS activas FROM ({ALL_SIGNALS_SQL}) GROUP BY 1) s
  ON s.ticker_usd = v.ticker_usd LEFT JOIN ({TECH_SQL}) t ON t.ticker_usd = v.ticker_usd
LEFT JOIN (SELECT DISTINCT ticker_usd FROM ({QUALITY_BODY.format(behind=7)}) WHERE severidad = 'error') e ON e.ticker_usd = v.ticker_usd""",
)
def watchlist_alerts(spark, sf):
    return _watch(spark, sf)


@query("signal_currency_stable", SIGNAL_COLUMNS, SIGNALS_SQL["moneda_estable"])
def signal_currency_stable(spark, sf):
    return SG.currency_stable(A.watchlist(spark, sf), A.macro(spark, sf), A.last_day(spark, sf))


@query("signal_capitulation", SIGNAL_COLUMNS, SIGNALS_SQL["capitulacion"])
def signal_capitulation(spark, sf):
    return SG.capitulation(A.watchlist(spark, sf), A.bars(spark, sf), A.last_day(spark, sf))


@query("signal_stopped_falling", SIGNAL_COLUMNS, SIGNALS_SQL["dejo_de_hacer_minimos"])
def signal_stopped_falling(spark, sf):
    return SG.stopped_falling(A.watchlist(spark, sf), A.bars(spark, sf), A.last_day(spark, sf))


@query("signal_post_report", SIGNAL_COLUMNS, SIGNALS_SQL["post_reporte"])
def signal_post_report(spark, sf):
    return SG.post_report(A.watchlist(spark, sf), A.bars(spark, sf), A.eps_reports(spark, sf), A.last_day(spark, sf))


@query("signal_rsi_recovers", SIGNAL_COLUMNS, SIGNALS_SQL["rsi_recupera"])
def signal_rsi_recovers(spark, sf):
    return SG.rsi_recovers(A.watchlist(spark, sf), A.bars(spark, sf), A.last_day(spark, sf))


@query(
    "signal_count",
    "ticker_usd senales:i activas:i nombres",
    f"SELECT ticker_usd, count(*) AS senales, count(*) FILTER (WHERE activa) AS activas, string_agg(senal, ', ' ORDER BY senal) FILTER (WHERE activa) AS nombres FROM ({ALL_SIGNALS_SQL}) GROUP BY 1",
)
def signal_count(spark, sf):
    return SG.count_active(SG.evaluate_signals(A.watchlist(spark, sf), A.bars(spark, sf), A.macro(spark, sf), A.eps_reports(spark, sf), A.last_day(spark, sf)))


ALIGNED_SQL = """
idx AS (SELECT fecha, valor, row_number() OVER (ORDER BY fecha) AS i FROM macro WHERE serie = 'SP500'),
al AS (SELECT x.ticker_usd, c.i, c.fecha, x.adj_close FROM (
         SELECT b.ticker_usd, b.adj_close, c.i AS i0, least(c.i + 3, coalesce(lead(c.i) OVER (PARTITION BY b.ticker_usd ORDER BY c.i) - 1, (SELECT max(i) FROM idx))) AS i1
         FROM bars b JOIN dim d ON d.ticker_usd = b.ticker_usd AND d.mercado IN ('usa_otros', 'etf') JOIN idx c ON c.fecha = b.fecha WHERE adj_close > 0) x
       JOIN idx c ON c.i BETWEEN x.i0 AND x.i1),
ret AS (SELECT a.ticker_usd, a.adj_close / p.adj_close - 1 AS a, c.valor / cp.valor - 1 AS m
        FROM al a JOIN al p ON p.ticker_usd = a.ticker_usd AND p.i = a.i - 1 JOIN idx c ON c.i = a.i JOIN idx cp ON cp.i = a.i - 1),
ep AS (SELECT * FROM (
  SELECT min(pico) AS pico, arg_max(piso, fecha) AS piso, min(caida) AS cm FROM (
    SELECT *, sum(CASE WHEN caida = 0 THEN 1 ELSE 0 END) OVER (ORDER BY fecha) AS tramo, min(CASE WHEN caida = 0 THEN fecha END) OVER (PARTITION BY m ORDER BY fecha) AS pico,
           arg_min(fecha, valor) OVER (PARTITION BY m ORDER BY fecha) AS piso
    FROM (SELECT *, valor / m - 1 AS caida FROM (SELECT *, max(valor) OVER (ORDER BY fecha) AS m FROM idx))) GROUP BY tramo) WHERE cm <= -0.10),
er AS (SELECT t.ticker_usd, e.pico, e.piso, ((SELECT valor FROM idx WHERE fecha = e.piso) / (SELECT valor FROM idx WHERE fecha = e.pico) - 1) * 100 AS sp,
              (arg_max(al.adj_close, al.i) FILTER (WHERE al.fecha <= e.piso) / arg_max(al.adj_close, al.i) FILTER (WHERE al.fecha <= e.pico) - 1) * 100 AS r
       FROM (SELECT ticker_usd, min(fecha) AS f0 FROM al GROUP BY 1) t JOIN ep e ON t.f0 <= e.pico JOIN al ON al.ticker_usd = t.ticker_usd GROUP BY 1, 2, 3)"""


@query(
    "refuge_episodes",
    "ticker_usd episodio_pico episodio_piso retorno_sp_pct:f4 retorno_pct:f4",
    f"WITH {ALIGNED_SQL} SELECT ticker_usd, pico AS episodio_pico, piso AS episodio_piso, sp AS retorno_sp_pct, r AS retorno_pct FROM er "
    f"WHERE ticker_usd IN (SELECT ticker_usd FROM ret GROUP BY 1 HAVING count(*) >= {MIN_REFUGE_DAYS})",
)
def refuge_episodes(spark, sf):
    return RF.kept_episodes(A.bars(spark, sf), A.macro(spark, sf), A.dim(spark, sf), min_days=MIN_REFUGE_DAYS, rounded_output=False)


@query(
    "refuge_segments",
    "ticker_usd refugio_dias:i refugio_beta:f4 refugio_beta_bajista:f4 refugio_captura_bajista:f4 refugio_corr_sp:f4 refugio_episodios:i refugio_ep_mediana_pct:f4 refugio_ep_peor_pct:f4 "
    "refugio_max_dd_pct:f4 refugio_segmento",
    f"""
WITH {ALIGNED_SQL},
st AS (SELECT ticker_usd, count(*) AS n, covar_samp(a, m) / nullif(var_samp(m), 0) AS b, covar_samp(a, m) FILTER (WHERE m < 0) / nullif(var_samp(m) FILTER (WHERE m < 0), 0) AS bb,
              avg(a) FILTER (WHERE m < 0) / avg(m) FILTER (WHERE m < 0) AS cap, corr(a, m) AS c FROM ret GROUP BY 1 HAVING count(*) >= {MIN_REFUGE_DAYS}),
eo AS (SELECT ticker_usd, count(*) AS ne, median(r) AS med, min(r) AS peor FROM er GROUP BY 1),
dd AS (SELECT ticker_usd, min(adj_close / m - 1) * 100 AS dd FROM (SELECT *, max(adj_close) OVER (PARTITION BY ticker_usd ORDER BY i) AS m FROM al) GROUP BY 1)
SELECT st.ticker_usd, n AS refugio_dias, b AS refugio_beta, bb AS refugio_beta_bajista, cap AS refugio_captura_bajista, c AS refugio_corr_sp, coalesce(ne, 0) AS refugio_episodios,
       med AS refugio_ep_mediana_pct, peor AS refugio_ep_peor_pct, dd AS refugio_max_dd_pct,
       CASE WHEN cap <= 0.3 AND peor >= -10 THEN 'Refugio' WHEN cap <= 0.6 THEN 'Defensiva' ELSE 'No es refugio' END AS refugio_segmento
FROM st LEFT JOIN eo ON eo.ticker_usd = st.ticker_usd JOIN dd ON dd.ticker_usd = st.ticker_usd""",
)
def refuge_segments(spark, sf):
    return RF.refuge(A.bars(spark, sf), A.macro(spark, sf), A.dim(spark, sf), min_days=MIN_REFUGE_DAYS, rounded_output=False)


@query(
    "swing_thresholds",
    "ticker_usd fecha umbral_pct:f6",
    """SELECT ticker_usd, fecha, umbral_pct FROM (
SELECT ticker_usd, fecha, least(greatest(5 * stddev_pop(lr) OVER (PARTITION BY ticker_usd) * 100, 8), 30) AS umbral_pct, count(*) OVER (PARTITION BY ticker_usd) AS n
FROM (SELECT *, ln(adj_close) - ln(lag(adj_close) OVER (PARTITION BY ticker_usd ORDER BY fecha)) AS lr FROM bars WHERE adj_close > 0)) WHERE n >= 250""",
)
def swing_thresholds(spark, sf):
    return SW.swing_thresholds(A.bars(spark, sf))


@query("zigzag_pivots", "ticker_usd nro_pivot:i fecha precio:f6 tipo fecha_confirmacion elliott_senal", "SELECT * FROM labelled_pivots")
def zigzag_pivots(spark, sf):
    return SW.with_elliott(SW.zigzag(A.bars(spark, sf)))


@query(
    "wave_state",
    "ticker_usd fecha onda_pivots_total:i onda_pierna_actual onda_fib_retroceso_pct:f4 onda_fib_nivel_cercano:f1 onda_fib_618:f4 onda_elliott_candidato",
    """
SELECT ticker_usd, fecha, total AS onda_pivots_total, CASE tipo WHEN 'H' THEN 'Baja' ELSE 'Suba' END AS onda_pierna_actual, back AS onda_fib_retroceso_pct,
       CASE WHEN abs(nivel - back) <= 3 THEN nivel END AS onda_fib_nivel_cercano, last - 0.618e0 * (last - prev) AS onda_fib_618, senal AS onda_elliott_candidato
FROM (SELECT s.*, arg_min(l, ROW(abs(l - back), l)) AS nivel FROM swing_state s, (VALUES (23.6e0), (38.2e0), (50e0), (61.8e0), (78.6e0), (100e0)) v(l) GROUP BY ALL)""",
)
def wave_state(spark, sf):
    b = A.bars(spark, sf)
    return SW.wave_state(SW.zigzag(b), b, rounded_output=False)


OUTCOMES_SQL = """
SELECT g.tipo, coalesce(elliott_senal, '(sin patrón)') AS senal, CASE WHEN adj_close > pp THEN 'venía subiendo' ELSE 'venía bajando' END AS momentum_6m, pf / adj_close - 1 AS r
FROM labelled_pivots g JOIN (SELECT ticker_usd, fecha, adj_close, lead(adj_close, 63) OVER w AS pf, lag(adj_close, 126) OVER w AS pp FROM bars WHERE adj_close > 0
                             WINDOW w AS (PARTITION BY ticker_usd ORDER BY fecha)) x ON x.ticker_usd = g.ticker_usd AND x.fecha = g.fecha_confirmacion WHERE pf IS NOT NULL AND pp IS NOT NULL"""
BACKTEST_STATS = "count(*) AS n, median(r) * 100 AS mediana_pct, avg(r) * 100 AS media_pct, avg(CASE WHEN r > 0 THEN 1e0 ELSE 0 END) * 100 AS pct_positivo"


def _closes(spark, sf):
    """Adjusted closes, rolled up once for all that reads them."""
    return stored(A.bars(spark, sf).select("ticker_usd", "fecha", "adj_close"), "closes")


@query("pivot_backtest", "tipo senal n:i mediana_pct:f4 media_pct:f4 pct_positivo:f4", f"SELECT tipo, senal, {BACKTEST_STATS} FROM ({OUTCOMES_SQL}) GROUP BY 1, 2")
def pivot_backtest(spark, sf):
    b = _closes(spark, sf)
    return SW.pivot_backtest(SW.pivot_outcomes(SW.zigzag(b), b))


@query(
    "pivot_backtest_momentum", "tipo momentum_6m senal n:i mediana_pct:f4 media_pct:f4 pct_positivo:f4",
    f"SELECT tipo, momentum_6m, senal, {BACKTEST_STATS} FROM ({OUTCOMES_SQL}) GROUP BY 1, 2, 3",
)
def pivot_backtest_momentum(spark, sf):
    b = _closes(spark, sf)
    return SW.pivot_backtest(SW.pivot_outcomes(SW.zigzag(b), b), by_momentum=True)


@query(
    "trend_crosstab",
    "tech_tendencia tech_macd_cruce n:i",
    f"SELECT tech_tendencia, tech_macd_cruce, count(*) AS n FROM ({TECH_SQL}) GROUP BY 1, 2",
)
def trend_crosstab(spark, sf):
    return R.crosstab(T.technical(A.bars(spark, sf)), "tech_tendencia", "tech_macd_cruce")


@query(
    "compression",
    "ticker_usd compresion:f6",
    f"SELECT * FROM (SELECT ticker_usd, tech_bb_ancho_pct / nullif(tech_atr14_pct, 0) AS compresion FROM ({TECH_SQL})) WHERE compresion IS NOT NULL",
)
def compression(spark, sf):
    return R.compression(T.technical(A.bars(spark, sf), rounded_output=False))


VEHICLES_SQL = """
SELECT *, CASE WHEN mercado = 'brasil' THEN 'BDR' ELSE 'ADR directo' END AS vehiculo, CASE ticker_usd WHEN 'S3' THEN 'S4' WHEN 'S4' THEN 'S3' END AS duplica_de
FROM dim WHERE (mercado = 'brasil' AND ticker_usd <> 'S5') OR (mercado = 'usa_otros' AND pais_origen ILIKE '%nation_1%')"""


def _vehicles(spark, sf):
    return R.country_vehicles(A.dim(spark, sf), "brasil", "Nation_1", ("S5",), {"S3": "S4", "S4": "S3"})


@query("country_vehicles", "ticker_usd mercado vehiculo duplica_de", VEHICLES_SQL)
def country_vehicles(spark, sf):
    return _vehicles(spark, sf)


@query(
    "country_ranking",
    "ticker_usd vehiculo lynch_checklist_score:i lynch_categoria_auto comp_pe_vs_sector_pct:f4 retorno_limpio_pct:f4 corr_vs_usdbrl:f6 corr_vs_sp500:f6",
    f"""
SELECT l.ticker_usd, vehiculo, lynch_checklist_score, lynch_categoria_auto, comp_pe_vs_sector_pct, retorno_limpio_pct, corr_vs_usdbrl, corr_vs_sp500
FROM ({STYLE_SQL}) l JOIN ({VEHICLES_SQL}) v ON v.ticker_usd = l.ticker_usd JOIN ({COMPS_SQL}) c ON c.ticker_usd = l.ticker_usd
LEFT JOIN ({QUERIES['fx_clean_returns'].body}) x ON x.ticker_usd = l.ticker_usd JOIN ({QUERIES['factor_exposure'].body}) e ON e.ticker_usd = l.ticker_usd""",
)
def country_ranking(spark, sf):
    b, m = _rolled_up(spark, sf)
    clean, exposure = QUERIES["fx_clean_returns"].build(spark, sf, b), QUERIES["factor_exposure"].build(spark, sf, b)
    return R.country_ranking(_vehicles(spark, sf), styles_of(spark, sf, m, b), comps_of(spark, sf, m), clean, exposure)
