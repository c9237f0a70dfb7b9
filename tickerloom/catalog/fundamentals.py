"""Queries over company metrics, statements, news and insiders."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickerloom.catalog.base import query
from tickerloom.catalog.prices import QUALITY_BODY, RATES_SQL, quality_of
from tickerloom.functions import ordering as O
from tickerloom.functions import series as S
from tickerloom.operators import fundamentals as FU
from tickerloom.operators import macro as M
from tickerloom.operators import news as N
from tickerloom.operators import research as R
from tickerloom.operators import valuation as V
from tickerloom.schemas import METRIC_COLUMNS
from tickerloom.sources import adapters as A

# The synthetic sectors stand in for the cyclical ones of the default list.
CYCLICAL = ["NATION_3", "NATION_9", "NATION_14"]


def known_sql(*columns: str) -> str:
    picks = ", ".join(f"arg_max({c}, fecha) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in columns)
    return f"SELECT ticker_usd, max(fecha) AS fecha, {picks} FROM metrics GROUP BY ticker_usd"


LATEST_SQL = known_sql(*[c for c in METRIC_COLUMNS])
NUM = lambda names, kind: " ".join(f"{n}:{kind}" for n in names.split())


@query("annual_income", "ticker_usd fecha_balance ingresos:f2 costo_ingresos:f2 beneficio_bruto:f2 gastos_operativos:f2 ganancia_neta:f2 margen_neto_pct:f6", "SELECT * FROM income")
def annual_income(spark, sf):
    return A.income(spark, sf)


@query("annual_balance", "ticker_usd fecha_balance deuda_total:f2 efectivo:f2 flujo_caja_libre:f2", "SELECT * FROM balances")
def annual_balance(spark, sf):
    return A.balances(spark, sf)


@query("metrics_monthly", "ticker_usd fecha market_cap:f0 pe_trailing:f6 peg_ratio:f6 margen_neto_pct:f6 crecimiento_ingresos_anual_pct:f6", "SELECT * FROM metrics")
def metrics_monthly(spark, sf):
    return A.metrics(spark, sf)


@query(
    "metrics_known_at_latest",
    "ticker_usd fecha market_cap:f0 pe_trailing:f6 margen_neto_pct:f6 roe_pct:f6 institutional_holding_pct:f6 crecimiento_ingresos_anual_pct:f6 shares_outstanding:f0",
    LATEST_SQL,
)
def metrics_known_at_latest(spark, sf):
    return S.known_at_latest(A.metrics(spark, sf), METRIC_COLUMNS)


@query(
    "latest_row",
    "ticker_usd fecha pe_trailing:f6 crecimiento_ingresos_anual_pct:f6",
    "SELECT * FROM metrics QUALIFY row_number() OVER (PARTITION BY ticker_usd ORDER BY fecha DESC) = 1",
)
def latest_row(spark, sf):
    return S.latest_rows(A.metrics(spark, sf))


@query(
    "first_row",
    "ticker_usd fecha pe_trailing:f6 crecimiento_ingresos_anual_pct:f6",
    "SELECT * FROM metrics QUALIFY row_number() OVER (PARTITION BY ticker_usd ORDER BY fecha) = 1",
)
def first_row(spark, sf):
    return S.first_rows(A.metrics(spark, sf))


# Six yes-or-no questions in rows, counted; bands and categories from ordered lists.
STYLE_SQL = f"""
WITH started AS (SELECT DISTINCT ON (ticker_usd) ticker_usd, fecha AS first_day, shares_outstanding AS first_shares FROM metrics ORDER BY ticker_usd, fecha),
doubted AS (SELECT ticker_usd FROM ({QUALITY_BODY.format(behind=7)}) WHERE regla = 'tenencia_institucional_no_confiable'),
company AS (SELECT n.* REPLACE (if(ticker_usd IN (SELECT ticker_usd FROM doubted), NULL, institutional_holding_pct) AS institutional_holding_pct), first_day, first_shares,
                   nombre_empresa, coalesce(sector_corregido, sector) AS sector, industria, pais_origen, mercado
            FROM dim JOIN ({LATEST_SQL}) n USING (ticker_usd) LEFT JOIN started USING (ticker_usd)),
asked AS (SELECT ticker_usd, unnest(range(1, 7)) AS q, unnest([institutional_holding_pct < 30, deuda_patrimonio < 50, price_to_book > 0 AND price_to_book < 1, market_cap < 1e10, peg_ratio < 1,
                 if(fecha >= first_day + 30, first_shares > shares_outstanding, NULL)]) AS yes FROM company),
answers AS (SELECT ticker_usd, count_if(yes) AS lynch_checklist_score, {", ".join(f"coalesce(bool_or(yes) FILTER (WHERE q = {k}), false) AS c{k}" for k in range(1, 6))},
                   bool_or(yes) FILTER (WHERE q = 6) AS c6 FROM asked GROUP BY 1),
bands (floor_, ceiling_, label) AS (VALUES (-1e300, 0.5e0, 'Muy barata'), (0.5e0, 1e0, 'Barata'), (1e0, 1.5e0, 'Razonable'), (1.5e0, 2e0, 'Cara'), (2e0, 1e300, 'Muy cara'))
SELECT company.*, answers.* EXCLUDE (ticker_usd), coalesce(label, 'Sin dato') AS lynch_valuacion_peg,
       coalesce(if(margen_neto_pct < 0 OR crecimiento_ganancia_anual_pct < -20, 'Recuperable', NULL), if(sector IN ('NATION_3', 'NATION_9', 'NATION_14') OR beta >= 1.4, 'Ciclica', NULL),
                if(crecimiento_ingresos_anual_pct >= 18, 'Alto Crecimiento', NULL), if(crecimiento_ingresos_anual_pct >= 5, 'Estable', NULL),
                if(crecimiento_ingresos_anual_pct < 5, 'Bajo Crecimiento', NULL), 'Sin clasificar (falta crecimiento de ingresos)') AS lynch_categoria_auto
FROM company JOIN answers USING (ticker_usd) LEFT JOIN bands ON peg_ratio >= floor_ AND peg_ratio < ceiling_"""


STYLE_COLUMNS = "ticker_usd nombre_empresa sector industria pais_origen mercado fecha lynch_categoria_auto lynch_valuacion_peg lynch_checklist_score:i"


def styles_of(spark, sf, metrics=None, bars=None):
    """``metrics``, ``bars``: the tables, if the caller has them already."""
    return FU.style_categories(A.metrics(spark, sf) if metrics is None else metrics, A.dim(spark, sf), quality_of(spark, sf, bars, metrics), CYCLICAL)


@query("style_category", STYLE_COLUMNS + " c1:b c2:b c3:b c4:b c5:b c6:b", STYLE_SQL)
def style_category(spark, sf):
    names = ["baja_cobertura_institucional", "deuda_baja", "activo_oculto", "empresa_pequena", "peg_atractivo", "recompra_acciones"]
    out = styles_of(spark, sf)
    for i, n in enumerate(names, 1):
        out = out.withColumn(f"c{i}", F.col(f"lynch_chk_{n}"))
    return out


@query("category_counts", "lynch_categoria_auto n:i", f"SELECT lynch_categoria_auto, count(*) AS n FROM ({STYLE_SQL}) GROUP BY 1")
def category_counts(spark, sf):
    return styles_of(spark, sf).groupBy("lynch_categoria_auto").agg(F.count("*").alias("n"))


# A median is the mean of the one or two values in the middle of the sorted ones.
COMPS_SQL = f"""
WITH peers AS (SELECT n.*, nombre_empresa, coalesce(sector_corregido, sector) AS sector, industria, mercado FROM dim JOIN ({LATEST_SQL}) n USING (ticker_usd) WHERE coalesce(sector_corregido, sector) IS NOT NULL),
sorted AS (SELECT sector, name, value, row_number() OVER (PARTITION BY sector, name ORDER BY value) AS place, count(*) OVER (PARTITION BY sector, name) AS n
           FROM (UNPIVOT (SELECT sector, if(pe_trailing > 0 AND pe_trailing < 200, pe_trailing, NULL) AS comp_pe_mediana_sector, if(peg_ratio > 0, peg_ratio, NULL) AS comp_peg_mediana_sector,
                                 margen_neto_pct AS comp_margen_neto_mediana_sector, crecimiento_ingresos_anual_pct AS comp_crecimiento_mediana_sector, roe_pct AS comp_roe_mediana_sector FROM peers)
                 ON COLUMNS('^comp_') INTO NAME name VALUE value)),
middle AS (SELECT sector, name, avg(value) AS value FROM sorted WHERE place BETWEEN n / 2e0 AND n / 2e0 + 1 GROUP BY 1, 2),
typical AS (PIVOT middle ON name IN ('comp_pe_mediana_sector', 'comp_peg_mediana_sector', 'comp_margen_neto_mediana_sector', 'comp_crecimiento_mediana_sector', 'comp_roe_mediana_sector') USING max(value) GROUP BY sector),
money (mercado, comp_moneda) AS (VALUES ('argentina_local', 'ARS'), ('brasil', 'BRL')),
placed AS (SELECT *, count(*) OVER (PARTITION BY sector) AS comp_pares_en_sector, rank() OVER (PARTITION BY sector ORDER BY crecimiento_ingresos_anual_pct NULLS LAST) - 1 AS ahead FROM peers)
SELECT placed.* EXCLUDE (ahead), typical.* EXCLUDE (sector), coalesce(comp_moneda, 'USD') AS comp_moneda, ahead * 100e0 / greatest(comp_pares_en_sector - 1, 1) AS comp_percentil_crecimiento_en_sector,
       pe_trailing * 100 / nullif(comp_pe_mediana_sector, 0) - 100 AS comp_pe_vs_sector_pct, margen_neto_pct - comp_margen_neto_mediana_sector AS comp_margen_vs_sector_pp,
       crecimiento_ingresos_anual_pct - comp_crecimiento_mediana_sector AS comp_crecimiento_vs_sector_pp
FROM placed LEFT JOIN typical USING (sector) LEFT JOIN money USING (mercado)"""


def comps_of(spark, sf, metrics=None):
    return FU.comparables(A.metrics(spark, sf) if metrics is None else metrics, A.dim(spark, sf), rounded_output=False)


@query(
    "comparables",
    "ticker_usd nombre_empresa sector industria mercado comp_moneda fecha market_cap:f0 pe_trailing:f6 comp_pe_mediana_sector:f6 comp_pe_vs_sector_pct:f4 "
    "peg_ratio:f6 comp_peg_mediana_sector:f6 comp_margen_neto_mediana_sector:f6 comp_margen_vs_sector_pp:f4 comp_crecimiento_mediana_sector:f6 "
    "comp_crecimiento_vs_sector_pp:f4 comp_roe_mediana_sector:f6 comp_pares_en_sector:i comp_percentil_crecimiento_en_sector:f4",
    COMPS_SQL,
)
def comparables(spark, sf):
    return comps_of(spark, sf)


@query(
    "similar_peers",
    "ticker_usd orden:i par_ticker par_market_cap:f0 distancia:f0",
    f"""
WITH c AS (SELECT *, row_number() OVER (PARTITION BY sector, comp_moneda ORDER BY market_cap NULLS LAST, md5(ticker_usd)) AS pos FROM ({COMPS_SQL}))
SELECT a.ticker_usd, b.ticker_usd AS par_ticker, b.market_cap AS par_market_cap, abs(b.market_cap - a.market_cap) AS distancia,
       row_number() OVER (PARTITION BY a.ticker_usd ORDER BY abs(b.market_cap - a.market_cap) NULLS LAST, abs(b.pos - a.pos), b.pos - a.pos) AS orden
FROM c a JOIN c b ON a.sector = b.sector AND a.comp_moneda = b.comp_moneda AND a.ticker_usd <> b.ticker_usd QUALIFY orden <= 5""",
)
def similar_peers(spark, sf):
    return FU.similar_peers(comps_of(spark, sf))


# Tests in rows: an unknown one is not counted, and the share passed decides.
HEALTH_SQL = f"""
WITH statement AS (SELECT DISTINCT ON (ticker_usd) ticker_usd, deuda_total, flujo_caja_libre FROM balances ORDER BY ticker_usd, fecha_balance DESC),
company AS (SELECT m.*, nombre_empresa, sector, deuda_total, flujo_caja_libre, deuda_total / nullif(flujo_caja_libre, 0) AS years
            FROM dim JOIN ({known_sql('razon_corriente', 'deuda_patrimonio', 'roe_pct', 'margen_neto_pct')}) m USING (ticker_usd) LEFT JOIN statement USING (ticker_usd)),
tests AS (SELECT ticker_usd, unnest([razon_corriente >= 1.2, deuda_patrimonio <= 100, roe_pct >= 10, margen_neto_pct > 0,
                 if(flujo_caja_libre IS NULL, NULL, if(deuda_total <= 0, true, years <= 5))]) AS passed FROM company),
tally AS (SELECT ticker_usd, count_if(passed) AS salud_score, count(passed) AS salud_evaluables FROM tests GROUP BY 1)
SELECT *, if(flujo_caja_libre > 0, years, NULL) AS anios_pagar_deuda,
       if(salud_evaluables = 0, 'Sin datos suficientes', if(5 * salud_score >= 4 * salud_evaluables, 'Sólida', if(2 * salud_score >= salud_evaluables, 'Aceptable', 'Riesgo'))) AS salud_clasificacion
FROM company JOIN tally USING (ticker_usd)"""


def health_of(spark, sf, metrics=None, months=None):
    return FU.financial_health(A.metrics(spark, sf) if metrics is None else metrics, A.balances(spark, sf, months), A.dim(spark, sf), rounded_output=False)


@query(
    "health_score",
    "ticker_usd nombre_empresa sector fecha deuda_total:f2 flujo_caja_libre:f2 anios_pagar_deuda:f4 salud_score:i salud_evaluables:i salud_clasificacion",
    HEALTH_SQL,
)
def health_score(spark, sf):
    return health_of(spark, sf)


@query(
    "statement_momentum",
    "ticker_usd crecimiento_ingresos_anual_pct:f4 crecimiento_ganancia_anual_pct:f4 aceleracion_ingresos_pct:f4 eps_growth_3y_pct:f4 eps_growth_5y_pct:f4 "
    "sorpresa_eps_prom_4q_pct:f4 trimestres_superando_estimado:i",
    """
WITH g AS (SELECT ticker_usd, fecha_balance, ingresos, ganancia_neta,
                  (ingresos - lag(ingresos) OVER w) / nullif(abs(lag(ingresos) OVER w), 0) * 100 AS gi,
                  (ganancia_neta - lag(ganancia_neta) OVER w) / nullif(abs(lag(ganancia_neta) OVER w), 0) * 100 AS gg
           FROM income WINDOW w AS (PARTITION BY ticker_usd ORDER BY fecha_balance)),
gi AS (SELECT *, row_number() OVER (PARTITION BY ticker_usd ORDER BY fecha_balance DESC) AS n FROM g WHERE gi IS NOT NULL),
gg AS (SELECT *, row_number() OVER (PARTITION BY ticker_usd ORDER BY fecha_balance DESC) AS n FROM g WHERE gg IS NOT NULL),
e AS (SELECT ticker_usd, ganancia_neta / 1000 AS v, row_number() OVER (PARTITION BY ticker_usd ORDER BY fecha_balance DESC) AS n FROM income),
e2 AS (SELECT ticker_usd, max(v) FILTER (WHERE n = 1) AS e1, max(v) FILTER (WHERE n = 4) AS e4, max(v) FILTER (WHERE n = 6) AS e6 FROM e GROUP BY 1),
r AS (SELECT *, row_number() OVER (PARTITION BY ticker_usd ORDER BY fecha_reporte DESC) AS n
      FROM eps WHERE eps_reportado IS NOT NULL),
r2 AS (SELECT ticker_usd, avg(sorpresa_pct) AS s, count(*) FILTER (WHERE sorpresa_pct > 0) AS t FROM r WHERE n <= 4 AND sorpresa_pct IS NOT NULL GROUP BY 1)
SELECT t.ticker_usd, a.gi AS crecimiento_ingresos_anual_pct, p.gg AS crecimiento_ganancia_anual_pct, a.gi - b.gi AS aceleracion_ingresos_pct,
       CASE WHEN e1 > 0 AND e4 > 0 THEN (pow(e1 / e4, 1e0 / 3) - 1) * 100 END AS eps_growth_3y_pct,
       CASE WHEN e1 > 0 AND e6 > 0 THEN (pow(e1 / e6, 1e0 / 5) - 1) * 100 END AS eps_growth_5y_pct,
       r2.s AS sorpresa_eps_prom_4q_pct, r2.t AS trimestres_superando_estimado
FROM (SELECT DISTINCT ticker_usd FROM income) t LEFT JOIN (SELECT * FROM gi WHERE n = 1) a ON a.ticker_usd = t.ticker_usd
LEFT JOIN (SELECT * FROM gi WHERE n = 2) b ON b.ticker_usd = t.ticker_usd LEFT JOIN (SELECT * FROM gg WHERE n = 1) p ON p.ticker_usd = t.ticker_usd
LEFT JOIN e2 ON e2.ticker_usd = t.ticker_usd LEFT JOIN r2 ON r2.ticker_usd = t.ticker_usd""",
)
def statement_momentum(spark, sf):
    return FU.statement_momentum(A.income(spark, sf), A.eps_annual(spark, sf), A.eps_reports(spark, sf), rounded_output=False)


@query(
    "annual_performance",
    "ticker_usd anio:i ingresos_mm:f6 ganancia_neta_mm:f6 margen_neto_pct:f6",
    "SELECT ticker_usd, year(fecha_balance) AS anio, ingresos / 1e9 AS ingresos_mm, ganancia_neta / 1e9 AS ganancia_neta_mm, margen_neto_pct FROM income",
)
def annual_performance(spark, sf):
    return FU.annual_performance(A.income(spark, sf))


@query(
    "income_waterfall",
    "ticker_usd fecha_balance paso:i concepto delta:f2 acumulado:f2",
    """
WITH u AS (SELECT * FROM income QUALIFY row_number() OVER (PARTITION BY ticker_usd ORDER BY fecha_balance DESC) = 1)
SELECT ticker_usd, fecha_balance, 1 AS paso, 'Ingresos' AS concepto, ingresos AS delta, ingresos AS acumulado FROM u
UNION ALL SELECT ticker_usd, fecha_balance, 2, 'COGS', -costo_ingresos, ingresos - costo_ingresos FROM u
UNION ALL SELECT ticker_usd, fecha_balance, 3, 'Bruto', 0, beneficio_bruto FROM u
UNION ALL SELECT ticker_usd, fecha_balance, 4, 'Gastos op.', -gastos_operativos, beneficio_bruto - gastos_operativos FROM u
UNION ALL SELECT ticker_usd, fecha_balance, 5, 'Neto', 0, ganancia_neta FROM u""",
)
def income_waterfall(spark, sf):
    return FU.income_waterfall(A.income(spark, sf))


@query(
    "debt_and_cash",
    "ticker_usd anio:i deuda_total:f2 efectivo:f2 flujo_caja_libre:f2",
    "SELECT *, year(fecha_balance) AS anio FROM balances",
)
def debt_and_cash(spark, sf):
    return FU.debt_and_cash(A.balances(spark, sf))


@query(
    "eps_history",
    "ticker_usd fecha_reporte eps_estimado:f6 eps_reportado:f6 sorpresa_pct:f4 es_proximo:b",
    """SELECT *, eps_reportado IS NULL AND fecha_reporte = min(fecha_reporte) FILTER (WHERE eps_reportado IS NULL) OVER (PARTITION BY ticker_usd) AS es_proximo FROM eps""",
)
def eps_history(spark, sf):
    return FU.eps_history(A.eps_reports(spark, sf))


UPSIDE_SQL = """
SELECT c.ticker_usd, d.nombre_empresa, d.sector, p.precio_actual, precio_objetivo_mediana, (precio_objetivo_mediana / nullif(precio_actual, 0) - 1) * 100 AS upside_pct
FROM (SELECT * FROM consensus QUALIFY row_number() OVER (PARTITION BY ticker_usd ORDER BY fecha DESC) = 1) c JOIN dim d ON d.ticker_usd = c.ticker_usd
LEFT JOIN (SELECT ticker_usd, arg_max(adj_close, fecha) AS precio_actual FROM bars GROUP BY 1) p ON p.ticker_usd = c.ticker_usd"""


def upside_of(spark, sf, bars=None):
    return FU.consensus_upside(A.consensus(spark, sf), A.bars(spark, sf) if bars is None else bars, A.dim(spark, sf), rounded_output=False)


@query("consensus_upside", "ticker_usd nombre_empresa sector precio_actual:f6 precio_objetivo_mediana:f6 upside_pct:f4", UPSIDE_SQL)
def consensus_upside(spark, sf):
    return upside_of(spark, sf)


SENT_SQL = """
SELECT *, CASE WHEN sent_score_promedio >= 0.15 THEN 'Positivo' WHEN sent_score_promedio <= -0.15 THEN 'Negativo' ELSE 'Neutral/Mixto' END AS sent_clasificacion
FROM (SELECT ticker_usd, count(*) AS sent_titulares_total, count(*) FILTER (WHERE sentimiento = 'positive') AS sent_positivas,
             count(*) FILTER (WHERE sentimiento = 'negative') AS sent_negativas, count(*) FILTER (WHERE sentimiento = 'neutral') AS sent_neutrales,
             avg(CASE sentimiento WHEN 'positive' THEN score_sentimiento WHEN 'negative' THEN -score_sentimiento ELSE 0 END) AS sent_score_promedio
      FROM news WHERE fecha_publicacion >= (SELECT max(fecha_publicacion) FROM news) - 7 GROUP BY 1)"""


def sentiment_of(spark, sf):
    return N.news_sentiment(A.news(spark, sf), A.last_news_day(spark, sf), rounded_output=False)


@query(
    "sentiment_7d",
    "ticker_usd sent_titulares_total:i sent_positivas:i sent_negativas:i sent_neutrales:i sent_score_promedio:f6 sent_clasificacion",
    SENT_SQL,
)
def sentiment_7d(spark, sf):
    return sentiment_of(spark, sf)


# One row per company and kind of trade; purchases and sales stand beside everybody on record.
INSIDER_SQL = """
WITH recent AS (SELECT * FROM insider_trades WHERE (SELECT max(fecha) FROM insider_trades) - fecha <= {days}),
kinds AS (SELECT ticker_usd, tipo, count(*) AS n, sum(valor) AS amount, count(DISTINCT insider) AS people, max(fecha) AS latest,
                 count_if(regexp_matches(lower(cargo), 'chief (executive|financial)|\\b(ceo|cfo)\\b')) > 0 AS top FROM recent GROUP BY ALL),
buys AS (FROM kinds WHERE tipo = 'Compra'), sales AS (FROM kinds WHERE tipo = 'Venta'), everyone AS (SELECT DISTINCT ticker_usd FROM insider_trades)
SELECT e.ticker_usd, coalesce(b.n, 0) AS ins_compras_90d, coalesce(b.amount, 0) AS ins_compras_monto_90d, coalesce(b.people, 0) AS ins_compradores_90d, coalesce(b.top, false) AS ins_compro_ceo_cfo,
       b.latest AS ins_ultima_compra, coalesce(s.n, 0) AS ins_ventas_90d, coalesce(s.amount, 0) AS ins_ventas_monto_90d,
       if(coalesce(b.top, false) OR coalesce(b.amount, 0) >= 100000, 'Compra relevante', 'Sin compras relevantes') AS ins_senal
FROM everyone e LEFT JOIN buys b USING (ticker_usd) LEFT JOIN sales s USING (ticker_usd)"""


@query(
    "insider_90d",
    "ticker_usd ins_compras_90d:i ins_compras_monto_90d:f2 ins_compradores_90d:i ins_compro_ceo_cfo:b ins_ultima_compra ins_ventas_90d:i ins_ventas_monto_90d:f2 ins_senal",
    INSIDER_SQL.replace("{days}", "90"),
)
def insider_90d(spark, sf):
    return N.insider_signal(A.insiders(spark, sf), A.last_event_day(spark, sf))


@query(
    "insider_5d",
    "ticker_usd ins_compras_90d:i ins_compras_monto_90d:f2 ins_compradores_90d:i ins_compro_ceo_cfo:b ins_ultima_compra ins_ventas_90d:i ins_ventas_monto_90d:f2 ins_senal",
    INSIDER_SQL.replace("{days}", "5"),
)
def insider_5d(spark, sf):
    return N.insider_signal(A.insiders(spark, sf), A.last_event_day(spark, sf), days=5)


@query(
    "recent_headlines",
    "ticker_usd orden:i fecha_publicacion sentimiento",
    """
SELECT * FROM news WHERE titular IS NOT NULL AND titular <> '' AND fecha_publicacion >= (SELECT max(fecha_publicacion) FROM news) - 7""",
)
def recent_headlines(spark, sf):
    return N.recent_headlines(A.news(spark, sf), A.last_news_day(spark, sf))


@query(
    "new_headlines",
    "ticker_usd orden:i titular",
    """
SELECT * FROM news n WHERE fecha_publicacion >= DATE '2024-01-20'
  AND NOT EXISTS (SELECT 1 FROM news o WHERE o.fecha_publicacion < DATE '2024-01-20' AND o.ticker_usd = n.ticker_usd AND o.titular = n.titular)""",
)
def new_headlines(spark, sf):
    n = A.news(spark, sf)
    cut = F.col("fecha_publicacion") < F.lit("2024-01-20").cast("date")
    return N.new_headlines(n.filter(~cut), n.filter(cut))


# words that do occur in the documents, so that every label does
TONE_WORDS = (("the", "de", "und"), ("of", "la", "der"))


def _hits(words):
    return f"len(list_filter(regexp_split_to_array(lower(titular), '[^a-z0-9_]+'), lambda x: x IN {words}))"


@query(
    "headline_scores",
    "ticker_usd orden:i sentimiento score_sentimiento:f4",
    f"""
SELECT ticker_usd, orden, CASE WHEN g > b THEN 'positive' WHEN b > g THEN 'negative' ELSE 'neutral' END AS sentimiento, round((1 + abs(g - b)) / CAST(2 + g + b AS DOUBLE), 3) AS score_sentimiento
FROM (SELECT n.ticker_usd, n.orden, {_hits(TONE_WORDS[0])} AS g, {_hits(TONE_WORDS[1])} AS b FROM news n WHERE fecha_publicacion >= DATE '2024-01-20'
  AND NOT EXISTS (SELECT 1 FROM news o WHERE o.fecha_publicacion < DATE '2024-01-20' AND o.ticker_usd = n.ticker_usd AND o.titular = n.titular))""",
)
def headline_scores(spark, sf):
    n = A.news(spark, sf)
    cut = F.col("fecha_publicacion") < F.lit("2024-01-20").cast("date")
    return N.score_headlines(n.filter(~cut).drop("sentimiento", "score_sentimiento"), n.filter(cut), good=TONE_WORDS[0], bad=TONE_WORDS[1])


@query(
    "valuation_index",
    "ticker_usd fin_mes val:f6",
    """
SELECT ticker_usd, fin_mes, CASE WHEN g > 0 THEN close / g END AS val
FROM (SELECT m.ticker_usd, m.fin_mes, m.close, arg_max(i.ganancia_neta, i.fecha_balance) AS g
      FROM (SELECT ticker_usd, last_day(fecha) AS fin_mes, arg_max(close, fecha) AS close FROM bars WHERE close > 0 GROUP BY 1, 2) m
      LEFT JOIN income i ON i.ticker_usd = m.ticker_usd AND i.fecha_balance + 75 <= m.fin_mes GROUP BY 1, 2, 3)""",
)
def valuation_index(spark, sf):
    return V.valuation_index(S.month_end_closes(A.bars(spark, sf)), A.income(spark, sf)).withColumn("val", F.col("val"))


READING_SQL = f"""
WITH cfg AS (SELECT d.ticker_usd, CASE WHEN moneda_balance IS DISTINCT FROM moneda_cotizacion AND moneda_cotizacion = 'USD' THEN 'USD' || moneda_balance END AS fx,
                    CASE WHEN d.ticker_usd NOT IN (SELECT ticker_usd FROM bars WHERE close > 0) THEN 'Sin precios'
                         WHEN moneda_balance IS NULL OR moneda_cotizacion IS NULL THEN 'Sin moneda'
                         WHEN moneda_balance <> moneda_cotizacion AND moneda_cotizacion <> 'USD' THEN 'No calculable: precio en ' || moneda_cotizacion || ' y balance en ' || moneda_balance || ': sin conversion'
                         WHEN moneda_balance <> moneda_cotizacion AND ('USD' || moneda_balance) NOT IN (SELECT serie FROM macro WHERE serie IS NOT NULL) THEN 'No calculable: sin serie USD' || moneda_balance END AS motivo
             FROM dim d WHERE mercado NOT IN ('cripto', 'etf')),
m AS (SELECT ticker_usd, last_day(fecha) AS fin_mes, arg_max(close, fecha) AS close FROM bars WHERE close > 0 GROUP BY 1, 2),
g AS (SELECT m.ticker_usd, m.fin_mes, m.close, c.fx, arg_max(i.ganancia_neta, i.fecha_balance) AS g
      FROM m JOIN cfg c ON c.ticker_usd = m.ticker_usd AND c.motivo IS NULL LEFT JOIN income i ON i.ticker_usd = m.ticker_usd AND i.fecha_balance + 75 <= m.fin_mes
      GROUP BY 1, 2, 3, 4),
x AS (SELECT g.*, CASE WHEN g.fx IS NULL THEN g.g ELSE g.g / (SELECT arg_max(valor, fecha) FROM macro WHERE serie = g.fx AND fecha <= g.fin_mes) END AS gc FROM g),
v AS (SELECT ticker_usd, fin_mes, close / gc AS val FROM x WHERE gc > 0),
h AS (SELECT ticker_usd, count(*) AS n, arg_max(val, fin_mes) AS hoy, median(val) AS med, min(val) AS mn, max(val) AS mx FROM v GROUP BY 1),
p AS (SELECT v.ticker_usd, avg(CASE WHEN val <= hoy THEN 1e0 ELSE 0 END) * 100 AS pc FROM v JOIN h ON h.ticker_usd = v.ticker_usd GROUP BY 1),
pe AS ({known_sql('pe_trailing')})
"""


@query(
    "valuation_reading",
    "ticker_usd val_meses:i val_percentil_hoy:f4 val_pe_hoy:f4 val_pe_mediana_hist:f4 val_pe_min_hist:f4 val_pe_max_hist:f4 val_lectura",
    READING_SQL
    + """
SELECT cfg.ticker_usd, CASE WHEN motivo IS NULL THEN coalesce(n, 0) END AS val_meses, CASE WHEN n >= 12 THEN pc END AS val_percentil_hoy,
       CASE WHEN n >= 12 THEN pe_trailing END AS val_pe_hoy, CASE WHEN n >= 12 AND pe_trailing > 0 THEN med * (pe_trailing / hoy) END AS val_pe_mediana_hist,
       CASE WHEN n >= 12 AND pe_trailing > 0 THEN mn * (pe_trailing / hoy) END AS val_pe_min_hist,
       CASE WHEN n >= 12 AND pe_trailing > 0 THEN mx * (pe_trailing / hoy) END AS val_pe_max_hist,
       coalesce(motivo, CASE WHEN n < 12 THEN 'Sin historia suficiente' WHEN pc <= 20 THEN 'Barata vs su historia' WHEN pc >= 80 THEN 'Cara vs su historia'
                             WHEN n >= 12 THEN 'En su rango normal' END, 'Sin historia suficiente') AS val_lectura
FROM cfg LEFT JOIN h ON h.ticker_usd = cfg.ticker_usd LEFT JOIN p ON p.ticker_usd = cfg.ticker_usd LEFT JOIN pe ON pe.ticker_usd = cfg.ticker_usd""",
)
def valuation_reading(spark, sf):
    return _valuation(spark, sf)[1]


@query(
    "valuation_history",
    "ticker_usd fecha val_pe_aprox:f4",
    READING_SQL
    + "SELECT v.ticker_usd, v.fin_mes AS fecha, val * (pe_trailing / hoy) AS val_pe_aprox FROM v JOIN h ON h.ticker_usd = v.ticker_usd "
    "JOIN pe ON pe.ticker_usd = v.ticker_usd WHERE pe_trailing IS NOT NULL AND pe_trailing <> 0",
)
def valuation_history(spark, sf):
    return _valuation(spark, sf)[0]


def _valuation(spark, sf):
    pe = S.known_at_latest(A.metrics(spark, sf), ["pe_trailing"])
    return V.historical_valuation(A.dim(spark, sf), A.bars(spark, sf), A.income(spark, sf), A.macro(spark, sf), pe, ["USDBRL"], rounded_output=False)


@query(
    "mean_corr_by_style",
    "lynch_categoria_auto promedio:f6 empresas:i",
    f"""
SELECT lynch_categoria_auto, avg(macro_corr_ret_vs_ust10y) AS promedio, count(*) AS empresas
FROM (SELECT ticker_usd, lynch_categoria_auto FROM ({STYLE_SQL})) l JOIN ({RATES_SQL}) s ON s.ticker_usd = l.ticker_usd GROUP BY 1""",
)
def mean_corr_by_style(spark, sf):
    s = M.rate_sensitivity(A.bars(spark, sf), A.macro(spark, sf), rounded_output=False)
    return M.group_mean(s, styles_of(spark, sf), "macro_corr_ret_vs_ust10y", "lynch_categoria_auto")


@query(
    "null_shares",
    "columna nulos_pct:f6",
    " UNION ALL ".join(
        f"SELECT '{c}' AS columna, avg(CASE WHEN {c} IS NULL THEN 1e0 ELSE 0 END) * 100 AS nulos_pct FROM metrics"
        for c in ("pe_trailing", "margen_neto_pct", "roe_pct", "institutional_holding_pct", "crecimiento_ingresos_anual_pct", "eps_growth_5y_pct")
    ),
)
def null_shares(spark, sf):
    cols = ["pe_trailing", "margen_neto_pct", "roe_pct", "institutional_holding_pct", "crecimiento_ingresos_anual_pct", "eps_growth_5y_pct"]
    return R.null_shares(A.metrics(spark, sf), cols)


@query(
    "describe_ratios",
    "columna n:i media:f4 desvio:f4 minimo:f4 maximo:f4 p25:f4 p50:f4 p75:f4",
    " UNION ALL ".join(
        f"SELECT '{c}' AS columna, count({c}) AS n, avg({c}) AS media, stddev_samp({c}) AS desvio, min({c}) AS minimo, max({c}) AS maximo, "
        f"quantile_cont({c}, 0.25) AS p25, quantile_cont({c}, 0.5) AS p50, quantile_cont({c}, 0.75) AS p75 FROM metrics"
        for c in ("pe_trailing", "peg_ratio", "margen_neto_pct", "roe_pct")
    ),
)
def describe_ratios(spark, sf):
    return R.describe_columns(A.metrics(spark, sf), ["pe_trailing", "peg_ratio", "margen_neto_pct", "roe_pct"])


@query(
    "clip_quantiles",
    "ticker_usd fecha recortado:f6",
    """SELECT ticker_usd, fecha, least(greatest(pe_trailing, lo), hi) AS recortado
FROM metrics, (SELECT quantile_cont(pe_trailing, 0.01) AS lo, quantile_cont(pe_trailing, 0.99) AS hi FROM metrics) WHERE pe_trailing IS NOT NULL""",
)
def clip_quantiles(spark, sf):
    return R.clip_quantiles(A.metrics(spark, sf), "pe_trailing")


@query(
    "value_vs_growth",
    "ticker_usd pe_trailing:f6 crecimiento_ingresos_anual_pct:f6",
    f"""WITH u AS (SELECT * FROM ({LATEST_SQL}) WHERE pe_trailing > 0 AND pe_trailing < 80 AND crecimiento_ingresos_anual_pct IS NOT NULL)
SELECT * FROM u WHERE crecimiento_ingresos_anual_pct > (SELECT median(crecimiento_ingresos_anual_pct) FROM u) AND pe_trailing < (SELECT median(pe_trailing) FROM u)""",
)
def value_vs_growth(spark, sf):
    return R.value_vs_growth(S.known_at_latest(A.metrics(spark, sf), METRIC_COLUMNS))


@query(
    "growth_acceleration",
    "ticker_usd crecimiento_ingresos_anual_pct:f6 aceleracion_ingresos_pct:f6",
    f"SELECT * FROM ({LATEST_SQL}) WHERE crecimiento_ingresos_anual_pct BETWEEN -50 AND 100 AND aceleracion_ingresos_pct BETWEEN -100 AND 100",
)
def growth_acceleration(spark, sf):
    return R.growth_acceleration(S.known_at_latest(A.metrics(spark, sf), METRIC_COLUMNS))


@query(
    "growth_extremes",
    "ticker_usd crecimiento_ingresos_anual_pct:f6 extremo",
    f"""WITH u AS (SELECT * FROM ({LATEST_SQL}) WHERE crecimiento_ingresos_anual_pct IS NOT NULL)
SELECT * FROM (SELECT *, 'alto' AS extremo FROM u ORDER BY crecimiento_ingresos_anual_pct DESC, ticker_usd LIMIT 15)
UNION ALL SELECT * FROM (SELECT *, 'bajo' AS extremo FROM u ORDER BY crecimiento_ingresos_anual_pct, ticker_usd LIMIT 15)""",
)
def growth_extremes(spark, sf):
    return R.extremes(S.known_at_latest(A.metrics(spark, sf), METRIC_COLUMNS), "crecimiento_ingresos_anual_pct")


@query(
    "total_returns",
    "ticker_usd nombre_empresa sector retorno_total_pct:f4",
    """SELECT b.ticker_usd, nombre_empresa, sector, (arg_max(adj_close, fecha) / arg_min(adj_close, fecha) - 1) * 100 AS retorno_total_pct
FROM bars b JOIN dim d ON d.ticker_usd = b.ticker_usd GROUP BY 1, 2, 3""",
)
def total_returns(spark, sf):
    return R.total_returns(A.bars(spark, sf), A.dim(spark, sf))


@query("universe_profile", "sector mercado empresas:i", "SELECT sector, mercado, count(*) AS empresas FROM dim GROUP BY 1, 2")
def universe_profile(spark, sf):
    from tickerloom.operators.universe import universe_profile as profile

    return profile(A.dim(spark, sf))


@query(
    "rank_pct_ties",
    "ticker_usd fecha pct:f6",
    """SELECT ticker_usd, fecha, CASE WHEN pe_trailing IS NOT NULL THEN (rank() OVER (ORDER BY pe_trailing) + (count(*) OVER (PARTITION BY pe_trailing) - 1) / 2e0)
       / count(pe_trailing) OVER () END AS pct FROM metrics""",
)
def rank_pct_ties(spark, sf):
    return O.with_rank_pct(A.metrics(spark, sf), "pe_trailing", "pct")


@query(
    "sector_percentile",
    "ticker_usd sector pr:f6",
    f"""SELECT u.ticker_usd, sector, percent_rank() OVER (PARTITION BY sector ORDER BY roe_pct ASC NULLS LAST) AS pr
FROM ({known_sql('roe_pct')}) u JOIN dim d ON d.ticker_usd = u.ticker_usd""",
)
def sector_percentile(spark, sf):
    base = S.known_at_latest(A.metrics(spark, sf), ["roe_pct"]).join(A.dim(spark, sf).select("ticker_usd", "sector"), "ticker_usd")
    return O.with_percent_rank(base, "roe_pct", "pr", ["sector"])


@query(
    "sector_quantiles",
    "sector p10:f6 mediana:f6 p90:f6",
    """SELECT sector, quantile_cont(pe_trailing, 0.1) AS p10, quantile_cont(pe_trailing, 0.5) AS mediana, quantile_cont(pe_trailing, 0.9) AS p90
FROM metrics m JOIN dim d ON d.ticker_usd = m.ticker_usd WHERE pe_trailing IS NOT NULL GROUP BY 1""",
)
def sector_quantiles(spark, sf):
    base = A.metrics(spark, sf).join(A.dim(spark, sf).select("ticker_usd", "sector"), "ticker_usd")
    return O.exact_quantiles(base, ["sector"], "pe_trailing", {"p10": 0.1, "mediana": 0.5, "p90": 0.9})
