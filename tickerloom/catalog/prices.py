"""Queries over daily bars and macro series."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickerloom.catalog.base import query
from tickerloom.functions import series as S
from tickerloom.functions.expr import change_pct, ratio
from tickerloom.operators import macro as M
from tickerloom.operators import quality as Q
from tickerloom.operators import technical as T
from tickerloom.sources import adapters as A

TECH_SQL = """
SELECT * FROM (
WITH px AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY ticker_usd) AS n, lag(adj_close) OVER w AS adj_prev,
                   lag(close) OVER w AS close_prev,
                   avg(adj_close) OVER (w ROWS 49 PRECEDING) AS sma50, avg(adj_close) OVER (w ROWS 199 PRECEDING) AS sma200,
                   avg(adj_close) OVER (w ROWS 19 PRECEDING) AS sma20, stddev_pop(adj_close) OVER (w ROWS 19 PRECEDING) AS std20,
                   max(adj_close) OVER (w ROWS 251 PRECEDING) AS mx, min(adj_close) OVER (w ROWS 251 PRECEDING) AS mn,
                   lag(adj_close, 21) OVER w AS p1, lag(adj_close, 63) OVER w AS p3, lag(adj_close, 126) OVER w AS p6,
                   avg(volume) OVER (w ROWS 29 PRECEDING) AS v30,
                   avg(volume) OVER (w ROWS BETWEEN 119 PRECEDING AND 30 PRECEDING) AS vprev
            FROM bars WINDOW w AS (PARTITION BY ticker_usd ORDER BY fecha)),
moves AS (SELECT *, avg(greatest(adj_close - adj_prev, 0)) OVER (w ROWS 13 PRECEDING) AS gain,
                 avg(greatest(adj_prev - adj_close, 0)) OVER (w ROWS 13 PRECEDING) AS loss,
                 avg(greatest(high - low, abs(high - close_prev), abs(low - close_prev))) OVER (w ROWS 13 PRECEDING) AS atr14,
                 i - greatest(n - 400, 0) AS k
          FROM px WINDOW w AS (PARTITION BY ticker_usd ORDER BY fecha)),
m1 AS (SELECT *, CASE WHEN k >= 1 THEN adj_close END AS px, CASE WHEN k >= 1 THEN k END AS kk FROM moves),
m2 AS (SELECT *, sum(px * pow(13e0 / 11, kk)) OVER w / sum(pow(13e0 / 11, kk)) OVER w
                 - sum(px * pow(27e0 / 25, kk)) OVER w / sum(pow(27e0 / 25, kk)) OVER w AS macd
       FROM m1 WINDOW w AS (PARTITION BY ticker_usd ORDER BY fecha)),
m3 AS (SELECT *, sum(macd * pow(10e0 / 8, kk)) OVER w / sum(pow(10e0 / 8, kk)) OVER w AS sig
       FROM m2 WINDOW w AS (PARTITION BY ticker_usd ORDER BY fecha)),
last AS (SELECT *, CASE WHEN loss = 0 AND gain > 0 THEN 100 ELSE 100 - 100 / (1 + gain / nullif(loss, 0)) END AS rsi FROM m3 WHERE i = n)
SELECT ticker_usd, fecha, adj_close AS tech_precio, sma50 AS tech_sma50, sma200 AS tech_sma200,
       CASE WHEN n >= 200 THEN (adj_close / sma50 - 1) * 100 END AS tech_precio_vs_sma50_pct,
       CASE WHEN n >= 200 THEN (adj_close / sma200 - 1) * 100 END AS tech_precio_vs_sma200_pct,
       CASE WHEN n >= 200 THEN CASE WHEN sma50 > sma200 THEN 'Alcista' ELSE 'Bajista' END END AS tech_tendencia,
       CASE WHEN n >= 14 THEN rsi END AS tech_rsi14,
       CASE WHEN n < 14 THEN NULL WHEN rsi >= 70 THEN 'Sobrecomprado' WHEN rsi <= 30 THEN 'Sobrevendido' ELSE 'Neutral' END AS tech_rsi_senal,
       (adj_close / p1 - 1) * 100 AS tech_retorno_1m_pct, (adj_close / p3 - 1) * 100 AS tech_retorno_3m_pct,
       (adj_close / p6 - 1) * 100 AS tech_retorno_6m_pct, v30 AS tech_volumen_prom_30d,
       (v30 / nullif(vprev, 0) - 1) * 100 AS tech_volumen_tendencia_pct,
       CASE WHEN n >= 20 THEN (adj_close - (sma20 - 2 * std20)) / nullif(4 * std20, 0) * 100 END AS tech_bb_pct_b,
       CASE WHEN n >= 20 THEN 4 * std20 / nullif(sma20, 0) * 100 END AS tech_bb_ancho_pct,
       CASE WHEN k >= 35 THEN macd END AS tech_macd, CASE WHEN k >= 35 THEN (macd - sig) / adj_close * 100 END AS tech_macd_hist_pct,
       CASE WHEN k >= 35 THEN CASE WHEN macd > sig THEN 'Alcista' ELSE 'Bajista' END END AS tech_macd_cruce,
       CASE WHEN n >= 14 THEN atr14 / nullif(close, 0) * 100 END AS tech_atr14_pct,
       (adj_close / mx - 1) * 100 AS tech_dist_max_52s_pct, (adj_close / mn - 1) * 100 AS tech_dist_min_52s_pct
FROM last)
"""
TECH_COLUMNS = (
    "ticker_usd fecha tech_precio:f6 tech_sma50:f4 tech_sma200:f4 tech_precio_vs_sma50_pct:f4 tech_precio_vs_sma200_pct:f4 tech_tendencia "
    "tech_rsi14:f4 tech_rsi_senal tech_retorno_1m_pct:f4 tech_retorno_3m_pct:f4 tech_retorno_6m_pct:f4 tech_volumen_prom_30d:f4 "
    "tech_volumen_tendencia_pct:f4 tech_bb_pct_b:f4 tech_bb_ancho_pct:f4 tech_macd:f4 tech_macd_hist_pct:f4 tech_macd_cruce "
    "tech_atr14_pct:f4 tech_dist_max_52s_pct:f4 tech_dist_min_52s_pct:f4"
)


@query("daily_bars", "ticker_usd fecha open:f6 high:f6 low:f6 close:f6 adj_close:f6 volume:i", "SELECT * FROM bars")
def daily_bars(spark, sf):
    return A.bars(spark, sf)


@query("series_long", "serie fecha valor:f6", "SELECT * FROM macro")
def series_long(spark, sf):
    return A.macro(spark, sf)


@query("technical", TECH_COLUMNS, TECH_SQL)
def technical(spark, sf):
    return T.technical(A.bars(spark, sf), rounded_output=False)


@query(
    "moving_levels",
    "ticker_usd fecha sma20:f4 std20:f4 sma50:f4 sma200:f4 dias_sma200:i max_52s:f6 min_52s:f6 precio_1m:f6 precio_3m:f6 precio_6m:f6",
    """
SELECT ticker_usd, fecha, avg(adj_close) OVER (w ROWS 19 PRECEDING) AS sma20, stddev_pop(adj_close) OVER (w ROWS 19 PRECEDING) AS std20,
       avg(adj_close) OVER (w ROWS 49 PRECEDING) AS sma50, avg(adj_close) OVER (w ROWS 199 PRECEDING) AS sma200,
       count(*) OVER (w ROWS 199 PRECEDING) AS dias_sma200, max(adj_close) OVER (w ROWS 251 PRECEDING) AS max_52s,
       min(adj_close) OVER (w ROWS 251 PRECEDING) AS min_52s, lag(adj_close, 21) OVER w AS precio_1m,
       lag(adj_close, 63) OVER w AS precio_3m, lag(adj_close, 126) OVER w AS precio_6m
FROM bars WINDOW w AS (PARTITION BY ticker_usd ORDER BY fecha)""",
)
def moving_levels(spark, sf):
    return T.moving_levels(A.bars(spark, sf))


@query(
    "rsi_series",
    "ticker_usd fecha rsi:f4",
    """
SELECT ticker_usd, fecha, CASE WHEN n >= 14 THEN CASE WHEN l = 0 AND g > 0 THEN 100 ELSE 100 - 100 / (1 + g / nullif(l, 0)) END END AS rsi
FROM (SELECT *, avg(greatest(delta, 0)) FILTER (WHERE delta IS NOT NULL) OVER (w ROWS 13 PRECEDING) AS g,
             avg(greatest(-delta, 0)) FILTER (WHERE delta IS NOT NULL) OVER (w ROWS 13 PRECEDING) AS l, count(delta) OVER (w ROWS 13 PRECEDING) AS n
      FROM (SELECT *, adj_close - lag(adj_close) OVER (PARTITION BY ticker_usd ORDER BY fecha) AS delta FROM bars)
      WINDOW w AS (PARTITION BY ticker_usd ORDER BY fecha))""",
)
def rsi_series(spark, sf):
    return T.rsi_series(A.bars(spark, sf))


@query(
    "volume_moments",
    "ticker_usd fecha adj_close:f6 volume:i ratio_volumen:f4 percentil_precio_180d:f2 tipo",
    """
SELECT * FROM (
  SELECT ticker_usd, fecha, adj_close, volume, volume / nullif(vp, 0) AS ratio_volumen, p AS percentil_precio_180d,
         CASE WHEN p <= 0.25 THEN 'Acumulación (cerca de mínimo)' WHEN p >= 0.75 THEN 'Distribución/ruptura (cerca de máximo)' END AS tipo
  FROM (SELECT *, round((adj_close - lo) / nullif(hi - lo, 0), 2) AS p
        FROM (SELECT *, avg(volume) OVER (w ROWS BETWEEN 90 PRECEDING AND 1 PRECEDING) AS vp, min(adj_close) OVER (w ROWS 179 PRECEDING) AS lo,
                     max(adj_close) OVER (w ROWS 179 PRECEDING) AS hi, count(*) OVER (w ROWS 179 PRECEDING) AS n
              FROM bars WINDOW w AS (PARTITION BY ticker_usd ORDER BY fecha))
        WHERE n >= 180 AND volume >= 2 * vp)) WHERE tipo IS NOT NULL""",
)
def volume_moments(spark, sf):
    return T.volume_moments(A.bars(spark, sf))


@query(
    "returns_daily",
    "ticker_usd fecha retorno:f6",
    """SELECT * FROM (SELECT ticker_usd, fecha, adj_close / lag(adj_close) OVER (PARTITION BY ticker_usd ORDER BY fecha) - 1 AS retorno FROM bars)
WHERE retorno IS NOT NULL""",
)
def returns_daily(spark, sf):
    return M.returns(A.bars(spark, sf))


@query(
    "month_end_close",
    "ticker_usd fin_mes close:f6",
    "SELECT ticker_usd, last_day(fecha) AS fin_mes, arg_max(close, fecha) AS close FROM bars WHERE close > 0 GROUP BY 1, 2",
)
def month_end_close(spark, sf):
    return S.month_end_closes(A.bars(spark, sf))


@query(
    "last_rows_20",
    "ticker_usd fecha rn:i adj_close:f6",
    "SELECT *, row_number() OVER (PARTITION BY ticker_usd ORDER BY fecha DESC) AS rn FROM bars QUALIFY rn <= 20",
)
def last_rows_20(spark, sf):
    return S.newest_first(A.bars(spark, sf), 20)


@query(
    "calendar_fill",
    "ticker_usd fecha idx:i adj_close:f6",
    """
SELECT ticker_usd, c.fecha, idx, adj_close FROM (
  SELECT b.ticker_usd, b.adj_close, c.idx AS i0, least(c.idx + 3, coalesce(lead(c.idx) OVER (PARTITION BY b.ticker_usd ORDER BY c.idx) - 1,
                                                       (SELECT count(DISTINCT fecha) FROM macro WHERE serie = 'SP500'))) AS i1
  FROM bars b JOIN (SELECT fecha, row_number() OVER (ORDER BY fecha) AS idx FROM macro WHERE serie = 'SP500') c ON b.fecha = c.fecha) x
JOIN (SELECT fecha, row_number() OVER (ORDER BY fecha) AS idx FROM macro WHERE serie = 'SP500') c ON c.idx BETWEEN x.i0 AND x.i1""",
)
def calendar_fill(spark, sf):
    index = A.macro(spark, sf).filter(F.col("serie") == "SP500")
    return S.calendar_fill(A.bars(spark, sf), index, "adj_close", 3)


@query(
    "drawdown_running",
    "ticker_usd fecha maximo:f6 caida:f6",
    """SELECT ticker_usd, fecha, m AS maximo, adj_close / m - 1 AS caida
FROM (SELECT *, max(adj_close) OVER (PARTITION BY ticker_usd ORDER BY fecha) AS m FROM bars)""",
)
def drawdown_running(spark, sf):
    return S.drawdowns(A.bars(spark, sf), "adj_close", "ticker_usd")


EPISODES_SQL = """
SELECT serie, min(pico) AS episodio_pico, arg_max(piso, fecha) AS episodio_piso, min(caida) AS caida_minima FROM (
  SELECT *, sum(CASE WHEN caida = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY serie ORDER BY fecha) AS tramo,
         min(CASE WHEN caida = 0 THEN fecha END) OVER (PARTITION BY serie, m ORDER BY fecha) AS pico,
         arg_min(fecha, valor) OVER (PARTITION BY serie, m ORDER BY fecha) AS piso
  FROM (SELECT *, valor / m - 1 AS caida FROM (SELECT *, max(valor) OVER (PARTITION BY serie ORDER BY fecha) AS m FROM macro)))
GROUP BY serie, tramo HAVING min(caida) <= {thr}"""


@query("drawdown_episodes", "serie episodio_pico episodio_piso caida_minima:f6", EPISODES_SQL.format(thr="-0.10"))
def drawdown_episodes(spark, sf):
    return S.drawdown_episodes(A.macro(spark, sf))


@query(
    "factor_exposure",
    "ticker_usd dias_muestra:i corr_vs_usdbrl:f6 corr_vs_sp500:f6",
    """
SELECT ticker_usd, count(*) AS dias_muestra, CASE WHEN var_pop(r) * var_pop(a) > 0 THEN corr(r, a) END AS corr_vs_usdbrl,
       CASE WHEN var_pop(r) * var_pop(b) > 0 THEN corr(r, b) END AS corr_vs_sp500
FROM (SELECT ticker_usd, fecha, adj_close / lag(adj_close) OVER (PARTITION BY ticker_usd ORDER BY fecha) - 1 AS r FROM bars) x
JOIN (SELECT fecha, u / lag(u) OVER (ORDER BY fecha) - 1 AS a, s / lag(s) OVER (ORDER BY fecha) - 1 AS b
      FROM (SELECT fecha, max(valor) FILTER (WHERE serie = 'USDBRL') AS u, max(valor) FILTER (WHERE serie = 'SP500') AS s
            FROM macro WHERE serie IN ('USDBRL', 'SP500') GROUP BY fecha)) m ON m.fecha = x.fecha
WHERE r IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL GROUP BY 1""",
)
def factor_exposure(spark, sf, bars=None):
    return M.factor_exposure(A.bars(spark, sf) if bars is None else bars, A.macro(spark, sf), {"USDBRL": "usdbrl", "SP500": "sp500"})


RATES_SQL = """
SELECT *, CASE WHEN macro_corr_ret_vs_ust10y IS NULL THEN 'Sin dato' WHEN macro_corr_ret_vs_ust10y <= -0.15 THEN 'Muy sensible (cae con suba de tasa)'
               WHEN macro_corr_ret_vs_ust10y <= -0.05 THEN 'Sensible (cae con suba de tasa)' WHEN macro_corr_ret_vs_ust10y < 0.05 THEN 'Neutral'
               WHEN macro_corr_ret_vs_ust10y < 0.15 THEN 'Se beneficia levemente' ELSE 'Se beneficia con suba de tasa' END AS macro_sensibilidad_tasa
FROM (
SELECT ticker_usd, count(*) AS macro_dias_muestra, corr(r, a) AS macro_corr_ret_vs_ust10y, corr(r, b) AS macro_corr_ret_vs_ust30y
FROM (SELECT ticker_usd, fecha, adj_close / lag(adj_close) OVER (PARTITION BY ticker_usd ORDER BY fecha) - 1 AS r FROM bars) x
JOIN (SELECT fecha, u - lag(u) OVER (ORDER BY fecha) AS a, s - lag(s) OVER (ORDER BY fecha) AS b
      FROM (SELECT fecha, max(valor) FILTER (WHERE serie = 'UST10Y') AS u, max(valor) FILTER (WHERE serie = 'UST30Y') AS s
            FROM macro WHERE serie IN ('UST10Y', 'UST30Y') GROUP BY fecha)) m ON m.fecha = x.fecha
WHERE r IS NOT NULL AND a IS NOT NULL GROUP BY 1 HAVING count(*) >= 200)"""


@query(
    "rate_sensitivity",
    "ticker_usd macro_dias_muestra:i macro_corr_ret_vs_ust10y:f6 macro_corr_ret_vs_ust30y:f6 macro_sensibilidad_tasa",
    RATES_SQL,
)
def rate_sensitivity(spark, sf):
    return M.rate_sensitivity(A.bars(spark, sf), A.macro(spark, sf), rounded_output=False)


@query(
    "fx_clean_returns",
    "ticker_usd retorno_local_pct:f4 retorno_fx_pct:f4 retorno_limpio_pct:f4",
    """
SELECT ticker_usd, (g - 1) * 100 AS retorno_local_pct, (gf - 1) * 100 AS retorno_fx_pct, (g / gf - 1) * 100 AS retorno_limpio_pct
FROM (SELECT b.ticker_usd, arg_max(adj_close, b.fecha) / arg_min(adj_close, b.fecha) AS g
      FROM bars b JOIN dim d ON d.ticker_usd = b.ticker_usd, (
        SELECT greatest((SELECT min(fecha) FROM bars JOIN dim USING (ticker_usd) WHERE mercado = 'brasil'), (SELECT min(fecha) FROM macro WHERE serie = 'USDBRL')) AS i,
               least((SELECT max(fecha) FROM bars JOIN dim USING (ticker_usd) WHERE mercado = 'brasil'), (SELECT max(fecha) FROM macro WHERE serie = 'USDBRL')) AS f) r
      WHERE d.mercado = 'brasil' AND b.fecha BETWEEN r.i AND r.f GROUP BY 1),
     (SELECT arg_max(valor, fecha) / arg_min(valor, fecha) AS gf FROM macro, (
        SELECT greatest((SELECT min(fecha) FROM bars JOIN dim USING (ticker_usd) WHERE mercado = 'brasil'), (SELECT min(fecha) FROM macro WHERE serie = 'USDBRL')) AS i,
               least((SELECT max(fecha) FROM bars JOIN dim USING (ticker_usd) WHERE mercado = 'brasil'), (SELECT max(fecha) FROM macro WHERE serie = 'USDBRL')) AS f) r
      WHERE serie = 'USDBRL' AND fecha BETWEEN r.i AND r.f)""",
)
def fx_clean_returns(spark, sf, bars=None):
    brasil = A.dim(spark, sf).filter(F.col("mercado") == "brasil")
    return M.fx_clean_returns(A.bars(spark, sf) if bars is None else bars, A.macro(spark, sf), "USDBRL", brasil)


@query(
    "implied_fx_gap",
    "ticker_usd retorno_local_pct:f4 retorno_adr_pct:f4 ccl_implicito_pct:f4 oficial_pct:f4 brecha_pct:f4",
    """
WITH w AS (
  SELECT l.ticker_usd, greatest(l0, a0, (SELECT min(fecha) FROM macro WHERE serie = 'USDBRL')) AS i,
         least(l1, a1, (SELECT max(fecha) FROM macro WHERE serie = 'USDBRL')) AS f
  FROM (SELECT ticker_usd, min(fecha) AS l0, max(fecha) AS l1 FROM bars GROUP BY 1) l
  JOIN (SELECT ticker_usd, min(fecha) AS a0, max(fecha) AS a1 FROM adr GROUP BY 1) a ON a.ticker_usd = l.ticker_usd),
gl AS (SELECT b.ticker_usd, arg_max(adj_close, fecha) / arg_min(adj_close, fecha) AS g FROM bars b JOIN w ON w.ticker_usd = b.ticker_usd WHERE fecha BETWEEN i AND f GROUP BY 1),
ga AS (SELECT b.ticker_usd, arg_max(close, fecha) / arg_min(close, fecha) AS g FROM adr b JOIN w ON w.ticker_usd = b.ticker_usd WHERE fecha BETWEEN i AND f GROUP BY 1),
gf AS (SELECT w.ticker_usd, arg_max(valor, fecha) / arg_min(valor, fecha) AS g FROM macro m, w WHERE serie = 'USDBRL' AND fecha BETWEEN i AND f GROUP BY 1)
SELECT gl.ticker_usd, (gl.g - 1) * 100 AS retorno_local_pct, (ga.g - 1) * 100 AS retorno_adr_pct, (gl.g / ga.g - 1) * 100 AS ccl_implicito_pct,
       (gf.g - 1) * 100 AS oficial_pct, (gl.g / ga.g / gf.g - 1) * 100 AS brecha_pct
FROM gl JOIN ga ON ga.ticker_usd = gl.ticker_usd JOIN gf ON gf.ticker_usd = gl.ticker_usd""",
)
def implied_fx_gap(spark, sf):
    return M.implied_fx_gap(A.bars(spark, sf), A.adr_prices(spark, sf), A.macro(spark, sf), "USDBRL")


@query(
    "basket_index",
    "fecha retorno:f6 log_indice:f6",
    """
SELECT fecha, retorno, sum(ln(1 + retorno)) OVER (ORDER BY fecha) AS log_indice FROM (
  SELECT fecha, coalesce(s / nullif(coalesce(sum(nuevos) OVER (ORDER BY fecha ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0), 0) AS retorno
  FROM (SELECT fecha, sum(r) AS s, count(*) FILTER (WHERE r IS NULL) AS nuevos
        FROM (SELECT fecha, adj_close / lag(adj_close) OVER (PARTITION BY ticker_usd ORDER BY fecha) - 1 AS r FROM bars JOIN dim USING (ticker_usd) WHERE sector = 'NATION_9')
        GROUP BY fecha))""",
)
def basket_index(spark, sf):
    sector = A.dim(spark, sf).filter(F.col("sector") == "NATION_9")
    return M.equal_weight_basket(A.bars(spark, sf), sector)


@query(
    "market_context",
    "serie ultimo:f6 maximo:f6 desde_maximo_pct:f4",
    """SELECT serie, arg_max(valor, fecha) AS ultimo, max(valor) AS maximo, (arg_max(valor, fecha) / max(valor) - 1) * 100 AS desde_maximo_pct
FROM macro WHERE serie IN ('SP500', 'VIX', 'MERVAL') AND fecha >= (SELECT max(fecha) FROM macro) - 365 GROUP BY 1""",
)
def market_context(spark, sf):
    return M.market_context(A.macro(spark, sf), ["SP500", "VIX", "MERVAL"])


@query(
    "series_filled",
    "serie fecha valor:f6",
    """
SELECT s.serie, d.fecha, (SELECT arg_max(valor, m.fecha) FROM macro m WHERE m.serie = s.serie AND m.fecha <= d.fecha) AS valor
FROM (SELECT DISTINCT fecha FROM bars) d, (SELECT unnest(['VIX', 'USDBRL']) AS serie) s""",
)
def series_filled(spark, sf):
    return M.filled_series(A.macro(spark, sf), A.bars(spark, sf), ["VIX", "USDBRL"])


# Everything known about a company in one row; every rule then looks at that row.
QUALITY_BODY = """
WITH clock AS (SELECT max(fecha) AS today FROM bars),
traded AS (SELECT ticker_usd, min(fecha) AS first_day, max(fecha) AS last_day, count_if(coalesce(volume, 0) = 0 AND fecha >= today - 30) AS idle_days,
                  count_if((adj_close <= 0 OR close <= 0 OR high < low) AND fecha >= today - 365) AS bad_days FROM bars, clock GROUP BY 1),
moves AS (SELECT ticker_usd, fecha, adj_close / lag(adj_close) OVER (PARTITION BY ticker_usd ORDER BY fecha) - 1 AS move FROM bars WHERE adj_close > 0),
wildest AS (SELECT DISTINCT ON (ticker_usd) ticker_usd, move, fecha AS moved_on FROM moves, clock WHERE fecha >= today - 90 AND (move >= 1 OR move <= -0.5) ORDER BY ticker_usd, abs(move) DESC, fecha DESC),
known AS (SELECT DISTINCT ON (ticker_usd, name) ticker_usd, name, value
          FROM (UNPIVOT (SELECT ticker_usd, fecha, margen_neto_pct AS net, margen_operativo_pct AS op, enterprise_value AS firm, market_cap AS cap, institutional_holding_pct AS held FROM metrics)
                ON net, op, firm, cap, held INTO NAME name VALUE value) ORDER BY ticker_usd, name, fecha DESC),
ratios AS (PIVOT known ON name IN ('net', 'op', 'firm', 'cap', 'held') USING max(value) GROUP BY ticker_usd),
filed AS (SELECT ticker_usd, max(fecha) AS filed_on, max(max(fecha)) OVER () - max(fecha) AS late FROM metrics GROUP BY 1),
company AS (SELECT *, max(last_day) OVER (PARTITION BY mercado) AS market_day, coalesce(sector_corregido, sector) = 'Financial Services' AS bank
            FROM clock, dim LEFT JOIN traded USING (ticker_usd) LEFT JOIN wildest USING (ticker_usd) LEFT JOIN ratios USING (ticker_usd) LEFT JOIN filed USING (ticker_usd)),
marks AS (SELECT ticker_usd, unnest([
  struct_pack(hit := mercado <> 'cripto' AND idle_days > 5, regla := 'cotizacion_sin_movimiento', severidad := 'error', valor := CAST(idle_days AS DOUBLE), referencia := CAST(NULL AS DOUBLE)),
  struct_pack(hit := market_day - last_day > {behind}, regla := 'precio_desactualizado', severidad := 'error', valor := CAST(last_day - DATE '1970-01-01' AS DOUBLE), referencia := CAST(market_day - DATE '1970-01-01' AS DOUBLE)),
  struct_pack(hit := bad_days > 0, regla := 'precio_invalido', severidad := 'error', valor := CAST(bad_days AS DOUBLE), referencia := CAST(NULL AS DOUBLE)),
  struct_pack(hit := late > 7, regla := 'metricas_desactualizadas', severidad := 'error', valor := CAST(filed_on - DATE '1970-01-01' AS DOUBLE), referencia := CAST(NULL AS DOUBLE)),
  struct_pack(hit := move IS NOT NULL, regla := 'salto_de_precio', severidad := 'advertencia', valor := move, referencia := CAST(moved_on - DATE '1970-01-01' AS DOUBLE)),
  struct_pack(hit := net > 0 AND net - op >= 10, regla := 'margen_incoherente', severidad := 'advertencia', valor := net, referencia := op),
  struct_pack(hit := NOT bank AND cap > 0 AND (firm < 0 OR firm > 10 * cap), regla := 'moneda_inconsistente', severidad := 'advertencia', valor := firm, referencia := cap),
  struct_pack(hit := held < 5 AND today - first_day < 365, regla := 'tenencia_institucional_no_confiable', severidad := 'advertencia', valor := held, referencia := CAST(first_day - DATE '1970-01-01' AS DOUBLE))
]) AS mark FROM company)
SELECT ticker_usd, mark.regla, mark.severidad, mark.valor, mark.referencia FROM marks WHERE mark.hit"""


def quality_of(spark, sf, bars=None, metrics=None):
    """``bars``, ``metrics``: the tables, if the caller has them already."""
    return Q.data_quality(A.bars(spark, sf) if bars is None else bars, A.metrics(spark, sf) if metrics is None else metrics, A.dim(spark, sf), A.last_day(spark, sf))


@query("quality_marks", "ticker_usd regla severidad valor:f4 referencia:f2", QUALITY_BODY.format(behind=7))
def quality_marks(spark, sf):
    return quality_of(spark, sf)


@query(
    "asof_vix_at_bars",
    "ticker_usd fecha vix:f6",
    """SELECT ticker_usd, b.fecha, valor AS vix FROM bars b ASOF LEFT JOIN (SELECT fecha, valor FROM macro WHERE serie = 'VIX') m ON b.fecha >= m.fecha""",
)
def asof_vix_at_bars(spark, sf):
    b, m = A.bars(spark, sf), A.macro(spark, sf)
    level = M.filled_series(m, b, ["VIX"]).select("fecha", F.col("valor").alias("vix"))
    return b.join(S.broadcast_per_date(level), "fecha", "left")


@query(
    "adr_pairs",
    "ticker_usd ticker_adr fecha close:f6 adj_close:f6 volume:i",
    "SELECT * FROM adr",
)
def adr_pairs(spark, sf):
    return A.adr_prices(spark, sf)


@query(
    "base_100",
    "ticker_usd fecha base_100:f4",
    """SELECT b.ticker_usd, fecha, adj_close / first_value(adj_close) OVER (PARTITION BY b.ticker_usd ORDER BY fecha) * 100 AS base_100
FROM bars b JOIN top5 ON top5.ticker_usd = b.ticker_usd""",
)
def base_100(spark, sf):
    from tickerloom.operators.research import rebased

    return rebased(A.bars(spark, sf), A.most_traded(spark, sf))
