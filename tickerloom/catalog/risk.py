"""Queries over risk, small portfolios, outcomes over history and event windows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tickerloom.catalog.base import query
from tickerloom.operators import macro as M
from tickerloom.operators import research as R
from tickerloom.operators import risk as K
from tickerloom.sources import adapters as A

RET = "SELECT * FROM (SELECT ticker_usd, fecha, adj_close / lag(adj_close) OVER (PARTITION BY ticker_usd ORDER BY fecha) - 1 AS r FROM bars) WHERE r IS NOT NULL"


@query(
    "risk_stats",
    "ticker_usd dias:i vol_anual_pct:f4 asimetria:f4 curtosis:f4 var_95_pct:f4 cvar_95_pct:f4",
    f"""
WITH r AS ({RET}), s AS (SELECT ticker_usd, count(*) AS dias, stddev_samp(r) * sqrt(252) * 100 AS vol_anual_pct,
   avg(pow(r - mu, 3)) / pow(avg(pow(r - mu, 2)), 1.5) AS asimetria, kurtosis_pop(r) AS curtosis, quantile_cont(r, 0.05) AS v
   FROM (SELECT *, avg(r) OVER (PARTITION BY ticker_usd) AS mu FROM r) GROUP BY 1)
SELECT s.ticker_usd, dias, vol_anual_pct, asimetria, curtosis, v * 100 AS var_95_pct, c AS cvar_95_pct
FROM s LEFT JOIN (SELECT r.ticker_usd, avg(r.r) * 100 AS c FROM r JOIN s ON s.ticker_usd = r.ticker_usd WHERE r.r <= s.v GROUP BY 1) x ON x.ticker_usd = s.ticker_usd""",
)
def risk_stats(spark, sf):
    return K.risk_stats(A.bars(spark, sf))


@query(
    "drawdown_recovery",
    "ticker_usd max_drawdown_pct:f4 fecha_minimo dias_recuperacion:i",
    """
WITH d AS (SELECT *, max(adj_close) OVER (PARTITION BY ticker_usd ORDER BY fecha) AS m FROM bars),
w AS (SELECT ticker_usd, min(adj_close / m - 1) AS dd, arg_min(fecha, ROW(adj_close / m - 1, fecha)) AS f, arg_min(m, ROW(adj_close / m - 1, fecha)) AS pico FROM d GROUP BY 1)
SELECT w.ticker_usd, dd * 100 AS max_drawdown_pct, f AS fecha_minimo, (SELECT min(fecha) FROM bars b WHERE b.ticker_usd = w.ticker_usd AND b.fecha >= w.f AND b.adj_close >= w.pico) - f AS dias_recuperacion
FROM w""",
)
def drawdown_recovery(spark, sf):
    return K.drawdown_recovery(A.bars(spark, sf))


NATIONS_SQL = """
lines AS (SELECT 'N' || s_nationkey AS ticker_usd, last_day(CAST(l_shipdate AS DATE)) AS fecha, CAST(round(l_extendedprice * 100) AS BIGINT) AS e, CAST(l_quantity AS BIGINT) AS q
          FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
months AS (SELECT ticker_usd, fecha, CAST(sum(e) AS BIGINT) / CAST(sum(q) AS DOUBLE) / 100 AS adj_close FROM lines GROUP BY 1, 2)"""
ALL_SQL = f"""{NATIONS_SQL},
shared AS (SELECT fecha FROM months GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT ticker_usd) FROM months)),
cr AS (SELECT * FROM (SELECT ticker_usd, fecha, adj_close / lag(adj_close) OVER (PARTITION BY ticker_usd ORDER BY fecha) - 1 AS r FROM months SEMI JOIN shared USING (fecha)) WHERE r IS NOT NULL),
two AS (SELECT a.fecha, a.ticker_usd AS a, b.ticker_usd AS b, a.r AS x, b.r AS y FROM cr a JOIN cr b ON a.fecha = b.fecha AND a.ticker_usd < b.ticker_usd),
ps AS (SELECT a, b, corr(x, y) AS corr, covar_samp(x, y) AS cov FROM two GROUP BY 1, 2)"""


def _nations(spark, sf):
    """Monthly prices of all nations: names that share most dates."""
    return A.nation_months(spark, sf)


@query("common_returns", "ticker_usd fecha r:f6", f"WITH {ALL_SQL} SELECT * FROM cr")
def common_returns(spark, sf):
    return K.common_returns(_nations(spark, sf))


@query("corr_pairs", "a b corr:f6 cov:f6", f"WITH {ALL_SQL} SELECT * FROM ps")
def corr_pairs(spark, sf):
    return K.correlation_pairs(_nations(spark, sf))


@query(
    "extreme_pairs",
    "a b corr:f6 extremo",
    f"""WITH {ALL_SQL}
SELECT * FROM (SELECT *, 'más' AS extremo FROM ps ORDER BY corr DESC, a, b LIMIT 5) UNION ALL SELECT * FROM (SELECT *, 'menos' AS extremo FROM ps ORDER BY corr, a, b LIMIT 5)""",
)
def extreme_pairs(spark, sf):
    return K.extreme_pairs(K.correlation_pairs(_nations(spark, sf)))


SUPPLIER_PAIRS_SQL = f"""
WITH r AS ({RET})
SELECT a.ticker_usd AS a, b.ticker_usd AS b, count(*) AS n, covar_samp(a.r, b.r) AS cov, CASE WHEN stddev_samp(a.r) > 0 AND stddev_samp(b.r) > 0 THEN corr(a.r, b.r) END AS corr
FROM r a JOIN r b ON a.fecha = b.fecha AND a.ticker_usd < b.ticker_usd GROUP BY 1, 2 HAVING count(*) >= 10"""


@query("supplier_pairs", "a b n:i cov:f4 corr:f4", SUPPLIER_PAIRS_SQL)
def supplier_pairs(spark, sf):
    """All pairs of all suppliers, each over the dates both have."""
    return K.pairwise_correlations(A.bars(spark, sf), min_dates=10, n_names=A.n_traded(spark, sf))


@query(
    "supplier_extremes",
    "a b corr:f6 extremo",
    f"""WITH ps AS ({SUPPLIER_PAIRS_SQL.replace("HAVING count(*) >= 10", "HAVING count(*) >= 12")})
SELECT * FROM (SELECT *, 'más' AS extremo FROM ps WHERE corr IS NOT NULL ORDER BY corr DESC, a, b LIMIT 5)
UNION ALL SELECT * FROM (SELECT *, 'menos' AS extremo FROM ps WHERE corr IS NOT NULL ORDER BY corr, a, b LIMIT 5)""",
)
def supplier_extremes(spark, sf):
    return K.extreme_pairs(K.pairwise_correlations(A.bars(spark, sf), min_dates=12, ends=5, n_names=A.n_traded(spark, sf)))


@query(
    "regime_stats",
    "regimen dias:i periodo_pct:f4 retorno_medio_pct:f4 vol_anual_pct:f4 cvar_95_pct:f4 peor_dia_pct:f4 corr_promedio:f6",
    f"""
WITH {ALL_SQL},
d AS (SELECT fecha, avg(r) AS r FROM cr GROUP BY 1),
n AS (SELECT *, CASE WHEN v < 0 THEN NULL WHEN v < 20 THEN 'Calma' WHEN v < 30 THEN 'Normal' WHEN v IS NOT NULL THEN 'Estrés' END AS regimen
      FROM d ASOF LEFT JOIN (SELECT fecha AS fv, valor AS v FROM macro WHERE serie = 'VIX') m ON d.fecha >= m.fv),
s AS (SELECT regimen, count(*) AS dias, avg(r) AS media, stddev_samp(r) AS de, quantile_cont(r, 0.05) AS va, min(r) AS peor FROM n WHERE regimen IS NOT NULL GROUP BY 1),
c AS (SELECT regimen, avg(k) AS c FROM (SELECT regimen, a, b, corr(x, y) AS k FROM two JOIN n ON n.fecha = two.fecha WHERE regimen IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1)
SELECT s.regimen, dias, dias * 100e0 / (SELECT count(*) FROM n) AS periodo_pct, media * 100 AS retorno_medio_pct, de * sqrt(252) * 100 AS vol_anual_pct,
       (SELECT avg(r) * 100 FROM n WHERE n.regimen = s.regimen AND n.r <= s.va) AS cvar_95_pct, peor * 100 AS peor_dia_pct, c AS corr_promedio FROM s LEFT JOIN c ON c.regimen = s.regimen""",
)
def regime_stats(spark, sf):
    return K.regime_stats(_nations(spark, sf), A.macro(spark, sf), calm=20, stress=30)


def _wide_sql(n: int) -> str:
    """Returns of the ``n`` most traded nations side by side: the portfolio the grids are asked about."""
    cols = ", ".join(f"max(adj_close) FILTER (WHERE i = {k}) AS p{k}" for k in range(n))
    known = " AND ".join(f"p{k} IS NOT NULL" for k in range(n))
    rets = ", ".join(f"p{k} / lag(p{k}) OVER (ORDER BY fecha) - 1 AS r{k}" for k in range(n))
    return f"""{NATIONS_SQL},
names AS (SELECT ticker_usd, row_number() OVER (ORDER BY v DESC, ticker_usd) - 1 AS i FROM (SELECT ticker_usd, sum(q) AS v FROM lines GROUP BY 1) QUALIFY i < {n}),
wide AS (SELECT * FROM (SELECT fecha, {cols} FROM months b JOIN names t ON t.ticker_usd = b.ticker_usd GROUP BY 1) WHERE {known}),
cr AS (SELECT * FROM (SELECT fecha, {rets} FROM wide) WHERE r0 IS NOT NULL),
long AS (SELECT fecha, i, r FROM (SELECT *, unnest(range({n})) AS i, unnest([{", ".join(f"r{k}" for k in range(n))}]) AS r FROM cr)),
two AS (SELECT a.fecha, a.i, b.i AS j, a.r AS x, b.r AS y FROM long a JOIN long b ON a.fecha = b.fecha AND a.i < b.i)"""


def _grid_sql(steps: int) -> str:
    """Every weight vector as a list, grown asset by asset, and its moments as sums over names and pairs."""
    return f"""
WITH RECURSIVE {_wide_sql(GRID_NAMES)},
mu AS (SELECT i, avg(r) * 252 AS m, var_samp(r) * 252 AS v FROM long GROUP BY 1), cv AS (SELECT i, j, covar_samp(x, y) * 252 AS c FROM two GROUP BY 1, 2),
g AS (SELECT CAST([] AS BIGINT[]) AS w, CAST({steps} AS BIGINT) AS resto UNION ALL
      SELECT list_append(w, x), resto - x FROM (SELECT w, resto, unnest(CASE WHEN len(w) = {GRID_NAMES - 1} THEN [resto] ELSE range(resto + 1) END) AS x FROM g WHERE len(w) < {GRID_NAMES})),
full_ AS (SELECT w FROM g WHERE len(w) = {GRID_NAMES}),
a AS (SELECT w, sum(w[i + 1] / {steps}e0 * m) AS retorno, sum(pow(w[i + 1] / {steps}e0, 2) * v) AS v1, min(m) AS lo, max(m) AS hi FROM full_, mu GROUP BY 1),
b AS (SELECT w, sum(2 * w[i + 1] / {steps}e0 * w[j + 1] / {steps}e0 * c) AS v2 FROM full_, cv GROUP BY 1),
p AS (SELECT w, retorno, lo, hi, sqrt(greatest(v1 + v2, 0)) AS vol FROM a JOIN b USING (w))"""


GRID_NAMES = 5


def _grid(spark, sf, steps):
    return K.portfolio_grid(_nations(spark, sf), A.most_traded_nations(spark, sf, GRID_NAMES), steps=steps)


@query(
    "portfolio_grid",
    " ".join(f"w{k}:f2" for k in range(GRID_NAMES)) + " retorno:f6 vol:f6 es_minima:b",
    f"{_grid_sql(10)} SELECT {', '.join(f'w[{k + 1}] / 10e0 AS w{k}' for k in range(GRID_NAMES))}, retorno, vol, vol = min(vol) OVER () AS es_minima FROM p",
)
def portfolio_grid(spark, sf):
    return _grid(spark, sf, 10).select("*", *[F.col("pesos")[i].alias(f"w{i}") for i in range(GRID_NAMES)])


@query(
    "portfolio_frontier",
    "tramo:i retorno:f6 vol:f6",
    f"{_grid_sql(20)} SELECT least(greatest(floor((retorno - lo) / (hi - lo) * 25), 0), 24) AS tramo, arg_min(retorno, vol) AS retorno, min(vol) AS vol FROM p GROUP BY 1",
)
def portfolio_frontier(spark, sf):
    return _grid(spark, sf, 20).filter("es_frontera")


def _portfolio_returns(spark, sf):
    """Daily returns of the market: what a unit cost on average on each day, as it is."""
    return M.returns(A.market_days(spark, sf)).select("fecha", F.col("retorno").alias("r"))


MARKET_SQL = """
SELECT fecha, p / lag(p) OVER (ORDER BY fecha) - 1 AS r
FROM (SELECT CAST(l_shipdate AS DATE) AS fecha, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) / CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) / 100 AS p FROM lineitem GROUP BY 1)
QUALIFY r IS NOT NULL"""


@query(
    "block_bootstrap",
    "ventanas:i mediana_pct:f4 p5_pct:f4 cvar_pct:f4 p95_pct:f4 perdida_pct:f4 peor_pct:f4",
    f"""
WITH h AS ({MARKET_SQL}),
e AS (SELECT exp(l) - 1 AS final FROM (SELECT sum(ln(1 + r)) OVER w AS l, count(*) OVER w AS n FROM h WINDOW w AS (ORDER BY fecha ROWS BETWEEN 1 FOLLOWING AND 252 FOLLOWING)) WHERE n = 252),
q AS (SELECT count(*) AS ventanas, median(final) AS md, quantile_cont(final, 0.05) AS p5, quantile_cont(final, 0.95) AS p95, avg(CASE WHEN final < 0 THEN 1e0 ELSE 0 END) AS l, min(final) AS mn FROM e)
SELECT ventanas, md * 100 AS mediana_pct, p5 * 100 AS p5_pct, (SELECT avg(final) FROM e WHERE final <= p5) * 100 AS cvar_pct, p95 * 100 AS p95_pct, l * 100 AS perdida_pct, mn * 100 AS peor_pct FROM q""",
)
def block_bootstrap(spark, sf):
    """All real one-year windows instead of drawn ones."""
    return K.yearly_outcomes(_portfolio_returns(spark, sf))


@query(
    "cashflow_terminal",
    "orden plan valor:f4",
    f"""
WITH RECURSIVE h AS (SELECT r, row_number() OVER (ORDER BY fecha) AS k, count(*) OVER () AS n FROM ({MARKET_SQL})),
p AS (SELECT 'real' AS orden, k AS paso, r FROM h UNION ALL SELECT 'invertido', n - k + 1, r FROM h),
walk AS (
  SELECT orden, plan, flujo, CAST(0 AS BIGINT) AS paso, CAST(100 AS DOUBLE) AS v
  FROM (SELECT unnest(['real', 'invertido']) AS orden), (VALUES ('sin flujos', 0e0), ('aporta', 0.5e0), ('retira', -0.5e0)) f(plan, flujo)
  UNION ALL
  SELECT w.orden, w.plan, w.flujo, p.paso, CASE WHEN p.paso % 21 = 0 THEN greatest(w.v * (1 + p.r) + w.flujo, 0) ELSE w.v * (1 + p.r) END
  FROM walk w JOIN p ON p.orden = w.orden AND p.paso = w.paso + 1)
SELECT orden, plan, arg_max(v, paso) AS valor FROM walk GROUP BY 1, 2""",
)
def cashflow_terminal(spark, sf):
    return K.order_of_returns(_portfolio_returns(spark, sf))


@query(
    "sequence_risk",
    "orden plan valor:f4",
    f"""
WITH RECURSIVE h AS (SELECT r, row_number() OVER (ORDER BY fecha) AS k, count(*) OVER () AS n FROM ({MARKET_SQL})),
p AS (SELECT 'real' AS orden, k AS paso, r FROM h UNION ALL SELECT 'invertido', n - k + 1, r FROM h),
walk AS (
  SELECT orden, plan, flujo, CAST(0 AS BIGINT) AS paso, CAST(100 AS DOUBLE) AS v
  FROM (SELECT unnest(['real', 'invertido']) AS orden), (VALUES ('aporta mucho', 5e0), ('retira mucho', -5e0)) f(plan, flujo)
  UNION ALL
  SELECT w.orden, w.plan, w.flujo, p.paso, CASE WHEN p.paso % 63 = 0 THEN greatest(w.v * (1 + p.r) + w.flujo, 0) ELSE w.v * (1 + p.r) END
  FROM walk w JOIN p ON p.orden = w.orden AND p.paso = w.paso + 1)
SELECT orden, plan, arg_max(v, paso) AS valor FROM walk GROUP BY 1, 2""",
)
def sequence_risk(spark, sf):
    """Heavier, rarer flows over the real history and its reverse: how much the order of the same returns weighs."""
    return K.order_of_returns(_portfolio_returns(spark, sf), {"aporta mucho": 5.0, "retira mucho": -5.0}, every=63)


EVENTS = {"A": dt.date(1998, 10, 4), "B": dt.date(1999, 10, 24), "C": dt.date(2001, 6, 30)}
EVENTS_SQL = " UNION ALL ".join(f"SELECT '{k}' AS evento, DATE '{v}' AS fe" for k, v in EVENTS.items())
ANCHOR_SQL = f"""
s AS (SELECT serie, fecha, valor, row_number() OVER (PARTITION BY serie ORDER BY fecha) AS i, count(*) OVER (PARTITION BY serie) AS n FROM macro),
an AS (SELECT evento, fe, serie, max(i) AS i0, arg_max(valor, i) AS base, max(n) AS n FROM s, ({EVENTS_SQL}) e WHERE s.fecha < e.fe GROUP BY 1, 2, 3 HAVING max(i) < max(n))"""


@query(
    "event_window",
    "evento serie antes_60_pct:f4 mas_20_pct:f4 mas_60_pct:f4 mas_120_pct:f4",
    f"""
WITH {ANCHOR_SQL}
SELECT evento, an.serie, (base / b.valor - 1) * 100 AS antes_60_pct, (c.valor / base - 1) * 100 AS mas_20_pct, (d.valor / base - 1) * 100 AS mas_60_pct, (e.valor / base - 1) * 100 AS mas_120_pct
FROM an JOIN s b ON b.serie = an.serie AND b.i = i0 - 60 LEFT JOIN s c ON c.serie = an.serie AND c.i = i0 + 20 LEFT JOIN s d ON d.serie = an.serie AND d.i = i0 + 60
LEFT JOIN s e ON e.serie = an.serie AND e.i = i0 + 120""",
)
def event_window(spark, sf):
    return R.event_window(A.macro(spark, sf), EVENTS)


@query(
    "pre_event_minimum",
    "evento serie fecha_minimo dias_antes:i caida_pct:f4 hasta_vispera_pct:f4 hasta_mas_60_pct:f4",
    f"""
WITH {ANCHOR_SQL},
l AS (SELECT evento, fe, an.serie, i0, base, arg_min(s.i, ROW(s.valor, s.i)) AS im, min(s.valor) AS mn, arg_min(s.fecha, ROW(s.valor, s.i)) AS fm
      FROM an JOIN s ON s.serie = an.serie AND s.i BETWEEN greatest(i0 - 125, 1) AND i0 GROUP BY 1, 2, 3, 4, 5)
SELECT evento, serie, fm AS fecha_minimo, fe - fm AS dias_antes,
       (mn / (SELECT max(valor) FROM s WHERE s.serie = l.serie AND s.i BETWEEN greatest(l.i0 - 125, 1) AND l.im) - 1) * 100 AS caida_pct,
       (base / mn - 1) * 100 AS hasta_vispera_pct, ((SELECT max(valor) FROM s WHERE s.serie = l.serie AND s.i = l.i0 + 60) / mn - 1) * 100 AS hasta_mas_60_pct
FROM l""",
)
def pre_event_minimum(spark, sf):
    return R.pre_event_minimum(A.macro(spark, sf), EVENTS)


@query(
    "series_summary",
    "serie ret_1m_pct:f4 ret_3m_pct:f4 ret_6m_pct:f4 ret_12m_pct:f4 fecha_maximo desde_maximo_pct:f4 fecha_minimo_posterior desde_minimo_pct:f4",
    """
WITH l AS (SELECT serie, max(fecha) AS h, arg_max(valor, fecha) AS u FROM macro GROUP BY 1),
v AS (SELECT * FROM macro WHERE fecha >= DATE '2000-05-01'),
t AS (SELECT serie, max(valor) AS mx, arg_min(fecha, ROW(-valor, fecha)) AS fm FROM v GROUP BY 1),
p AS (SELECT v.serie, min(valor) AS mn, arg_min(v.fecha, ROW(valor, v.fecha)) AS fp FROM v JOIN t ON t.serie = v.serie AND v.fecha >= t.fm GROUP BY 1)
SELECT l.serie, """
    + ", ".join(
        f"(u / (SELECT arg_max(valor, fecha) FROM macro m WHERE m.serie = l.serie AND m.fecha <= CAST(l.h - INTERVAL {k} MONTH AS DATE)) - 1) * 100 AS ret_{k}m_pct" for k in (1, 3, 6, 12)
    )
    + """, fm AS fecha_maximo, (u / mx - 1) * 100 AS desde_maximo_pct, fp AS fecha_minimo_posterior, (u / mn - 1) * 100 AS desde_minimo_pct
FROM l JOIN t ON t.serie = l.serie JOIN p ON p.serie = l.serie""",
)
def series_summary(spark, sf):
    return R.series_summary(A.macro(spark, sf), dt.date(2000, 5, 1))
