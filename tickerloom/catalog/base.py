"""Registry of the queries checked against SQL, and the SQL form of the model's tables."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Build = Callable[[SparkSession, str], DataFrame]

# Numbers are cut a little off the half: short decimals often end in an exact half, where the last bit of two engines decides.
CUT = 0.4873


@dataclass(frozen=True)
class Query:
    """``columns`` names the output: ``name`` (text or date as text), ``name:i`` integer, ``name:b`` flag as
    0/1, ``name:fN`` number to N decimals. Both engines project onto the same columns in the same way."""

    name: str
    build: Build
    columns: tuple[tuple[str, str], ...]
    body: str | None

    def dataframe(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.build(spark, sf_dir).select(*[_spark_column(n, t).alias(n) for n, t in self.columns])

    def sql(self) -> str | None:
        if self.body is None:
            return None
        body = self.body.strip()
        outer = ", ".join(f"{_sql_column(n, t)} AS {n}" for n, t in self.columns)
        ctes = _needed_views(body)
        prefix = "WITH RECURSIVE " + ",\n".join(f"{v} AS ({VIEWS[v].strip()})" for v in ctes) + "\n" if ctes else ""
        return f"{prefix}SELECT {outer} FROM (\n{body}\n) AS q"


def _spark_column(name: str, kind: str):
    c = F.col(name)
    if kind == "s":
        return c.cast("string")
    if kind == "i":
        return c.cast("long")
    if kind == "b":
        return c.cast("int").cast("long")
    scale = 10.0 ** int(kind[1:])
    return F.floor(c * scale + CUT) / scale


def _sql_column(name: str, kind: str) -> str:
    if kind == "s":
        return f"CAST({name} AS VARCHAR)"
    if kind == "i":
        return f"CAST({name} AS BIGINT)"
    if kind == "b":
        return f"CAST(CAST({name} AS INTEGER) AS BIGINT)"
    scale = "1" + "0" * int(kind[1:])
    return f"floor(CAST({name} AS DOUBLE) * {scale}e0 + {CUT}e0) / {scale}e0"


QUERIES: dict[str, Query] = {}


def query(name: str, columns: str, sql: str | None = None) -> Callable[[Build], Build]:
    """Register a query; ``columns`` is a space-separated list as described in ``Query``."""
    spec = tuple((c.split(":")[0], c.split(":")[1] if ":" in c else "s") for c in columns.split())

    def add(build: Build) -> Build:
        QUERIES[name] = Query(name, build, spec, sql)
        return build

    return add


def _needed_views(sql: str) -> list[str]:
    found: list[str] = []
    entered: set[str] = set()

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in entered and re.search(rf"\b{name}\b", text):
                entered.add(name)
                visit(VIEWS[name])
                found.append(name)

    visit(sql)
    return found


def _lines(period: str) -> str:
    return f"""
SELECT ticker_usd, p, count(*) AS n, CAST(sum(e) AS BIGINT) AS e, CAST(sum(d) AS BIGINT) AS d, CAST(sum(t) AS BIGINT) AS t,
       CAST(sum(q) AS BIGINT) AS q, CAST(sum(e * (100 - d)) AS BIGINT) AS net, CAST(sum(e * d) AS BIGINT) AS ed,
       CAST(sum(e * t) AS BIGINT) AS et, CAST(sum(CASE WHEN l_linestatus = 'O' THEN e * t ELSE 0 END) AS BIGINT) AS et_open,
       CAST(sum(CASE WHEN l_returnflag = 'R' THEN e ELSE 0 END) AS BIGINT) AS e_ret,
       count(*) FILTER (WHERE l_returnflag = 'N') AS n_n, count(*) FILTER (WHERE l_returnflag = 'R') AS n_r,
       count(*) FILTER (WHERE l_returnflag = 'A') AS n_a
FROM (SELECT 'S' || l_suppkey AS ticker_usd, {period} AS p, CAST(round(l_extendedprice * 100) AS BIGINT) AS e,
             CAST(round(l_discount * 100) AS BIGINT) AS d, CAST(round(l_tax * 100) AS BIGINT) AS t,
             CAST(l_quantity AS BIGINT) AS q, l_returnflag, l_linestatus FROM lineitem)
GROUP BY ticker_usd, p"""


_NULL_METRICS = ", ".join(
    f"CAST(NULL AS DOUBLE) AS {c}"
    for c in (
        "eps_growth_3y_pct", "eps_growth_5y_pct", "sorpresa_eps_prom_4q_pct", "pe_forward", "ev_ebitda", "margen_bruto_pct",
        "roa_pct", "payout_ratio_pct",
    )
)

VIEWS: dict[str, str] = {
    "bars": """
SELECT ticker_usd, fecha, arg_min(px, o) AS open, max(px) AS high, min(px) AS low, arg_max(px, o) AS close,
       arg_max(px * (1 - l_discount), o) AS adj_close, CAST(sum(l_quantity) AS BIGINT) AS volume
FROM (SELECT 'S' || l_suppkey AS ticker_usd, CAST(l_shipdate AS DATE) AS fecha, l_extendedprice / l_quantity AS px,
             (l_orderkey * 8 + l_linenumber) * 1048576 + l_partkey % 1048576 AS o, l_quantity, l_discount FROM lineitem)
GROUP BY ticker_usd, fecha""",
    "dim": """
SELECT *, CASE WHEN k % 11 <> 0 THEN quote END AS moneda_cotizacion, CASE WHEN k % 4 = 0 THEN 'BRL' ELSE quote END AS moneda_balance,
       CASE WHEN mercado = 'argentina_local' AND k % 2 = 0 THEN 'A' || k END AS ticker_adr_usa
FROM (SELECT *, CASE mercado WHEN 'argentina_local' THEN 'ARS' WHEN 'brasil' THEN 'BRL' ELSE 'USD' END AS quote
      FROM (SELECT s_suppkey AS k, 'S' || s_suppkey AS ticker_usd,
                   CASE r_name WHEN 'AFRICA' THEN 'argentina_local' WHEN 'AMERICA' THEN 'usa_otros' WHEN 'ASIA' THEN 'brasil'
                               WHEN 'EUROPE' THEN 'etf' WHEN 'MIDDLE EAST' THEN 'cripto' END AS mercado,
                   s_name AS nombre_empresa, n_name AS sector, CASE WHEN s_suppkey % 17 = 0 THEN 'NATION_0' END AS sector_corregido,
                   n_name || '-' || (s_suppkey % 3) AS industria, n_name AS pais_origen
            FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey))""",
    "macro": """
SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'SP500' WHEN '2-HIGH' THEN 'UST10Y' WHEN '3-MEDIUM' THEN 'USDBRL'
                            WHEN '4-NOT SPECIFIED' THEN 'UST30Y' WHEN '5-LOW' THEN 'VIX' END AS serie,
       CAST(o_orderdate AS DATE) AS fecha,
       CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / count(*) / 1000000e0 AS valor
FROM orders GROUP BY 1, 2""",
    "lines_month": _lines("CAST(date_trunc('month', l_shipdate) AS DATE)"),
    "lines_year": _lines("make_date(CAST(year(l_shipdate) AS INTEGER), 12, 31)"),
    "lines_quarter": _lines("CAST(date_trunc('quarter', l_shipdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE)"),
    "metrics": f"""
SELECT ticker_usd, p AS fecha, e * 10e0 AS market_cap, e * 10e0 * (1 + (t / CAST(n AS DOUBLE) - 4) * 0.6e0) AS enterprise_value,
       n * 100e0 / nullif(d, 0) AS pe_trailing, n * 100e0 / nullif(d, 0) / (q / CAST(n AS DOUBLE)) AS peg_ratio,
       q / CAST(n AS DOUBLE) / 20 AS price_to_book,
       CASE WHEN month(p) % 5 <> 0 THEN (t / CAST(n AS DOUBLE) - 2) * 10 END AS margen_neto_pct,
       (d / CAST(n AS DOUBLE) - 3) * 10 AS margen_operativo_pct,
       CASE WHEN month(p) % 4 <> 0 THEN d / CAST(n AS DOUBLE) * 3 END AS roe_pct,
       t / CAST(n AS DOUBLE) * 20 AS deuda_patrimonio, d / CAST(n AS DOUBLE) * 0.3e0 AS razon_corriente, q / CAST(n AS DOUBLE) / 20 AS beta,
       d / CAST(n AS DOUBLE) AS insider_holding_pct,
       CASE WHEN month(p) % 2 = 1 THEN t / CAST(n AS DOUBLE) * 10 END AS institutional_holding_pct,
       d / CAST(n AS DOUBLE) / 2 AS dividend_yield_pct, q * 1000000e0 AS shares_outstanding,
       CASE WHEN month(p) % 3 = 0 THEN (d / CAST(n AS DOUBLE) - 4) * 10 END AS crecimiento_ingresos_anual_pct,
       CASE WHEN month(p) % 3 = 0 THEN (t / CAST(n AS DOUBLE) - 4.5e0) * 20 END AS crecimiento_ganancia_anual_pct,
       CASE WHEN month(p) % 3 = 0 THEN (d / CAST(n AS DOUBLE) - t / CAST(n AS DOUBLE)) * 5 END AS aceleracion_ingresos_pct,
       CAST(NULL AS INTEGER) AS trimestres_superando_estimado, {_NULL_METRICS}
FROM lines_month""",
    "income": """
SELECT ticker_usd, p AS fecha_balance, net / 10000e0 AS ingresos, ed * 10 / 10000e0 AS costo_ingresos, (net - ed * 10) / 10000e0 AS beneficio_bruto,
       et * 10 / 10000e0 AS gastos_operativos, (net - ed * 10 - et * 10) / 10000e0 AS ganancia_neta,
       (net - ed * 10 - et * 10) * 100e0 / nullif(net, 0) AS margen_neto_pct
FROM lines_year""",
    "balances": """
SELECT ticker_usd, p AS fecha_balance, et_open * 20 / 10000e0 AS deuda_total, e_ret / 100e0 AS efectivo, (e * 6 - ed) / 10000e0 AS flujo_caja_libre
FROM lines_year""",
    "eps": """
SELECT ticker_usd, p + 40 AS fecha_reporte, (n * 7 - t) / CAST(n AS DOUBLE) AS eps_estimado,
       CASE WHEN p < (SELECT max(p) FROM lines_quarter) THEN (n * 7 - d) / CAST(n AS DOUBLE) END AS eps_reportado,
       CASE WHEN p < (SELECT max(p) FROM lines_quarter)
            THEN ((n * 7 - d) / CAST(n AS DOUBLE) - (n * 7 - t) / CAST(n AS DOUBLE)) / nullif(abs((n * 7 - t) / CAST(n AS DOUBLE)), 0) * 100 END AS sorpresa_pct
FROM lines_quarter""",
    "consensus": """
SELECT ticker_usd, p AS fecha, e / 100e0 / q AS precio_objetivo_actual, e / 100e0 / q * 1.1e0 AS precio_objetivo_mediana,
       n_n % 5 AS rec_strong_buy, n_n % 7 AS rec_buy, n_a AS rec_hold, n_r % 7 AS rec_sell, n_r % 5 AS rec_strong_sell
FROM lines_year""",
    "news": """
SELECT 'S' || (d.doc_id % (SELECT count(*) FROM supplier)) AS ticker_usd, d.text AS titular, d.source AS fuente,
       DATE '2024-01-01' + CAST(n_chars % 30 AS INTEGER) AS fecha_publicacion,
       CASE WHEN toxic = 1 THEN 'negative' WHEN quality = 1 THEN 'positive' ELSE 'neutral' END AS sentimiento,
       n_chars % 100 / 100e0 AS score_sentimiento, d.doc_id AS orden
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
    "insider_trades": """
SELECT 'S' || (event_id % (SELECT count(*) FROM supplier)) AS ticker_usd, CAST(ts AS DATE) AS fecha, 'U' || user_id AS insider,
       CASE user_id % 7 WHEN 0 THEN 'Chief Executive Officer' WHEN 1 THEN 'CFO' WHEN 2 THEN 'Officer and Director' ELSE 'Director' END AS cargo,
       CASE event_type WHEN 'purchase' THEN 'Compra' WHEN 'signup' THEN 'Venta' ELSE 'Otro' END AS tipo,
       CAST(regexp_extract(props, '"k": *(\\d+)', 1) AS BIGINT) AS acciones,
       CAST(CAST(round(value * 100) AS BIGINT) * 10 AS DOUBLE) AS valor
FROM events""",
    "run_log": """
SELECT 'job' || (user_id % 10) AS script, ts AS inicio, CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS estado,
       CASE WHEN event_type = 'error' THEN 'event ' || event_id END AS error_detalle
FROM events""",
    "adr": """
SELECT b.ticker_usd, d.ticker_adr_usa AS ticker_adr, fecha, close * (100 + volume % 7) / 200e0 AS close, adj_close / 2 AS adj_close, volume
FROM bars b JOIN dim d ON d.ticker_usd = b.ticker_usd WHERE d.ticker_adr_usa IS NOT NULL""",
    "panel": """
SELECT 'P' || CAST(floor(p_partkey / 3e0) AS BIGINT) || CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'C' ELSE 'D' END AS simbolo,
       CASE WHEN p_size < 4 THEN p_name || ' ' || p_type || ' ' || p_brand || ' ETF'
            ELSE substr(p_name || ' ' || p_type || ' ' || p_brand, 1, CAST(p_partkey % 23 + 8 AS INTEGER)) END AS descripcion
FROM part""",
    "watch": """
SELECT ticker_usd, DATE '2001-01-02' AS desde, lo + (hi - lo) * 0.02e0 AS nivel_soporte, lo + (hi - lo) * 0.5e0 AS nivel_resistencia,
       lo * 1.05e0 AS nivel_salida, CAST(substr(ticker_usd, 2) AS BIGINT) % 5 <> 4 AS activo,
       CASE WHEN CAST(substr(ticker_usd, 2) AS BIGINT) % 2 = 0 THEN 'USDBRL' END AS moneda
FROM (SELECT ticker_usd, min(adj_close) AS lo, max(adj_close) AS hi FROM bars GROUP BY 1)""",
    "saved": """
SELECT make_date(CAST(y AS INTEGER), 6, 30) AS fecha_seleccion, CASE WHEN k <= 9 THEN 'semanal' ELSE 'manual' END AS origen, ticker_usd,
       CASE WHEN k <= 9 THEN k ELSE k - 9 END AS puesto, precio_seleccion
FROM (SELECT *, row_number() OVER (PARTITION BY y ORDER BY v DESC, ticker_usd) AS k
      FROM (SELECT year(fecha) AS y, ticker_usd, sum(volume) AS v, arg_max(adj_close, fecha) AS precio_seleccion
            FROM bars WHERE month(fecha) <= 6 GROUP BY 1, 2))
WHERE k <= 18""",
    "swing_base": """
SELECT ticker_usd, fecha, adj_close AS x, umbral_pct, umbral_pct / 100 AS u, row_number() OVER (PARTITION BY ticker_usd ORDER BY fecha) AS i
FROM (SELECT *, least(greatest(5 * stddev_pop(lr) OVER (PARTITION BY ticker_usd) * 100, 8), 30) AS umbral_pct, count(*) OVER (PARTITION BY ticker_usd) AS n
      FROM (SELECT *, ln(adj_close) - ln(lag(adj_close) OVER (PARTITION BY ticker_usd ORDER BY fecha)) AS lr FROM bars WHERE adj_close > 0)) WHERE n >= 250""",
    "swing_walk": """
SELECT ticker_usd, i, 0 AS leg, i AS ih, x AS xh, i AS il, x AS xl, CAST(NULL AS VARCHAR) AS tipo, CAST(NULL AS BIGINT) AS ip FROM swing_base WHERE i = 1
UNION ALL
SELECT ticker_usd, i, CASE WHEN turn_h THEN -1 WHEN turn_l THEN 1 ELSE leg END, CASE WHEN turn_l THEN i ELSE ih END, CASE WHEN turn_l THEN x ELSE xh END,
       CASE WHEN turn_h THEN i ELSE il END, CASE WHEN turn_h THEN x ELSE xl END, CASE WHEN turn_h THEN 'H' WHEN turn_l THEN 'L' END, CASE WHEN turn_h THEN ih WHEN turn_l THEN il END
FROM (SELECT *, leg >= 0 AND x <= xh * (1 - u) AS turn_h, NOT (leg >= 0 AND x <= xh * (1 - u)) AND leg <= 0 AND x >= xl * (1 + u) AS turn_l
      FROM (SELECT b.ticker_usd, b.i, b.x, b.u, w.leg, CASE WHEN leg >= 0 AND b.x > xh THEN b.i ELSE ih END AS ih, CASE WHEN leg >= 0 AND b.x > xh THEN b.x ELSE xh END AS xh,
                   CASE WHEN leg <= 0 AND b.x < xl THEN b.i ELSE il END AS il, CASE WHEN leg <= 0 AND b.x < xl THEN b.x ELSE xl END AS xl
            FROM swing_walk w JOIN swing_base b ON b.ticker_usd = w.ticker_usd AND b.i = w.i + 1))""",
    "pivots": """
SELECT w.ticker_usd, row_number() OVER (PARTITION BY w.ticker_usd ORDER BY w.i) AS nro_pivot, p.fecha, p.x AS precio, w.tipo, c.fecha AS fecha_confirmacion
FROM swing_walk w JOIN swing_base p ON p.ticker_usd = w.ticker_usd AND p.i = w.ip JOIN swing_base c ON c.ticker_usd = w.ticker_usd AND c.i = w.i WHERE w.tipo IS NOT NULL""",
    "labelled_pivots": """
SELECT *, CASE WHEN tipo = 'H' AND c > a AND d > b AND e > b AND f > d AND NOT (d - c < b - a AND d - c < f - e) THEN 'Impulso alcista completo'
               WHEN tipo = 'L' AND c < a AND d < b AND e < b AND f < d AND NOT (c - d < a - b AND c - d < e - f) THEN 'Impulso bajista completo'
               WHEN tipo = 'L' AND d > b AND e > c AND f > c THEN 'Ondas 1-4 alcistas, 5 en curso' WHEN tipo = 'H' AND d < b AND e < c AND f < c THEN 'Ondas 1-4 bajistas, 5 en curso' END AS elliott_senal
FROM (SELECT *, ln(precio) AS f, ln(lag(precio, 1) OVER w) AS e, ln(lag(precio, 2) OVER w) AS d, ln(lag(precio, 3) OVER w) AS c, ln(lag(precio, 4) OVER w) AS b, ln(lag(precio, 5) OVER w) AS a
      FROM pivots WINDOW w AS (PARTITION BY ticker_usd ORDER BY nro_pivot))""",
    "swing_state": """
SELECT *, (last - actual) / nullif(last - prev, 0) * 100 AS back FROM (
  SELECT p.ticker_usd, count(*) AS total, arg_max(tipo, nro_pivot) AS tipo, arg_max(precio, nro_pivot) AS last, arg_max(previo, nro_pivot) AS prev, arg_max(coalesce(elliott_senal, 'Sin patrón'), nro_pivot) AS senal,
         max(s.actual) AS actual, max(s.fecha) AS fecha
  FROM (SELECT *, lag(precio) OVER (PARTITION BY ticker_usd ORDER BY nro_pivot) AS previo FROM labelled_pivots) p
  JOIN (SELECT ticker_usd, arg_max(x, fecha) AS actual, max(fecha) AS fecha FROM swing_base GROUP BY 1) s ON s.ticker_usd = p.ticker_usd GROUP BY 1) WHERE total >= 2""",
    "top5": """
SELECT ticker_usd, row_number() OVER (ORDER BY v DESC, ticker_usd) - 1 AS i
FROM (SELECT 'S' || l_suppkey AS ticker_usd, CAST(sum(l_quantity) AS BIGINT) AS v FROM lineitem GROUP BY 1)
QUALIFY i < 5""",
}
