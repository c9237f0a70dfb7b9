"""Queries over merges, guards, the run log and the universe of symbols."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tickerloom.catalog.base import query
from tickerloom.operators import universe as U
from tickerloom.plans import merge as G
from tickerloom.plans import runlog as L
from tickerloom.sources import adapters as A

CUT = "2001-06-01"


def _before(df, date="fecha", cut=CUT):
    return df.filter(F.col(date) < F.lit(cut).cast("date"))


def _from(df, date="fecha", cut=CUT):
    return df.filter(F.col(date) >= F.lit(cut).cast("date"))


@query(
    "upsert_overwrite",
    "ticker_usd fecha close:f6 volume:i",
    f"""
WITH inc AS (SELECT ticker_usd, CAST(fecha AS DATE) AS fecha, close * 2 AS close, CASE WHEN volume > 30 THEN volume END AS volume FROM bars WHERE fecha >= DATE '2001-01-01')
SELECT b.ticker_usd, b.fecha, b.close, b.volume FROM bars b WHERE fecha < DATE '{CUT}' AND NOT EXISTS (SELECT 1 FROM inc WHERE inc.ticker_usd = b.ticker_usd AND inc.fecha = b.fecha)
UNION ALL SELECT * FROM inc""",
)
def upsert_overwrite(spark, sf):
    b = A.bars(spark, sf).select("ticker_usd", "fecha", "close", "volume")
    inc = _from(b, cut="2001-01-01").withColumn("close", F.col("close") * 2).withColumn("volume", F.when(F.col("volume") > 30, F.col("volume")))
    return G.upsert_overwrite(_before(b), inc, ["ticker_usd", "fecha"])


@query(
    "upsert_coalesce",
    "ticker_usd fecha margen_neto_pct:f6 roe_pct:f6 crecimiento_ingresos_anual_pct:f6",
    """
WITH a AS (SELECT ticker_usd, fecha, margen_neto_pct, CAST(NULL AS DOUBLE) AS roe_pct, crecimiento_ingresos_anual_pct FROM metrics WHERE month(fecha) <> 2),
b AS (SELECT ticker_usd, fecha, CASE WHEN month(fecha) = 4 THEN margen_neto_pct + 1 END AS margen_neto_pct, roe_pct FROM metrics WHERE month(fecha) <> 3)
SELECT coalesce(a.ticker_usd, b.ticker_usd) AS ticker_usd, coalesce(a.fecha, b.fecha) AS fecha, coalesce(b.margen_neto_pct, a.margen_neto_pct) AS margen_neto_pct,
       coalesce(b.roe_pct, a.roe_pct) AS roe_pct, a.crecimiento_ingresos_anual_pct FROM a FULL JOIN b ON a.ticker_usd = b.ticker_usd AND a.fecha = b.fecha""",
)
def upsert_coalesce(spark, sf):
    m = A.metrics(spark, sf)
    stored = m.filter(F.month("fecha") != 2).select(
        "ticker_usd", "fecha", "margen_neto_pct", F.lit(None).cast("double").alias("roe_pct"), "crecimiento_ingresos_anual_pct"
    )
    inc = m.filter(F.month("fecha") != 3).select(
        "ticker_usd", "fecha", F.when(F.month("fecha") == 4, F.col("margen_neto_pct") + 1).alias("margen_neto_pct"), "roe_pct"
    )
    return G.upsert_coalesce(stored, inc, ["ticker_usd", "fecha"])


@query(
    "upsert_dimension",
    "ticker_usd nombre_empresa sector sector_corregido industria moneda_balance mercado",
    """
WITH inc AS (SELECT ticker_usd, upper(nombre_empresa) AS nombre_empresa, CASE WHEN k % 3 <> 0 THEN 'X-' || sector END AS sector, industria, mercado FROM dim WHERE k % 2 = 0),
st AS (SELECT * FROM dim WHERE k % 5 <> 0)
SELECT coalesce(st.ticker_usd, inc.ticker_usd) AS ticker_usd, coalesce(inc.nombre_empresa, st.nombre_empresa) AS nombre_empresa, coalesce(inc.sector, st.sector) AS sector,
       st.sector_corregido, coalesce(inc.industria, st.industria) AS industria, st.moneda_balance, coalesce(inc.mercado, st.mercado) AS mercado
FROM st FULL JOIN inc ON st.ticker_usd = inc.ticker_usd""",
)
def upsert_dimension(spark, sf):
    d = A.dim(spark, sf)
    key = F.substring("ticker_usd", 2, 20).cast("long")
    inc = d.filter(key % 2 == 0).select(
        "ticker_usd", "ticker_cedear", "ticker_yahoo", "ticker_adr_usa", "mercado", F.upper("nombre_empresa").alias("nombre_empresa"),
        F.when(key % 3 != 0, F.concat(F.lit("X-"), "sector")).alias("sector"), "industria", "pais_origen",
    )
    stored = d.filter(key % 5 != 0).withColumn("variantes", F.lit(None).cast("string")).withColumn("actualizado_en", F.lit(None).cast("timestamp"))
    return G.upsert_dimension(stored, inc)


@query(
    "slice_replace",
    "fecha_seleccion origen ticker_usd puesto:i",
    """SELECT fecha_seleccion, origen, ticker_usd, puesto FROM saved WHERE NOT (origen = 'manual' AND year(fecha_seleccion) >= 1999)
UNION ALL SELECT fecha_seleccion, origen, ticker_usd, puesto + 100 FROM saved WHERE origen = 'manual' AND year(fecha_seleccion) >= 1999 AND puesto <= 4""",
)
def slice_replace(spark, sf):
    s = A.saved_portfolios(spark, sf)
    inc = s.filter((F.col("origen") == "manual") & (F.year("fecha_seleccion") >= 1999) & (F.col("puesto") <= 4)).withColumn("puesto", F.col("puesto") + 100)
    return G.replace_slice(s, inc, ["fecha_seleccion", "origen"])


@query(
    "weekly_save_once",
    "fecha_seleccion origen ticker_usd puesto:i",
    """SELECT fecha_seleccion, origen, ticker_usd, puesto FROM saved
UNION ALL SELECT fecha_seleccion + 20, origen, ticker_usd, puesto FROM saved WHERE origen = 'semanal' AND year(fecha_seleccion) <= 1997""",
)
def weekly_save_once(spark, sf):
    s = A.saved_portfolios(spark, sf).filter(F.lit(True))
    weekly = s.filter(F.col("origen") == "semanal")
    same = weekly.withColumn("puesto", F.col("puesto") + 50)
    later = weekly.filter(F.year("fecha_seleccion") <= 1997).withColumn("fecha_seleccion", F.date_add("fecha_seleccion", 20))
    return G.save_portfolio(s, same.unionByName(later))


@query(
    "sector_overlay",
    "ticker_usd sector sector_corregido efectivo",
    """SELECT ticker_usd, sector, CASE WHEN c THEN 'Financial Services' ELSE sector_corregido END AS sector_corregido,
       coalesce(CASE WHEN c THEN 'Financial Services' ELSE sector_corregido END, sector) AS efectivo
FROM (SELECT *, nombre_empresa LIKE '%7' AS c FROM dim)""",
)
def sector_overlay(spark, sf):
    d = A.dim(spark, sf)
    fixes = d.filter(F.col("nombre_empresa").like("%7")).select("ticker_usd", F.lit("Financial Services").alias("sector_corregido"))
    out = G.overlay(d, fixes, "ticker_usd", "sector_corregido")
    return out.withColumn("efectivo", F.coalesce("sector_corregido", "sector"))


def _purge(spark, sf, universe):
    facts = {"fact_precios_daily": A.bars(spark, sf), "fact_metrics_daily": A.metrics(spark, sf)}
    return G.purge_universe(A.dim(spark, sf), facts, universe)


@query("purge_universe", "ticker_usd fecha close:f6", "SELECT ticker_usd, fecha, close FROM bars WHERE ticker_usd NOT IN (SELECT ticker_usd FROM dim WHERE nombre_empresa LIKE '%33')")
def purge_universe(spark, sf):
    keep = A.dim(spark, sf).filter(~F.col("nombre_empresa").like("%33"))
    return _purge(spark, sf, keep)[1]["fact_precios_daily"]


@query("purge_removed", "ticker_usd", "SELECT ticker_usd FROM dim WHERE nombre_empresa LIKE '%33'")
def purge_removed(spark, sf):
    keep = A.dim(spark, sf).filter(~F.col("nombre_empresa").like("%33"))
    return _purge(spark, sf, keep)[2]


@query("purge_safety_valve", "ticker_usd fecha close:f6", "SELECT ticker_usd, fecha, close FROM bars")
def purge_safety_valve(spark, sf):
    half = A.dim(spark, sf).filter(F.col("mercado") == "usa_otros")
    return _purge(spark, sf, half)[1]["fact_precios_daily"]


@query(
    "watch_changes",
    "ticker_usd desde motivo nivel_soporte:f6 activo:b",
    """
WITH b AS (SELECT *, CAST(substr(ticker_usd, 2) AS BIGINT) AS k, 'seguir' AS motivo FROM watch)
SELECT ticker_usd, CASE WHEN k % 4 = 0 THEN DATE '2001-10-01' ELSE desde END AS desde, CASE WHEN k % 3 = 0 THEN 'nuevo' ELSE motivo END AS motivo,
       CASE WHEN k % 3 = 0 THEN nivel_soporte * 2 ELSE nivel_soporte END AS nivel_soporte, CASE WHEN k % 3 = 0 THEN true ELSE activo END AND ticker_usd NOT IN ('S1', 'S2') AS activo
FROM b WHERE k % 4 <> 0 OR k % 3 = 0""",
)
def watch_changes(spark, sf):
    w = A.watchlist(spark, sf)
    key = F.substring("ticker_usd", 2, 20).cast("long")
    entries = w.filter(key % 3 == 0).select(
        F.lower("ticker_usd").alias("ticker_usd"), F.lit("2001-10-01").cast("date").alias("desde"), F.lit("nuevo").alias("motivo"),
        (F.col("nivel_soporte") * 2).alias("nivel_soporte"), "nivel_resistencia", "nivel_salida", "moneda",
    )
    out = G.watch_add(w.filter(key % 4 != 0), entries, A.dim(spark, sf))
    return G.watch_remove(out, ["s1", "S2"])


@query(
    "run_status",
    "script ultima_corrida ultima_corrida_ok errores_totales:i",
    """SELECT script, strftime(max(inicio), '%Y-%m-%d %H:%M:%S') AS ultima_corrida, strftime(max(inicio) FILTER (WHERE estado = 'ok'), '%Y-%m-%d %H:%M:%S') AS ultima_corrida_ok,
       count(*) FILTER (WHERE estado = 'error') AS errores_totales FROM run_log GROUP BY 1""",
)
def run_status(spark, sf):
    out = L.run_status(A.run_log(spark, sf))
    return out.select(
        "script", *[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("ultima_corrida", "ultima_corrida_ok")], "errores_totales"
    )


@query("last_errors", "script error_detalle", "SELECT script, error_detalle FROM run_log WHERE estado = 'error' ORDER BY inicio DESC, script LIMIT 5")
def last_errors(spark, sf):
    return L.last_errors(A.run_log(spark, sf))


@query("ran_today", "script corridas_ok:i", "SELECT script, count(*) AS corridas_ok FROM run_log WHERE estado = 'ok' AND inicio >= DATE '2024-01-30' GROUP BY 1")
def ran_today(spark, sf):
    return L.ran_since(A.run_log(spark, sf), dt.date(2024, 1, 30))


@query("ran_recently", "script corridas_ok:i", "SELECT script, count(*) AS corridas_ok FROM run_log WHERE estado = 'ok' AND inicio >= DATE '2024-01-28' GROUP BY 1")
def ran_recently(spark, sf):
    return L.ran_since(A.run_log(spark, sf), dt.date(2024, 1, 30), days=2)


PANEL_SQL = r"""
named AS (SELECT *, regexp_replace(lower(empresa), '[^a-z0-9]', '', 'g') AS clave
          FROM (SELECT *, trim(regexp_replace(trim(regexp_replace(descripcion, '(?i)^cedear\s+', '')), '[.,]+$', '')) AS empresa FROM panel)),
keys AS (SELECT DISTINCT clave FROM named),
grp AS (SELECT k.clave, coalesce((SELECT arg_min(h.clave, length(h.clave)) FROM keys h WHERE length(h.clave) >= 6 AND starts_with(k.clave, h.clave)), k.clave) AS grupo FROM keys k)"""


@query(
    "dedup_components",
    "grupo ticker empresa n_variantes:i",
    f"""
WITH {PANEL_SQL}
SELECT grupo, arg_min(simbolo, ROW(length(simbolo), simbolo)) AS ticker, arg_min(empresa, ROW(-length(empresa), empresa)) AS empresa, count(*) AS n_variantes
FROM named JOIN grp ON grp.clave = named.clave GROUP BY 1""",
)
def dedup_components(spark, sf):
    return U.dedup_companies(A.panel(spark, sf))


@query("prefix_groups", "clave grupo", f"WITH {PANEL_SQL} SELECT * FROM grp")
def prefix_groups(spark, sf):
    p = A.panel(spark, sf)
    named = p.withColumn("clave", U.grouping_key(U.company_name(F.col("descripcion"))))
    return U.prefix_groups(named)


ETF_SQL = r"""
et AS (SELECT simbolo FROM panel WHERE regexp_matches(descripcion, '(?i)\betf\b|select sector|spdr|ishares|invesco|proshares|direxion|van eck|vanguard|global x|\bipath\b|\btrust\b|\bfund\b')
       UNION SELECT unnest(['XLCC', 'XLYC', 'XLYD'])),
ba AS (SELECT DISTINCT CASE WHEN right(simbolo, 1) IN ('C', 'D') AND substr(simbolo, 1, length(simbolo) - 1) IN (SELECT simbolo FROM et) THEN substr(simbolo, 1, length(simbolo) - 1)
                            WHEN simbolo = 'XLCC' THEN 'XLC' WHEN simbolo IN ('XLYC', 'XLYD') THEN 'XLY' ELSE simbolo END AS b FROM et)"""


IS_ETF = """(simbolo IN (SELECT simbolo FROM et) OR simbolo IN (SELECT b FROM ba)
       OR (right(simbolo, 1) IN ('C', 'D') AND substr(simbolo, 1, length(simbolo) - 1) IN (SELECT b FROM ba)))"""
TITLE = "array_to_string(list_transform(string_split(lower({0}), ' '), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ')"
GROUP_SQL = r"""
{name}_named AS (SELECT *, regexp_replace(lower(empresa), '[^a-z0-9]', '', 'g') AS clave
          FROM (SELECT *, trim(regexp_replace(trim(regexp_replace(descripcion, '(?i)^cedear\s+', '')), '[.,]+$', '')) AS empresa FROM {source})),
{name}_keys AS (SELECT DISTINCT clave FROM {name}_named),
{name}_grp AS (SELECT k.clave, coalesce((SELECT arg_min(h.clave, length(h.clave)) FROM {name}_keys h WHERE length(h.clave) >= 6 AND starts_with(k.clave, h.clave)), k.clave) AS grupo FROM {name}_keys k),
{name}_dedup AS (SELECT arg_min(simbolo, ROW(length(simbolo), simbolo)) AS t, arg_min(empresa, ROW(-length(empresa), empresa)) AS e
          FROM {name}_named JOIN {name}_grp ON {name}_grp.clave = {name}_named.clave GROUP BY grupo)"""


@query(
    "etf_split",
    "simbolo descripcion es_etf:b",
    f"""
WITH {ETF_SQL}
SELECT simbolo, descripcion, simbolo IN (SELECT simbolo FROM et) OR simbolo IN (SELECT b FROM ba)
       OR (right(simbolo, 1) IN ('C', 'D') AND substr(simbolo, 1, length(simbolo) - 1) IN (SELECT b FROM ba)) AS es_etf FROM panel""",
)
def etf_split(spark, sf):
    return U.split_etfs(A.panel(spark, sf))


@query(
    "etf_rows",
    "ticker_usd mercado nombre_empresa variantes",
    f"""
WITH {ETF_SQL}, pe AS (SELECT *, {IS_ETF} AS es_etf FROM panel)
SELECT b AS ticker_usd, 'etf' AS mercado, {TITLE.format("trim(regexp_replace(trim(d), '[.,]+$', ''))")} AS nombre_empresa, variantes FROM (
  SELECT b, arg_min(descripcion, ROW(CASE WHEN simbolo = b THEN 0 ELSE 1 END, simbolo)) AS d, string_agg(simbolo, ', ' ORDER BY simbolo) AS variantes
  FROM (SELECT simbolo, descripcion, CASE WHEN right(simbolo, 1) IN ('C', 'D') AND substr(simbolo, 1, length(simbolo) - 1) IN (SELECT simbolo FROM pe WHERE es_etf)
                                         THEN substr(simbolo, 1, length(simbolo) - 1) ELSE simbolo END AS b FROM pe WHERE es_etf) GROUP BY 1)""",
)
def etf_rows(spark, sf):
    return U.etf_rows(U.split_etfs(A.panel(spark, sf)).filter("es_etf"))


@query(
    "universe_rows",
    "ticker_usd ticker_yahoo mercado nombre_empresa",
    f"""
WITH {ETF_SQL}, pe AS (SELECT *, {IS_ETF} AS es_etf FROM panel),
{GROUP_SQL.format(name='c', source='(SELECT simbolo, descripcion FROM pe WHERE NOT es_etf)')},
{GROUP_SQL.format(name='l', source="(SELECT 'L' || s_suppkey AS simbolo, s_name AS descripcion FROM supplier)")}
SELECT t AS ticker_usd, t AS ticker_yahoo, CASE WHEN regexp_matches(t, '\\d[A-Za-z]?$') THEN 'brasil' ELSE 'usa_otros' END AS mercado, {TITLE.format('e')} AS nombre_empresa FROM c_dedup
UNION ALL SELECT b, b, 'etf', {TITLE.format("trim(regexp_replace(trim(d), '[.,]+$', ''))")} FROM (
  SELECT b, arg_min(descripcion, ROW(CASE WHEN simbolo = b THEN 0 ELSE 1 END, simbolo)) AS d
  FROM (SELECT simbolo, descripcion, CASE WHEN right(simbolo, 1) IN ('C', 'D') AND substr(simbolo, 1, length(simbolo) - 1) IN (SELECT simbolo FROM pe WHERE es_etf)
                                         THEN substr(simbolo, 1, length(simbolo) - 1) ELSE simbolo END AS b FROM pe WHERE es_etf) GROUP BY 1)
UNION ALL SELECT t, t || '.BA', 'argentina_local', {TITLE.format('e')} FROM l_dedup
UNION ALL SELECT * FROM (VALUES ('BTC', 'BTC-USD', 'cripto', 'Bitcoin'), ('ETH', 'ETH-USD', 'cripto', 'Ethereum'), ('SOL', 'SOL-USD', 'cripto', 'Solana'))""",
)
def universe_rows(spark, sf):
    p = A.panel(spark, sf)
    local = A.table(spark, sf, "supplier").select(F.concat(F.lit("L"), F.col("s_suppkey").cast("string")).alias("simbolo"), F.col("s_name").alias("descripcion"))
    return U.universe(p, local, variants=False)


@query("market_filter", "ticker_usd mercado", "SELECT ticker_usd, mercado FROM dim WHERE mercado NOT IN ('cripto', 'etf')")
def market_filter(spark, sf):
    return U.has_fundamentals(A.dim(spark, sf))
