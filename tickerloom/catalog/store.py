"""Queries that go through the warehouse and streams and read back what was stored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.catalog.base import QUERIES, query
from tickerloom.catalog.merges import CUT
from tickerloom.operators import monitor as MO
from tickerloom.operators import portfolio as P
from tickerloom.plans import merge as G
from tickerloom.plans import runlog as L
from tickerloom.sources import adapters as A
from tickerloom.sources import sinks
from tickerloom.sources.scratch import scratch
from tickerloom.sources.warehouse import Warehouse
from tickerloom.streaming import ingest as I

PRICES = "fact_precios_daily"


def _store(spark, name: str = "store") -> Warehouse:
    return Warehouse(spark, scratch(spark, name))


@query("store_upsert", "ticker_usd fecha close:f6 volume:i", QUERIES["upsert_overwrite"].body)
def store_upsert(spark, sf):
    """The merge of ``upsert_overwrite`` through a stored table: only the years of the batch are rewritten."""
    wh = _store(spark)
    b = wh.publish("bars", A.bars(spark, sf).select("ticker_usd", "fecha", "close", "volume"))
    wh.rewrite(PRICES, b.filter(F.col("fecha") < F.lit(CUT).cast("date")))
    inc = b.filter(F.col("fecha") >= F.lit("2001-01-01").cast("date")).withColumn("close", F.col("close") * 2)
    wh.upsert(PRICES, inc.withColumn("volume", F.when(F.col("volume") > 30, F.col("volume"))))
    return wh.read(PRICES)


@query("store_upsert_coalesce", "ticker_usd fecha margen_neto_pct:f6 roe_pct:f6 crecimiento_ingresos_anual_pct:f6", QUERIES["upsert_coalesce"].body)
def store_upsert_coalesce(spark, sf):
    """Two writers of one stored table, the second in two batches of which one is delivered twice."""
    wh, m = _store(spark), A.metrics(spark, sf)
    table = "fact_metrics_daily"
    wh.upsert(table, m.filter(F.month("fecha") != 2).select("ticker_usd", "fecha", "margen_neto_pct", "crecimiento_ingresos_anual_pct"))
    changed = F.when(F.month("fecha") == 4, F.col("margen_neto_pct") + 1).alias("margen_neto_pct")
    inc = m.filter(F.month("fecha") != 3).select("ticker_usd", "fecha", changed, "roe_pct")
    for number, part in ((0, inc.filter(F.month("fecha") <= 6)), (1, inc.filter(F.month("fecha") > 6)), (1, inc.withColumn("roe_pct", F.lit(-1.0)))):
        wh.upsert(table, part, G.upsert_coalesce, stream=("second", number))
    return wh.read(table)


@query("store_purge", "ticker_usd fecha close:f6", QUERIES["purge_universe"].body)
def store_purge(spark, sf):
    """Companies that left the universe are gone from every stored table; found through the key summaries."""
    wh, d = _store(spark), A.dim(spark, sf)
    wh.rewrite("dim_empresa", d)
    wh.rewrite(PRICES, A.bars(spark, sf))
    wh.rewrite("fact_metrics_daily", A.metrics(spark, sf))
    wh.purge_rows(d.filter(~F.col("nombre_empresa").like("%33")))
    return wh.read(PRICES)


@query(
    "store_key_summary",
    "tabla anio:i ticker_usd",
    """SELECT DISTINCT 'fact_precios_daily' AS tabla, year(fecha) AS anio, ticker_usd FROM bars
UNION ALL SELECT DISTINCT 'fact_metrics_daily', year(fecha), ticker_usd FROM metrics""",
)
def store_key_summary(spark, sf):
    """Which companies occur in which year of which table, from the summaries beside the data."""
    wh = _store(spark)
    wh.rewrite(PRICES, A.bars(spark, sf))
    wh.rewrite("fact_metrics_daily", A.metrics(spark, sf))
    return wh.keys(PRICES).unionByName(wh.keys("fact_metrics_daily"))


@query("store_slice_replace", "fecha_seleccion origen ticker_usd puesto:i", QUERIES["slice_replace"].body)
def store_slice_replace(spark, sf):
    """A slice that comes again replaces the stored one, and the same batch delivered again does nothing."""
    wh, s = _store(spark), A.saved_portfolios(spark, sf)
    table = "fact_cartera_seleccionada"
    wh.rewrite(table, s)
    manual = s.filter((F.col("origen") == "manual") & (F.year("fecha_seleccion") >= 1999) & (F.col("puesto") <= 4))
    for number, shift in ((0, 50), (1, 100), (0, 7)):
        wh.replace_slices(table, manual.withColumn("puesto", F.col("puesto") + shift), ["fecha_seleccion", "origen"], stream=("manual", number))
    return wh.read(table)


@query("store_run_log", "script ultima_corrida ultima_corrida_ok errores_totales:i", QUERIES["run_status"].body)
def store_run_log(spark, sf):
    """Runs appended day by day as they happen; the state of every job comes from the stored log."""
    wh, log = _store(spark), A.run_log(spark, sf)
    odd = F.dayofmonth("inicio") % 2 == 1
    for part in (log.filter(odd), log.filter(~odd)):
        wh.append("log_ejecuciones", part)
    out = L.run_status(wh.read("log_ejecuciones"))
    return out.select("script", *[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("ultima_corrida", "ultima_corrida_ok")], "errores_totales")


@query("gold_replaced", "ticker_usd fecha roe_pct:f6", "SELECT ticker_usd, fecha, roe_pct FROM metrics WHERE roe_pct IS NOT NULL")
def gold_replaced(spark, sf):
    """A gold table and a view written twice: readers see the second state whole."""
    wh, m = _store(spark), A.metrics(spark, sf).select("ticker_usd", "fecha", "roe_pct")
    wh.publish("gold_roe", m)
    sinks.publish_view(wh.published("gold_roe"), "gold_roe_vista")
    wh.publish("gold_roe", m.filter(F.col("roe_pct").isNotNull()))
    sinks.publish_view(wh.published("gold_roe"), "gold_roe_vista")
    return spark.table("gold_roe_vista")


# -- reports of the follow-up


def _monitored(spark, sf) -> DataFrame:
    return QUERIES["monitor_portfolio"].build(spark, sf)


@query("alert_file", "origen ticker_usd alertas:i", f"SELECT 'cartera' AS origen, ticker_usd, n_alertas AS alertas FROM ({QUERIES['monitor_portfolio'].body}) AS m WHERE n_alertas > 0")
def alert_file(spark, sf):
    """The alerts of the day as JSON lines, read back: one line per reason."""
    folder = scratch(spark, "alerts")
    sinks.write_alerts(sinks.alert_rows(_monitored(spark, sf), "cartera"), folder)
    lines = spark.read.schema("origen string, ticker_usd string, alerta string").json(folder)
    return lines.filter(F.col("alerta") != "").groupBy("origen", "ticker_usd").agg(F.count("*").alias("alertas"))


@query(
    "portfolio_mean", "promedio_pct:f4 con_alerta:i",
    f"SELECT avg(desde_seleccion_pct) AS promedio_pct, count(*) FILTER (WHERE n_alertas > 0) AS con_alerta FROM ({QUERIES['monitor_portfolio'].body}) AS m",
)
def portfolio_mean(spark, sf):
    return MO.portfolio_mean(_monitored(spark, sf))


@query(
    "portfolio_verdict", "carteras:i gana_pct:f4 diferencia_mediana_pp:f4",
    f"""SELECT count(*) AS carteras, avg(CASE WHEN vs_universo_pp > 0 THEN 1e0 ELSE 0e0 END) * 100 AS gana_pct, median(vs_universo_pp) AS diferencia_mediana_pp
FROM ({QUERIES['evaluate_portfolios'].body}) AS e WHERE dias >= 63""",
)
def portfolio_verdict(spark, sf):
    return P.verdict(QUERIES["evaluate_portfolios"].build(spark, sf))


# -- streams over the files there are, against the batch answer


def _files(df: DataFrame, file_format: str, n: int | None = 4) -> str:
    """Files of a stream, ``n`` of them; without a number they are of one size and become more as the rows do."""
    folder = scratch(df.sparkSession, "stream")
    (df.repartition(n) if n else df.hint("rebalance")).write.format(file_format).save(folder)
    return folder


@query("stream_upsert", "ticker_usd fecha close:f6 volume:i", "SELECT ticker_usd, fecha, close, volume FROM bars")
def stream_upsert(spark, sf):
    """Price files as a stream of small batches into the store; started again on the same checkpoint it finds nothing to do."""
    wh, checkpoint = _store(spark), scratch(spark, "checkpoint")
    folder = _files(A.bars(spark, sf).select("ticker_usd", "fecha", "close", "volume"), "json")
    for _ in range(2):
        stream = I.file_stream(spark, folder, "ticker_usd string, fecha date, close double, volume bigint", max_files=2)
        I.upsert_stream(stream, wh, PRICES, checkpoint).awaitTermination()
    return wh.read(PRICES)


NEWS = "ticker_usd string, titular string, sentimiento string, score_sentimiento double, fecha_publicacion timestamp"


def _news_stream(spark, sf) -> DataFrame:
    news = A.news(spark, sf).select("ticker_usd", "titular", "sentimiento", "score_sentimiento", F.col("fecha_publicacion").cast("timestamp").alias("fecha_publicacion"))
    return I.file_stream(spark, _files(news, "parquet", n=None), NEWS, "parquet")


def _drained(stream: DataFrame) -> DataFrame:
    """What a stream in append mode has written when its files are read."""
    spark, folder = stream.sparkSession, scratch(stream.sparkSession, "sink")
    writer = stream.writeStream.format("parquet").outputMode("append").option("path", folder).option("checkpointLocation", scratch(spark, "checkpoint"))
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(folder)


@query("stream_headlines", "ticker_usd titular", "SELECT DISTINCT ticker_usd, titular FROM news")
def stream_headlines(spark, sf):
    """Each headline of a company once, as long as its copies come within the watermark."""
    return _drained(I.fresh_headlines(_news_stream(spark, sf), "60 days").select("ticker_usd", "titular"))


@query(
    "stream_sentiment",
    "ticker_usd hasta sent_titulares_total:i sent_positivas:i sent_negativas:i sent_neutrales:i sent_score_promedio:f6 sent_clasificacion",
    """
SELECT *, CASE WHEN sent_score_promedio >= 0.15 THEN 'Positivo' WHEN sent_score_promedio <= -0.15 THEN 'Negativo' ELSE 'Neutral/Mixto' END AS sent_clasificacion
FROM (SELECT ticker_usd, CAST(fecha_publicacion + i AS DATE) AS hasta, count(*) AS sent_titulares_total, count(*) FILTER (WHERE sentimiento = 'positive') AS sent_positivas,
             count(*) FILTER (WHERE sentimiento = 'negative') AS sent_negativas, count(*) FILTER (WHERE sentimiento = 'neutral') AS sent_neutrales,
             avg(CASE sentimiento WHEN 'positive' THEN score_sentimiento WHEN 'negative' THEN -score_sentimiento ELSE 0 END) AS sent_score_promedio
      FROM news, (SELECT CAST(unnest(range(8)) AS INTEGER) AS i) GROUP BY 1, 2) WHERE hasta <= (SELECT max(fecha_publicacion) FROM news) - 2""",
)
def stream_sentiment(spark, sf):
    """The tone of every closed window: a window is written once, when the watermark (a day behind the newest headline) has passed its end."""
    return _drained(I.sliding_sentiment(_news_stream(spark, sf)))
