"""The model's tables derived from the provided star schema, events, documents and labels.

Ratios and statements are built from whole cents and whole percents summed as integers, so they do not depend
on the order in which rows arrive. Every adapter rolls its source up by (entity, date) first; a hot supplier is
reduced on the map side to at most one row per date.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickerloom.functions.expr import ratio
from tickerloom.schemas import METRIC_COLUMNS

SERIES_BY_PRIORITY = {
    "1-URGENT": "SP500", "2-HIGH": "UST10Y", "3-MEDIUM": "USDBRL", "4-NOT SPECIFIED": "UST30Y", "5-LOW": "VIX",
}
MARKET_BY_REGION = {"AFRICA": "argentina_local", "AMERICA": "usa_otros", "ASIA": "brasil", "EUROPE": "etf", "MIDDLE EAST": "cripto"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _whole(c: str, scale: int = 100) -> Column:
    return F.round(F.col(c) * scale).cast("long")


def ticker(key: str | Column) -> Column:
    return F.concat(F.lit("S"), (F.col(key) if isinstance(key, str) else key).cast("string"))


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fact_precios_daily: supplier-days of lineitem, open and close by line order within the day."""
    order = (F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 1048576 + F.col("l_partkey") % 1048576
    px = F.col("l_extendedprice") / F.col("l_quantity")
    lines = table(spark, sf_dir, "lineitem").select(
        ticker("l_suppkey").alias("ticker_usd"), F.to_date("l_shipdate").alias("fecha"), px.alias("px"), order.alias("o"),
        "l_quantity", "l_discount",
    )
    return lines.groupBy("ticker_usd", "fecha").agg(
        F.min_by("px", "o").alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", "o").alias("close"),
        F.max_by(F.col("px") * (1 - F.col("l_discount")), "o").alias("adj_close"),
        F.sum("l_quantity").cast("long").alias("volume"),
    )


def n_traded(spark: SparkSession, sf_dir: str) -> int:
    """About how many suppliers have bars, from one column of lineitem rather than from the rolled-up bars."""
    return table(spark, sf_dir, "lineitem").agg(F.approx_count_distinct("l_suppkey")).first()[0]


def last_day(spark: SparkSession, sf_dir: str) -> Column:
    """Newest bar date, from one column of lineitem rather than from the rolled-up bars."""
    return table(spark, sf_dir, "lineitem").agg(F.to_date(F.max("l_shipdate")).alias("d")).scalar()


def last_news_day(spark: SparkSession, sf_dir: str) -> Column:
    newest = F.date_add(F.lit("2024-01-01").cast("date"), F.max(F.col("n_chars") % 30).cast("int"))
    return table(spark, sf_dir, "documents").agg(newest.alias("d")).scalar()


def last_event_day(spark: SparkSession, sf_dir: str) -> Column:
    return table(spark, sf_dir, "events").agg(F.to_date(F.max("ts")).alias("d")).scalar()


def dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    market = F.lit(None)
    for name, value in MARKET_BY_REGION.items():
        market = F.when(F.col("r_name") == name, value).otherwise(market)
    key = F.col("s_suppkey")
    joined = (
        table(spark, sf_dir, "supplier")
        .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .withColumn("mercado", market)
    )
    quote = F.when(F.col("mercado") == "argentina_local", "ARS").when(F.col("mercado") == "brasil", "BRL").otherwise("USD")
    none = F.lit(None).cast("string")
    return joined.select(
        ticker("s_suppkey").alias("ticker_usd"), ticker("s_suppkey").alias("ticker_cedear"), ticker("s_suppkey").alias("ticker_yahoo"),
        F.when((F.col("mercado") == "argentina_local") & (key % 2 == 0), F.concat(F.lit("A"), key.cast("string"))).alias("ticker_adr_usa"),
        "mercado", F.col("s_name").alias("nombre_empresa"), F.col("n_name").alias("sector"),
        F.when(key % 17 == 0, "NATION_0").alias("sector_corregido"), F.concat("n_name", F.lit("-"), (key % 3).cast("string")).alias("industria"),
        F.col("n_name").alias("pais_origen"), none.alias("modelo_negocio"), none.alias("lynch_category"),
        F.when(key % 11 != 0, quote).alias("moneda_cotizacion"), F.when(key % 4 == 0, "BRL").otherwise(quote).alias("moneda_balance"),
    )


def macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fact_macro_daily: mean order price per priority and day, in ten thousands."""
    serie = F.lit(None)
    for name, value in SERIES_BY_PRIORITY.items():
        serie = F.when(F.col("o_orderpriority") == name, value).otherwise(serie)
    return (
        table(spark, sf_dir, "orders")
        .select(serie.alias("serie"), F.to_date("o_orderdate").alias("fecha"), _whole("o_totalprice").alias("c"))
        .groupBy("serie", "fecha")
        .agg((F.sum("c") / F.count("*") / 1000000.0).alias("valor"))
    )


def _lines(spark: SparkSession, sf_dir: str, period: Column) -> DataFrame:
    """Integer sums of lineitem per supplier and period."""
    cents, disc, tax = _whole("l_extendedprice"), _whole("l_discount"), _whole("l_tax")
    rows = table(spark, sf_dir, "lineitem").select(
        ticker("l_suppkey").alias("ticker_usd"), period.alias("p"), cents.alias("e"), disc.alias("d"), tax.alias("t"),
        F.col("l_quantity").cast("long").alias("q"), "l_returnflag", "l_linestatus",
    )
    e, d, t = F.col("e"), F.col("d"), F.col("t")
    return rows.groupBy("ticker_usd", "p").agg(
        F.count("*").alias("n"), F.sum("e").alias("e"), F.sum("d").alias("d"), F.sum("t").alias("t"), F.sum("q").alias("q"),
        F.sum(e * (100 - d)).alias("net"), F.sum(e * d).alias("ed"), F.sum(e * t).alias("et"),
        F.sum(F.when(F.col("l_linestatus") == "O", e * t).otherwise(0)).alias("et_open"),
        F.sum(F.when(F.col("l_returnflag") == "R", e).otherwise(0)).alias("e_ret"),
        F.count_if(F.col("l_returnflag") == "N").alias("n_n"), F.count_if(F.col("l_returnflag") == "R").alias("n_r"),
        F.count_if(F.col("l_returnflag") == "A").alias("n_a"),
    )


def lines_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sums behind metrics and statements, for queries that read several of these."""
    return _lines(spark, sf_dir, F.to_date(F.date_trunc("month", "l_shipdate")))


def _by_year(spark: SparkSession, sf_dir: str, months: DataFrame | None) -> DataFrame:
    """Sums per supplier and year; years are added up from ``months`` where the caller has them."""
    if months is None:
        return _lines(spark, sf_dir, F.make_date(F.year("l_shipdate"), F.lit(12), F.lit(31)))
    sums = [c for c in months.columns if c not in ("ticker_usd", "p")]
    return months.groupBy("ticker_usd", F.make_date(F.year("p"), F.lit(12), F.lit(31)).alias("p")).agg(*[F.sum(c).alias(c) for c in sums])


def metrics(spark: SparkSession, sf_dir: str, months: DataFrame | None = None) -> DataFrame:
    """fact_metrics_daily: supplier-months; growth columns only every third month, holdings only in odd months, as two writers leave them."""
    m = lines_by_month(spark, sf_dir) if months is None else months
    n, d, t, q = F.col("n"), F.col("d"), F.col("t"), F.col("q")
    avg = lambda c: c / n
    month = F.month("p")
    values = {
        "market_cap": F.col("e") * 10.0,
        "enterprise_value": F.col("e") * 10.0 * (1 + (avg(t) - 4) * 0.6),
        "pe_trailing": ratio(n * 100.0, d),
        "peg_ratio": ratio(n * 100.0, d) / avg(q),
        "price_to_book": avg(q) / 20,
        "margen_neto_pct": F.when(month % 5 != 0, (avg(t) - 2) * 10),
        "margen_operativo_pct": (avg(d) - 3) * 10,
        "roe_pct": F.when(month % 4 != 0, avg(d) * 3),
        "deuda_patrimonio": avg(t) * 20,
        "razon_corriente": avg(d) * 0.3,
        "beta": avg(q) / 20,
        "insider_holding_pct": avg(d),
        "institutional_holding_pct": F.when(month % 2 == 1, avg(t) * 10),
        "dividend_yield_pct": avg(d) / 2,
        "shares_outstanding": q * 1000000.0,
        "crecimiento_ingresos_anual_pct": F.when(month % 3 == 0, (avg(d) - 4) * 10),
        "crecimiento_ganancia_anual_pct": F.when(month % 3 == 0, (avg(t) - 4.5) * 20),
        "aceleracion_ingresos_pct": F.when(month % 3 == 0, (avg(d) - avg(t)) * 5),
    }
    cols = []
    for c in METRIC_COLUMNS:
        kind = "int" if c == "trimestres_superando_estimado" else "double"
        cols.append(values.get(c, F.lit(None)).cast(kind).alias(c))
    return m.select("ticker_usd", F.col("p").alias("fecha"), *cols)


def income(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fact_income_statement_annual: supplier-years, in hundredths of cents summed as integers."""
    y = _lines(spark, sf_dir, F.make_date(F.year("l_shipdate"), F.lit(12), F.lit(31)))
    net, cost, spend = F.col("net"), F.col("ed") * 10, F.col("et") * 10
    money = lambda c: c / 10000.0
    profit = net - cost - spend
    return y.select(
        "ticker_usd", F.col("p").alias("fecha_balance"), money(net).alias("ingresos"), money(cost).alias("costo_ingresos"),
        money(net - cost).alias("beneficio_bruto"), money(spend).alias("gastos_operativos"), money(profit).alias("ganancia_neta"),
        ratio(profit * 100.0, net).alias("margen_neto_pct"),
    )


def eps_annual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return income(spark, sf_dir).select("ticker_usd", "fecha_balance", (F.col("ganancia_neta") / 1000).alias("eps"))


def balances(spark: SparkSession, sf_dir: str, months: DataFrame | None = None) -> DataFrame:
    y = _by_year(spark, sf_dir, months)
    return y.select(
        "ticker_usd", F.col("p").alias("fecha_balance"), (F.col("et_open") * 20 / 10000.0).alias("deuda_total"),
        (F.col("e_ret") / 100.0).alias("efectivo"), ((F.col("e") * 6 - F.col("ed")) / 10000.0).alias("flujo_caja_libre"),
    )


def eps_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fact_eps_trimestral: a report 40 days after each supplier-quarter; the newest quarter of all is still unreported."""
    q_end = F.date_sub(F.add_months(F.to_date(F.date_trunc("quarter", "l_shipdate")), 3), 1)
    q = _lines(spark, sf_dir, q_end)
    newest = table(spark, sf_dir, "lineitem").agg(F.date_sub(F.add_months(F.to_date(F.date_trunc("quarter", F.max("l_shipdate"))), 3), 1)).scalar()
    est, rep = (F.col("n") * 7 - F.col("t")) / F.col("n"), (F.col("n") * 7 - F.col("d")) / F.col("n")
    done = F.col("p") < newest
    return q.select(
        "ticker_usd", F.date_add("p", 40).alias("fecha_reporte"), est.alias("eps_estimado"), F.when(done, rep).alias("eps_reportado"),
        F.when(done, ratio(rep - est, F.abs(est)) * 100).alias("sorpresa_pct"),
    )


def consensus(spark: SparkSession, sf_dir: str, months: DataFrame | None = None) -> DataFrame:
    y = _by_year(spark, sf_dir, months)
    target = F.col("e") / 100.0 / F.col("q")
    i = lambda c: c.cast("int")
    return y.select(
        "ticker_usd", F.col("p").alias("fecha"), target.alias("precio_objetivo_actual"), (target * 0.8).alias("precio_objetivo_bajo"),
        (target * 1.3).alias("precio_objetivo_alto"), (target * 1.1).alias("precio_objetivo_mediana"),
        i(F.col("n_n") % 5).alias("rec_strong_buy"), i(F.col("n_n") % 7).alias("rec_buy"), i(F.col("n_a")).alias("rec_hold"),
        i(F.col("n_r") % 7).alias("rec_sell"), i(F.col("n_r") % 5).alias("rec_strong_sell"),
    )


def _n_suppliers(spark: SparkSession, sf_dir: str) -> Column:
    return table(spark, sf_dir, "supplier").agg(F.count("*")).scalar()


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fact_noticias: documents as headlines, labels as tone."""
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    tone = F.when(F.col("toxic") == 1, "negative").when(F.col("quality") == 1, "positive").otherwise("neutral")
    return d.join(lab, "doc_id", "left").select(
        ticker(F.col("doc_id") % _n_suppliers(spark, sf_dir)).alias("ticker_usd"), F.col("text").alias("titular"),
        F.col("source").alias("fuente"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("n_chars") % 30).cast("int")).alias("fecha_publicacion"),
        F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("link"), tone.alias("sentimiento"),
        (F.col("n_chars") % 100 / 100.0).alias("score_sentimiento"), F.col("doc_id").alias("orden"),
    )


def insiders(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "purchase", "Compra").when(F.col("event_type") == "signup", "Venta").otherwise("Otro")
    seat = F.col("user_id") % 7
    post = F.when(seat == 0, "Chief Executive Officer").when(seat == 1, "CFO").when(seat == 2, "Officer and Director").otherwise("Director")
    return e.select(
        ticker(F.col("event_id") % _n_suppliers(spark, sf_dir)).alias("ticker_usd"), F.to_date("ts").alias("fecha"),
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("insider"), post.alias("cargo"), kind.alias("tipo"),
        F.get_json_object("props", "$.k").cast("long").alias("acciones"), (_whole("value") * 10).cast("double").alias("valor"),
        F.col("event_type").alias("texto"),
    )


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    bad = F.col("event_type") == "error"
    return e.select(
        F.concat(F.lit("job"), (F.col("user_id") % 10).cast("string")).alias("script"), F.col("ts").alias("inicio"), F.col("ts").alias("fin"),
        F.when(bad, "error").otherwise("ok").alias("estado"), F.get_json_object("props", "$.k").cast("int").alias("filas_afectadas"),
        F.when(bad, F.concat(F.lit("event "), F.col("event_id").cast("string"))).alias("error_detalle"),
    )


def adr_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fact_precios_adr: the bars of suppliers with an ADR, at another price."""
    pairs = dim(spark, sf_dir).filter(F.col("ticker_adr_usa").isNotNull()).select("ticker_usd", F.col("ticker_adr_usa").alias("ticker_adr"))
    return bars(spark, sf_dir).join(pairs, "ticker_usd").select(
        "ticker_usd", "ticker_adr", "fecha", (F.col("close") * (100 + F.col("volume") % 7) / 200.0).alias("close"),
        (F.col("adj_close") / 2).alias("adj_close"), "volume",
    )


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed symbols with descriptions cut at varying lengths, three symbols (plain, C, D) per base."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    text = F.concat("p_name", F.lit(" "), "p_type", F.lit(" "), "p_brand", F.when(F.col("p_size") < 4, " ETF").otherwise(""))
    return p.select(
        F.concat(F.lit("P"), F.floor(k / 3).cast("string"), F.element_at(F.array(F.lit(""), F.lit("C"), F.lit("D")), (k % 3 + 1).cast("int"))).alias("simbolo"),
        F.when(F.col("p_size") < 4, text).otherwise(F.substring(text, F.lit(1), (k % 23 + 8).cast("int"))).alias("descripcion"),
    )


def watchlist(spark: SparkSession, sf_dir: str, prices: DataFrame | None = None) -> DataFrame:
    """Every supplier watched, with levels from its own price range (``prices``: the bars, if the caller has them already)."""
    levels = (bars(spark, sf_dir) if prices is None else prices).groupBy("ticker_usd").agg(F.min("adj_close").alias("lo"), F.max("adj_close").alias("hi"))
    key = F.substring("ticker_usd", 2, 20).cast("long")
    return levels.select(
        "ticker_usd", F.lit("2001-01-02").cast("date").alias("desde"), F.lit("seguir").alias("motivo"),
        (F.col("lo") + (F.col("hi") - F.col("lo")) * 0.02).alias("nivel_soporte"), (F.col("lo") + (F.col("hi") - F.col("lo")) * 0.5).alias("nivel_resistencia"),
        (F.col("lo") * 1.05).alias("nivel_salida"), (key % 5 != 4).alias("activo"),
        F.when(key % 2 == 0, "USDBRL").alias("moneda"),
    )


def saved_portfolios(spark: SparkSession, sf_dir: str, size: int = 9) -> DataFrame:
    """fact_cartera_seleccionada: at each mid-year the most traded suppliers of the half year ('semanal') and the next ones ('manual')."""
    half = (
        bars(spark, sf_dir)
        .filter(F.month("fecha") <= 6)
        .groupBy(F.year("fecha").alias("y"), "ticker_usd")
        .agg(F.sum("volume").alias("v"), F.max_by("adj_close", "fecha").alias("precio_seleccion"))
    )
    w = Window.partitionBy("y").orderBy(F.col("v").desc(), "ticker_usd")
    ranked = half.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= 2 * size)
    first = F.col("k") <= size
    return ranked.select(
        F.make_date("y", F.lit(6), F.lit(30)).alias("fecha_seleccion"), F.when(first, "semanal").otherwise("manual").alias("origen"),
        "ticker_usd", F.when(first, F.col("k")).otherwise(F.col("k") - size).alias("puesto"), (F.col("v") * 1.0).alias("score_compuesto"),
        "precio_seleccion", F.lit(None).cast("string").alias("sector"), F.lit(None).cast("string").alias("region"),
        F.lit(None).cast("string").alias("alertas"),
    )


def _unit_price(lines: DataFrame, *keys: Column) -> DataFrame:
    cents, units = F.sum(_whole("l_extendedprice")), F.sum(F.col("l_quantity").cast("long"))
    return lines.groupBy(*keys).agg((cents / units / 100).alias("adj_close"))


def market_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a unit cost on average on each day, as one series."""
    day = F.to_date("l_shipdate").alias("fecha")
    return _unit_price(table(spark, sf_dir, "lineitem"), F.lit("MARKET").alias("ticker_usd"), day)


def _nation_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    home = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("ticker_usd"))
    return table(spark, sf_dir, "lineitem").join(home, F.col("l_suppkey") == F.col("s_suppkey"))


def nation_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price of a unit by nation of the supplier and month: few names that share nearly all dates."""
    return _unit_price(_nation_lines(spark, sf_dir), F.col("ticker_usd"), F.last_day("l_shipdate").alias("fecha"))


def most_traded_nations(spark: SparkSession, sf_dir: str, n: int) -> list[str]:
    """The ``n`` nations with the largest volume."""
    volume = _nation_lines(spark, sf_dir).groupBy("ticker_usd").agg(F.sum("l_quantity").cast("long").alias("v"))
    return [row.ticker_usd for row in volume.orderBy(F.col("v").desc(), "ticker_usd").limit(n).collect()]


def most_traded(spark: SparkSession, sf_dir: str, n: int = 5) -> list[str]:
    """The ``n`` suppliers with the largest volume: the portfolio the small-portfolio reports look at."""
    volume = table(spark, sf_dir, "lineitem").groupBy(ticker("l_suppkey").alias("t")).agg(F.sum("l_quantity").cast("long").alias("v"))
    return [row.t for row in volume.orderBy(F.col("v").desc(), "t").limit(n).collect()]
