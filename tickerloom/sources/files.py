"""Downloaded files to fact rows: prices, series, quotes, ratios, statements, reports, insiders, consensus, headlines.

Each reader gives an explicit schema (nothing is inferred, no extra pass over the files) and each shape has its own
DataFrame function, so the same rows come out of a batch read and of a file stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickerloom.functions.expr import AsOf, ratio
from tickerloom.operators.news import recent_headlines
from tickerloom.schemas import conform

PRICE_SCHEMA = "Date string, Open double, High double, Low double, Close double, `Adj Close` double, Volume double"
SERIES_SCHEMA = "Date string, Close double"
QUOTE_SCHEMA = "casa string, compra double, venta double, fecha string"

# Quote houses and their series, snapshot fields and their columns, statement concepts and theirs.
QUOTE_SERIES = {
    "oficial": "AR_OFICIAL", "blue": "AR_BLUE", "bolsa": "AR_MEP", "contadoconliqui": "AR_CCL", "mayorista": "AR_MAYORISTA",
    "cripto": "AR_CRIPTO", "tarjeta": "AR_TARJETA",
}
FRACTION_FIELDS = {
    "grossMargins": "margen_bruto_pct", "operatingMargins": "margen_operativo_pct", "profitMargins": "margen_neto_pct",
    "returnOnEquity": "roe_pct", "returnOnAssets": "roa_pct", "payoutRatio": "payout_ratio_pct",
    "heldPercentInsiders": "insider_holding_pct", "heldPercentInstitutions": "institutional_holding_pct",
}
DIRECT_FIELDS = {
    "marketCap": "market_cap", "enterpriseValue": "enterprise_value", "trailingPE": "pe_trailing", "forwardPE": "pe_forward",
    "trailingPegRatio": "peg_ratio", "priceToBook": "price_to_book", "enterpriseToEbitda": "ev_ebitda",
    "debtToEquity": "deuda_patrimonio", "currentRatio": "razon_corriente", "dividendYield": "dividend_yield_pct", "beta": "beta",
    "sharesOutstanding": "shares_outstanding",
}
DIMENSION_FIELDS = {
    "sector": "sector", "industry": "industria", "country": "pais_origen", "currency": "moneda_cotizacion",
    "financialCurrency": "moneda_balance",
}
RESULT_CONCEPTS = {
    "Total Revenue": "ingresos", "Operating Income": "ganancia_operativa", "Net Income": "ganancia_neta",
    "Gain On Sale Of Security": "resultado_participaciones", "Total Unusual Items": "resultados_no_recurrentes",
    "Diluted EPS": "eps_diluido", "Diluted Average Shares": "acciones_diluidas",
}
CASH_CONCEPTS = {
    "Operating Cash Flow": "flujo_caja_operativo", "Free Cash Flow": "flujo_caja_libre",
    "Repurchase Of Capital Stock": "recompras", "Stock Based Compensation": "pagos_en_acciones",
}
INCOME_MAPS = {
    "ingresos_anuales": "ingresos", "costo_ingresos_anual": "costo_ingresos", "beneficio_bruto_anual": "beneficio_bruto",
    "gastos_operativos_anual": "gastos_operativos", "ganancia_anual": "ganancia_neta",
}
BALANCE_MAPS = {"deuda_anual": "deuda_total", "efectivo_anual": "efectivo", "fcf_anual": "flujo_caja_libre"}

_MAP = "map<string,double>"
SNAPSHOT_SCHEMA = "ticker string, info struct<" + ", ".join(
    [f"{c}:double" for c in [*FRACTION_FIELDS, *DIRECT_FIELDS]] + [f"{c}:string" for c in DIMENSION_FIELDS]
) + ">"
STATEMENT_SCHEMA = (
    "ticker string, " + ", ".join(f"{c} {_MAP}" for c in [*INCOME_MAPS, "eps_anual", *BALANCE_MAPS])
    + ", eps_trimestral array<struct<fecha:string, eps_estimado:double, eps_reportado:double, sorpresa_pct:double>>"
)
QUARTERLY_SCHEMA = f"resultados map<string,{_MAP}>, caja map<string,{_MAP}>"
CONSENSUS_SCHEMA = (
    "ticker string, targets struct<current:double, low:double, high:double, median:double>, "
    "recommendations array<struct<period:string, strongBuy:int, buy:int, hold:int, sell:int, strongSell:int>>"
)
INSIDER_SCHEMA = "`Shares` double, `Value` double, `Text` string, `Insider` string, `Position` string, `Start Date` string"
NEWS_SCHEMA = "title string, link string, pubDate string, source struct<_VALUE:string, _url:string>"


def file_stem() -> Column:
    """What a file is about: the value of the folder it was exported to (``key=value``), else its name without extension."""
    path = F.col("_metadata.file_path")
    folder = F.regexp_extract(path, r"/[^/=]+=([^/]+)/[^/]+$", 1)
    return F.when(folder != "", folder).otherwise(F.regexp_extract(path, r"([^/]+)\.[A-Za-z]+$", 1))


def utc_date(text: Column) -> Column:
    """UTC calendar date of a timestamp text with an offset (the session's zone is UTC)."""
    return F.to_date(F.try_to_timestamp(text))


# -- prices and series -------------------------------------------------------


def _csv(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("recursiveFileLookup", "true").csv(path)


def read_price_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Price CSVs, one file or folder per symbol: raw columns plus ``simbolo``."""
    return _csv(spark, path, PRICE_SCHEMA).withColumn("simbolo", file_stem())


def read_bulk_price_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Price CSVs of many symbols each, which their last column ``simbolo`` names: as many files as the rows need, however many symbols there are."""
    return _csv(spark, path, PRICE_SCHEMA + ", simbolo string")


def price_rows(raw: DataFrame, symbols: DataFrame) -> DataFrame:
    """fact_precios_daily from raw price rows; ``symbols``: ticker_usd, ticker_yahoo of the universe."""
    named = symbols.select("ticker_usd", F.regexp_replace("ticker_yahoo", "/", "_").alias("simbolo"))
    rows = raw.join(named, "simbolo").select(
        "ticker_usd", utc_date(F.col("Date")).alias("fecha"), F.col("Open").alias("open"), F.col("High").alias("high"),
        F.col("Low").alias("low"), F.col("Close").alias("close"), F.col("Adj Close").alias("adj_close"),
        F.col("Volume").cast("long").alias("volume"),
    )
    return conform(rows, "fact_precios_daily")


def adr_price_rows(raw: DataFrame, pairs: DataFrame) -> DataFrame:
    """fact_precios_adr: the ADR's prices under the local ticker; ``pairs``: ticker_usd, ticker_adr."""
    named = pairs.select("ticker_usd", "ticker_adr", F.regexp_replace("ticker_adr", "/", "_").alias("simbolo"))
    rows = raw.join(named, "simbolo").select(
        "ticker_usd", "ticker_adr", utc_date(F.col("Date")).alias("fecha"), F.col("Close").alias("close"),
        F.col("Adj Close").alias("adj_close"), F.col("Volume").cast("long").alias("volume"),
    )
    return conform(rows, "fact_precios_adr")


def read_series_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return _csv(spark, path, SERIES_SCHEMA).withColumn("serie", file_stem())


def series_rows(raw: DataFrame) -> DataFrame:
    """fact_macro_daily from series files; a bar still open has no close and is left out."""
    known = raw.filter(F.col("Close").isNotNull() & ~F.isnan("Close"))
    return conform(known.select("serie", utc_date(F.col("Date")).alias("fecha"), F.col("Close").alias("valor")), "fact_macro_daily")


def mid_quotes(quotes: DataFrame, series: dict[str, str] = QUOTE_SERIES) -> DataFrame:
    """fact_macro_daily from two-sided quotes: the mid, where both sides are known."""
    names = F.create_map(*[F.lit(x) for kv in series.items() for x in kv])
    both = quotes.filter(F.col("compra").isNotNull() & F.col("venta").isNotNull() & F.col("casa").isin(*series))
    return both.select(
        F.element_at(names, F.col("casa")).alias("serie"), F.to_date("fecha").alias("fecha"),
        F.round((F.col("compra") + F.col("venta")) / 2, 4).alias("valor"),
    )


# -- ratios and statements -----------------------------------------------------


def snapshot_metrics(snapshots: DataFrame, day: Column) -> DataFrame:
    """fact_metrics_daily columns of the daily writer: fractions as percent, the rest as they come."""
    info = lambda f: F.col(f"info.{f}")
    return snapshots.select(
        F.col("ticker").alias("ticker_usd"), day.alias("fecha"),
        *[F.round(info(f) * 100, 1).alias(c) for f, c in FRACTION_FIELDS.items()],
        *[F.round(info(f), 2).alias(c) for f, c in DIRECT_FIELDS.items()],
    )


def snapshot_dimension(snapshots: DataFrame, universe: DataFrame) -> DataFrame:
    """dim_empresa rows of the universe with the descriptive fields of the snapshot."""
    fields = snapshots.select(F.col("ticker").alias("ticker_usd"), *[F.col(f"info.{f}").alias(c) for f, c in DIMENSION_FIELDS.items()])
    return universe.drop(*DIMENSION_FIELDS.values()).join(fields, "ticker_usd")


def _dated_rows(statements: DataFrame, maps: dict[str, str]) -> DataFrame:
    """One row per ticker and date found in any of the date -> value maps."""
    keys = [F.coalesce(F.map_keys(m), F.array().cast("array<string>")) for m in maps]
    dates = F.array_distinct(F.concat(*keys))
    # the other maps stay beside the exploded date and are read by key: a full outer join without joining
    exploded = statements.select("ticker", *maps, F.explode(dates).alias("d"))
    return exploded.select(
        F.col("ticker").alias("ticker_usd"), F.to_date("d").alias("fecha_balance"),
        *[F.try_element_at(F.col(m), F.col("d")).alias(c) for m, c in maps.items()],
    )


def income_rows(statements: DataFrame) -> DataFrame:
    rows = _dated_rows(statements, INCOME_MAPS)
    return conform(
        rows.withColumn("margen_neto_pct", F.round(ratio("ganancia_neta", "ingresos") * 100, 1)), "fact_income_statement_annual"
    )


def balance_rows(statements: DataFrame) -> DataFrame:
    return conform(_dated_rows(statements, BALANCE_MAPS), "fact_balance_cashflow_annual")


def eps_annual_rows(statements: DataFrame) -> DataFrame:
    return statements.select(F.col("ticker").alias("ticker_usd"), F.explode("eps_anual").alias("d", "eps")).select(
        "ticker_usd", F.to_date("d").alias("fecha_balance"), "eps"
    )


def eps_rows(statements: DataFrame) -> DataFrame:
    """fact_eps_trimestral: every report of the array, the unreported next one included."""
    rows = statements.select(F.col("ticker").alias("ticker_usd"), F.explode("eps_trimestral").alias("e"))
    return rows.select(
        "ticker_usd", F.to_date("e.fecha").alias("fecha_reporte"), "e.eps_estimado", "e.eps_reportado", "e.sorpresa_pct"
    )


def quarterly_long(files: DataFrame, field: str) -> DataFrame:
    """(ticker_usd, concepto, fecha, valor) from a date -> concept -> value map."""
    by_date = files.select("ticker_usd", F.explode(field).alias("d", "conceptos"))
    return by_date.select("ticker_usd", F.to_date("d").alias("fecha"), F.explode("conceptos").alias("concepto", "valor"))


def quarterly_rows(results: DataFrame, cash: DataFrame) -> DataFrame:
    """fact_resultados_trimestrales: one row per quarter of the results; cash items join in, buybacks as a positive amount."""

    def wide(long: DataFrame, concepts: dict[str, str]) -> DataFrame:
        return long.groupBy("ticker_usd", F.col("fecha").alias("fecha_trimestre")).agg(
            *[F.max(F.when(F.col("concepto") == k, F.col("valor"))).alias(c) for k, c in concepts.items()]
        )

    rows = wide(results, RESULT_CONCEPTS).join(wide(cash, CASH_CONCEPTS), ["ticker_usd", "fecha_trimestre"], "left")
    return conform(rows.withColumn("recompras", F.abs("recompras")), "fact_resultados_trimestrales")


# -- insiders, consensus, headlines ----------------------------------------------


def transaction_kind(text: Column) -> Column:
    t = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    return F.when(t.startswith("purchase"), "Compra").when(t.startswith("sale"), "Venta").otherwise("Otro")


def insider_rows(raw: DataFrame) -> DataFrame:
    """fact_insider_transacciones from raw rows with a ``ticker_usd``."""
    return raw.select(
        "ticker_usd", F.to_date(F.col("Start Date")).alias("fecha"), F.col("Insider").alias("insider"), F.col("Position").alias("cargo"),
        transaction_kind(F.col("Text")).alias("tipo"), F.col("Shares").cast("long").alias("acciones"),
        F.col("Value").cast("double").alias("valor"), F.col("Text").alias("texto"),
    )


def consensus_rows(raw: DataFrame, day: Column) -> DataFrame:
    """fact_consenso_analistas: targets and this month's recommendations; a company without cover keeps an empty row."""
    now = F.get(F.filter("recommendations", lambda r: r["period"] == "0m"), F.lit(0))
    targets = {"actual": "current", "bajo": "low", "alto": "high", "mediana": "median"}
    recs = {"rec_strong_buy": "strongBuy", "rec_buy": "buy", "rec_hold": "hold", "rec_sell": "sell", "rec_strong_sell": "strongSell"}
    return conform(
        raw.withColumn("_r", now).select(
            F.col("ticker").alias("ticker_usd"), day.alias("fecha"),
            *[F.col(f"targets.{f}").alias(f"precio_objetivo_{c}") for c, f in targets.items()],
            *[F.col(f"_r.{f}").alias(c) for c, f in recs.items()],
        ),
        "fact_consenso_analistas",
    )


def mail_time(text: Column) -> Column:
    """Timestamp of an RFC-822 date; the weekday is dropped before parsing."""
    bare = F.regexp_replace(F.trim(text), r"^[A-Za-z]{3},\s*", "")
    return F.coalesce(
        F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss z")), F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss Z"))
    )


def read_news_files(spark: SparkSession, path: str, named: bool = False) -> DataFrame:
    """RSS files, one file or folder per ticker: raw items with ``ticker_usd`` and their place in the feed.

    With ``named`` a file holds items of many tickers, each with an element ``ticker_usd``; a ticker's feed is then its items by file and place.
    """
    items = spark.read.format("xml").option("rowTag", "item").option("recursiveFileLookup", "true").schema(NEWS_SCHEMA + ", ticker_usd string" * named).load(path)
    # pieces of one file follow each other by where they begin, whatever partition they came in
    piece = Window.partitionBy("ticker_usd").orderBy("_file", "_block", "_row")
    ticker = F.col("ticker_usd") if named else file_stem()
    placed = items.withColumn("ticker_usd", ticker).select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))
    return placed.withColumn("_row", F.monotonically_increasing_id()).withColumn("orden", F.row_number().over(piece)).drop("_file", "_block", "_row")


def news_items(raw: DataFrame, as_of: AsOf = None) -> DataFrame:
    """Headlines kept from raw feed items: titled, dated, of the last days, none cut off."""
    items = raw.select(
        "ticker_usd", "orden", F.col("title").alias("titular"), F.col("source._VALUE").alias("fuente"),
        mail_time(F.col("pubDate")).alias("fecha_publicacion"), "link",
    )
    return recent_headlines(items, as_of)
