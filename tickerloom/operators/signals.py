"""Entry signals of a watchlist, each read as of a date: (ticker_usd, senal, activa, detalle)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.functions.expr import AsOf, all_known, as_of_date, change_pct, ratio
from tickerloom.functions.series import asof_backward, by_date, newest_first
from tickerloom.operators.technical import rsi_value

MIN_ACTIVE = 3
PRIOR_FALL_PCT = 15
SIGNALS = ["moneda_estable", "capitulacion", "dejo_de_hacer_minimos", "post_reporte", "rsi_recupera"]


def _recent(prices: DataFrame, tickers: DataFrame, today: Column, rows: int) -> DataFrame:
    """The newest ``rows`` known rows up to the date, ``rn`` = 1 for the newest."""
    known = prices.filter((F.col("fecha") <= today) & F.col("adj_close").isNotNull())
    return newest_first(known.join(tickers.select("ticker_usd").distinct(), "ticker_usd", "left_semi"), rows)


def _signal(df: DataFrame, name: str, active: Column, detail: Column) -> DataFrame:
    return df.select(
        "ticker_usd", F.lit(name).alias("senal"), F.coalesce(active, F.lit(False)).alias("activa"), detail.alias("detalle")
    )


def currency_stable(watch: DataFrame, macro: DataFrame, as_of: AsOf = None) -> DataFrame:
    """Active when the watched currency series did not rise over its last five rows. Only rows with a series."""
    today = as_of_date(as_of, macro, "fecha")
    watched = watch.filter(F.col("moneda").isNotNull()).select("ticker_usd", F.col("moneda").alias("serie"))
    recent = newest_first(
        macro.join(watched.select("serie").distinct(), "serie", "left_semi").filter(F.col("fecha") <= today), 6, key="serie"
    )
    moves = recent.groupBy("serie").agg(
        F.count("*").alias("n"),
        change_pct(F.max(F.when(F.col("rn") == 1, F.col("valor"))), F.max(F.when(F.col("rn") == 6, F.col("valor")))).alias("cambio"),
    )
    enough = F.coalesce(F.col("n") >= 6, F.lit(False))
    return _signal(
        watched.join(moves, "serie", "left"),
        "moneda_estable",
        enough & (F.col("cambio") <= 0),
        F.when(enough, F.format_string("%s %+.1f%% en 5 ruedas", "serie", "cambio")).otherwise(
            F.concat(F.lit("sin datos suficientes de "), "serie")
        ),
    )


PANIC_ROWS, LOW_ROWS, RSI_ROWS = 100, 80, 60  # newest rows each price signal looks at


def price_state(watch: DataFrame, prices: DataFrame, as_of: AsOf = None) -> DataFrame:
    """One row per watched ticker with what the price signals read, from its newest hundred rows met once: number of rows, last price, the day of panic,
    the low of the last 20 rows and the high before it, RSI now and whether it was low."""
    today = as_of_date(as_of, prices, "fecha")
    w, rn = by_date(), F.col("rn")
    past, frame = w.rowsBetween(-90, -1), w.rowsBetween(-13, 0)
    rows = (
        _recent(prices, watch, today, PANIC_ROWS)
        .withColumn("prom", F.when(F.count("volume").over(past) >= 30, F.avg("volume").over(past)))
        .withColumn("pos", ratio(F.col("close") - F.col("low"), F.col("high") - F.col("low")))
        .withColumn("delta", F.when(rn < RSI_ROWS, F.col("adj_close") - F.lag("adj_close").over(w)))
    )
    full = F.count("delta").over(frame) >= 14
    gain = F.avg(F.when(F.col("delta") > 0, F.col("delta")).when(F.col("delta").isNotNull(), 0.0)).over(frame)
    loss = F.avg(F.when(F.col("delta") < 0, -F.col("delta")).when(F.col("delta").isNotNull(), 0.0)).over(frame)
    rows = rows.withColumn("rsi", rsi_value(F.when(full, gain), F.when(full, loss)))
    panic = (rn <= 10) & (F.col("volume") >= 3 * F.col("prom")) & (F.col("pos") >= 0.5)
    state = rows.groupBy("ticker_usd").agg(
        F.count("*").alias("n"),
        F.max(F.when(rn == 1, F.col("adj_close"))).alias("ultimo"),
        F.max_by(F.struct("fecha", "volume", "prom", "pos"), F.when(panic, F.col("fecha"))).alias("d"),
        # the earliest of equal lows: among equal prices the larger newest-first number
        F.min(F.when(rn <= 20, F.struct("adj_close", (-rn).alias("neg")))).alias("m"),
        F.sort_array(F.collect_list(F.when(rn <= LOW_ROWS, F.struct("rn", "adj_close")))).alias("cierres"),
        F.max(F.when(rn == 1, F.col("rsi"))).alias("rsi"),
        F.coalesce(F.bool_or((rn <= 15) & (F.col("rsi") < 30)), F.lit(False)).alias("abajo"),
    )
    rn_min = -F.col("m.neg")
    before = F.array_max(F.slice(F.col("cierres.adj_close"), rn_min.cast("int"), F.lit(61)))
    state = state.select("ticker_usd", "n", "ultimo", "d", F.col("m.adj_close").alias("minimo"), rn_min.alias("rn_min"), before.alias("maximo_previo"), "rsi", "abajo")
    return watch.select("ticker_usd").distinct().join(state, "ticker_usd", "left")


def _enough(rows: int) -> Column:
    return F.coalesce(F.col("n") >= rows, F.lit(False))


def _panic() -> tuple[Column, Column]:
    enough, hit = _enough(40), F.col("d").isNotNull()
    text = F.format_string(
        "%s: %.1fx volumen, cerró en el %.0f%% alto del día",
        F.col("d.fecha").cast("string"), ratio("d.volume", "d.prom"), F.col("d.pos") * 100,
    )
    return enough & hit, F.when(~enough, "historia insuficiente").when(hit, text).otherwise("sin dia de volumen extremo con rebote")


def _bounce() -> tuple[Column, Column]:
    fall, since, bounce = change_pct("minimo", "maximo_previo"), F.col("rn_min") - 1, change_pct("ultimo", "minimo")
    enough = _enough(10)
    text = F.format_string("caída previa %.0f%%, mínimo hace %d ruedas, rebote %+.1f%%", fall, since, bounce)
    return enough & (fall <= -PRIOR_FALL_PCT) & (since >= 3) & (bounce >= 3), F.when(enough, text).otherwise("historia insuficiente")


def _recovery() -> tuple[Column, Column]:
    enough = _enough(20)
    detail = (
        F.when(~enough, "historia insuficiente")
        .when(F.col("rsi").isNull(), "RSI sin calcular")
        .otherwise(F.concat(F.format_string("RSI %.0f", "rsi"), F.when(F.col("abajo"), " (venía de < 30)").otherwise("")))
    )
    return enough & F.col("abajo") & (F.col("rsi") > 30), detail


def capitulation(watch: DataFrame, prices: DataFrame, as_of: AsOf = None) -> DataFrame:
    """Active when one of the last ten rows traded three times its prior mean volume and closed in the upper half of its range."""
    return _signal(price_state(watch, prices, as_of), "capitulacion", *_panic())


def stopped_falling(watch: DataFrame, prices: DataFrame, as_of: AsOf = None) -> DataFrame:
    """Active when, after a fall of 15% or more, the low of the last 20 rows is three rows old and the price 3% above it."""
    return _signal(price_state(watch, prices, as_of), "dejo_de_hacer_minimos", *_bounce())


def rsi_recovers(watch: DataFrame, prices: DataFrame, as_of: AsOf = None) -> DataFrame:
    """Active when RSI was below 30 in the last 15 rows and is above 30 now."""
    return _signal(price_state(watch, prices, as_of), "rsi_recupera", *_recovery())


def _before_report(tickers: DataFrame, prices: DataFrame, eps: DataFrame, today: Column) -> DataFrame:
    """(ticker_usd, reporte, previo) of watched companies that reported within ten days; prices of no others are looked at."""
    reports = (
        eps.join(tickers, "ticker_usd", "left_semi")
        .filter(F.col("fecha_reporte").between(F.date_sub(today, 10), today))
        .groupBy("ticker_usd")
        .agg(F.max("fecha_reporte").alias("reporte"))
    )
    own = prices.join(reports.select("ticker_usd"), "ticker_usd", "left_semi")
    # the newest row before the report, with or without a price: an unknown close leaves the signal off
    return asof_backward(reports, own, ["ticker_usd"], "reporte", "fecha", {"adj_close": "previo"}, strict=True)


def _after_report() -> tuple[Column, Column]:
    move = change_pct("ultimo", "previo")
    detail = (
        F.when(F.col("reporte").isNull(), "no reportó en los últimos 10 días")
        .when(~all_known(F.col("ultimo"), F.col("previo")), "sin precios alrededor del reporte")
        .otherwise(F.format_string("reportó el %s, %+.1f%% desde el cierre previo", F.col("reporte").cast("string"), move))
    )
    return F.col("reporte").isNotNull() & (move >= -3), detail


def post_report(watch: DataFrame, prices: DataFrame, eps: DataFrame, as_of: AsOf = None) -> DataFrame:
    """Active when the company reported within ten days and holds within 3% of the close before the report."""
    today = as_of_date(as_of, prices, "fecha")
    reported = _before_report(watch.select("ticker_usd").distinct(), prices, eps, today)
    return _signal(price_state(watch, prices, today).join(reported, "ticker_usd", "left"), "post_reporte", *_after_report())


def evaluate_signals(watch: DataFrame, prices: DataFrame, macro: DataFrame, eps: DataFrame, as_of: AsOf = None) -> DataFrame:
    """All signals of the watched tickers (``watch``: ticker_usd, moneda). The currency signal only where a series is named; the four price signals
    come from one row per ticker."""
    today = as_of_date(as_of, prices, "fecha")
    tickers = watch.select("ticker_usd").distinct()
    state = price_state(watch, prices, today).join(_before_report(tickers, prices, eps, today), "ticker_usd", "left")
    read = {"capitulacion": _panic(), "dejo_de_hacer_minimos": _bounce(), "post_reporte": _after_report(), "rsi_recupera": _recovery()}
    each = F.array(*[
        F.struct(F.lit(name).alias("senal"), F.coalesce(active, F.lit(False)).alias("activa"), detail.alias("detalle")) for name, (active, detail) in read.items()
    ])
    priced = state.select("ticker_usd", F.explode(each).alias("s")).select("ticker_usd", "s.*")
    return currency_stable(watch, macro, today).unionByName(priced)


def count_active(signals: DataFrame) -> DataFrame:
    from tickerloom.functions.expr import joined

    return signals.groupBy("ticker_usd").agg(
        F.count("*").alias("senales"),
        F.count_if("activa").alias("activas"),
        joined(F.when(F.col("activa"), F.col("senal"))).alias("nombres"),
    )
