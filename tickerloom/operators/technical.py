"""Technical indicators: latest state per ticker and full indicator series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.functions.expr import change_pct, ladder, ratio, rounded
from tickerloom.functions.series import by_date, running, trailing

RSI_OVERBOUGHT, RSI_OVERSOLD = 70, 30
MACD_HISTORY = 400
# Weight growth 1 / (1 - alpha) of the 12, 26 and 9 row exponential averages.
EMA_FAST, EMA_SLOW, EMA_SIGNAL = 13 / 11, 27 / 25, 10 / 8


def ema(value: Column, k: Column, growth: float, window) -> Column:
    """Exponential average as a ratio of two running sums of growing weights (needs a bounded ``k``)."""
    weight = F.pow(F.lit(growth), k)
    return F.sum(value * weight).over(window) / F.sum(F.when(value.isNotNull(), weight)).over(window)


def rsi_value(gain: Column, loss: Column) -> Column:
    """RSI from mean gain and mean loss; 100 when nothing was lost and something gained."""
    return F.when((loss == 0) & (gain > 0), F.lit(100.0)).otherwise(100 - 100 / (1 + ratio(gain, loss)))


def rsi_label(rsi: Column) -> Column:
    return ladder(
        [
            (rsi.isNull(), "Neutral"),
            (rsi >= RSI_OVERBOUGHT, "Sobrecomprado"),
            (rsi <= RSI_OVERSOLD, "Sobrevendido"),
        ],
        "Neutral",
    )


def _numbered(prices: DataFrame) -> DataFrame:
    """Rows up to each ticker's last adjusted close, with newest-first numbers among the rows
    that carry a price, a volume and a full bar respectively, and the previous values of each."""
    w = by_date()
    whole = Window.partitionBy("ticker_usd")
    has_price = F.col("adj_close").isNotNull()
    has_volume = F.col("volume").isNotNull()
    has_bar = F.col("close").isNotNull() & F.col("high").isNotNull() & F.col("low").isNotNull()

    def newest_first_number(flag: Column) -> Column:
        seen = F.sum(F.when(flag, 1).otherwise(0))
        return F.when(flag, seen.over(whole) - seen.over(running(w)) + 1)

    past = w.rowsBetween(Window.unboundedPreceding, -1)
    return (
        prices.select("ticker_usd", "fecha", "high", "low", "close", "adj_close", "volume")
        .withColumn("ultima", F.max(F.when(has_price, F.col("fecha"))).over(whole))
        .filter(F.col("fecha") <= F.col("ultima"))
        .select(
            "*",
            newest_first_number(has_price).alias("n"),
            newest_first_number(has_volume).alias("n_vol"),
            newest_first_number(has_bar).alias("n_bar"),
            F.last(F.when(has_price, F.col("adj_close")), ignorenulls=True).over(past).alias("adj_previo"),
            F.last(F.when(has_bar, F.col("close")), ignorenulls=True).over(past).alias("close_previo"),
        )
    )


def technical(prices: DataFrame, rounded_output: bool = True) -> DataFrame:
    """Latest indicators per ticker.

    Only the newest row of each ticker is wanted, so the frames become conditional aggregates over
    newest-first row numbers: one shuffle by ticker, no sliding frame is ever recomputed.
    """
    r = rounded_output
    n, n_vol, n_bar = F.col("n"), F.col("n_vol"), F.col("n_bar")
    adj = F.col("adj_close")
    delta = adj - F.col("adj_previo")
    true_range = F.greatest(
        F.col("high") - F.col("low"),
        F.abs(F.col("high") - F.col("close_previo")),
        F.abs(F.col("low") - F.col("close_previo")),
    )
    w = by_date()
    rows = _numbered(prices)
    total = F.max("n").over(Window.partitionBy("ticker_usd"))
    in_macd = n <= MACD_HISTORY
    rows = (
        rows.withColumn("k", F.when(in_macd, F.least(total, F.lit(MACD_HISTORY)) - n + 1))
        .withColumn("px", F.when(in_macd, adj))
        .withColumn(
            "macd",
            F.when(
                in_macd,
                ema(F.col("px"), F.col("k"), EMA_FAST, running(w)) - ema(F.col("px"), F.col("k"), EMA_SLOW, running(w)),
            ),
        )
        .withColumn("macd_senal", F.when(in_macd, ema(F.col("macd"), F.col("k"), EMA_SIGNAL, running(w))))
    )

    def at(i: int, value: Column | str) -> Column:
        return F.max(F.when(n == i, value))

    def mean_last(k: int, value: Column) -> Column:
        return F.avg(F.when(n <= k, value))

    latest = rows.groupBy("ticker_usd").agg(
        at(1, F.col("fecha")).alias("fecha"),
        at(1, adj).alias("adj_close"),
        mean_last(50, adj).alias("sma50"),
        mean_last(200, adj).alias("sma200"),
        F.count(F.when(n <= 200, 1)).alias("dias"),
        mean_last(20, adj).alias("sma20"),
        F.stddev_pop(F.when(n <= 20, adj)).alias("std20"),
        F.max(F.when(n <= 252, adj)).alias("max_52s"),
        F.min(F.when(n <= 252, adj)).alias("min_52s"),
        at(22, adj).alias("precio_1m"),
        at(64, adj).alias("precio_3m"),
        at(127, adj).alias("precio_6m"),
        mean_last(14, F.greatest(delta, F.lit(0.0))).alias("gain"),
        mean_last(14, F.greatest(-delta, F.lit(0.0))).alias("loss"),
        F.max(F.when(n_vol == 1, F.col("fecha"))).alias("fecha_vol"),
        F.avg(F.when(n_vol <= 30, F.col("volume"))).alias("vol_30"),
        F.avg(F.when(n_vol.between(31, 120), F.col("volume"))).alias("vol_previo"),
        F.max(F.when(n_bar == 1, F.col("fecha"))).alias("fecha_bar"),
        F.max(F.when(n_bar == 1, F.col("close"))).alias("close"),
        F.avg(F.when(n_bar <= 14, true_range)).alias("atr14"),
        F.count(F.when(n_bar <= 14, true_range)).alias("dias_atr"),
        at(1, F.col("k")).alias("k"),
        at(1, F.col("macd")).alias("macd"),
        at(1, F.col("macd_senal")).alias("macd_senal"),
    )
    price = F.col("adj_close")
    dias, std20, macd = F.col("dias"), F.col("std20"), F.col("macd")
    rsi = rsi_value(F.col("gain"), F.col("loss"))
    vol_known = F.col("fecha_vol") == F.col("fecha")
    bar_known = F.col("fecha_bar") == F.col("fecha")
    long_enough, rsi_ready, macd_ready = dias >= 200, dias >= 14, F.col("k") >= 35
    return latest.filter(F.col("fecha").isNotNull()).select(
        "ticker_usd",
        "fecha",
        price.alias("tech_precio"),
        rounded(F.col("sma50"), 2, r).alias("tech_sma50"),
        rounded(F.col("sma200"), 2, r).alias("tech_sma200"),
        F.when(long_enough, rounded(change_pct(price, "sma50"), 1, r)).alias("tech_precio_vs_sma50_pct"),
        F.when(long_enough, rounded(change_pct(price, "sma200"), 1, r)).alias("tech_precio_vs_sma200_pct"),
        F.when(long_enough, F.when(F.col("sma50") > F.col("sma200"), "Alcista").otherwise("Bajista")).alias("tech_tendencia"),
        F.when(rsi_ready, rounded(rsi, 1, r)).alias("tech_rsi14"),
        F.when(rsi_ready, rsi_label(rsi)).alias("tech_rsi_senal"),
        rounded(change_pct(price, "precio_1m"), 1, r).alias("tech_retorno_1m_pct"),
        rounded(change_pct(price, "precio_3m"), 1, r).alias("tech_retorno_3m_pct"),
        rounded(change_pct(price, "precio_6m"), 1, r).alias("tech_retorno_6m_pct"),
        F.when(vol_known, rounded(F.col("vol_30"), 0, r)).alias("tech_volumen_prom_30d"),
        F.when(vol_known, rounded(change_pct("vol_30", "vol_previo"), 1, r)).alias("tech_volumen_tendencia_pct"),
        F.when(dias >= 20, rounded(ratio(price - (F.col("sma20") - 2 * std20), 4 * std20) * 100, 1, r)).alias("tech_bb_pct_b"),
        F.when(dias >= 20, rounded(ratio(4 * std20, "sma20") * 100, 1, r)).alias("tech_bb_ancho_pct"),
        F.when(macd_ready, rounded(macd, 3, r)).alias("tech_macd"),
        F.when(macd_ready, rounded(ratio(macd - F.col("macd_senal"), price) * 100, 2, r)).alias("tech_macd_hist_pct"),
        F.when(macd_ready, F.when(macd > F.col("macd_senal"), "Alcista").otherwise("Bajista")).alias("tech_macd_cruce"),
        F.when(bar_known & (F.col("dias_atr") >= 14), rounded(ratio("atr14", "close") * 100, 2, r)).alias("tech_atr14_pct"),
        rounded(change_pct(price, "max_52s"), 1, r).alias("tech_dist_max_52s_pct"),
        rounded(change_pct(price, "min_52s"), 1, r).alias("tech_dist_min_52s_pct"),
    )


def rsi_series(prices: DataFrame, n: int = 14) -> DataFrame:
    """RSI at every date, NULL until ``n`` price changes exist: (ticker_usd, fecha, adj_close, rsi)."""
    w = by_date()
    known = prices.filter(F.col("adj_close").isNotNull()).select("ticker_usd", "fecha", "adj_close")
    moved = known.withColumn("delta", F.col("adj_close") - F.lag("adj_close").over(w))
    frame = trailing(n, w)
    gain = F.avg(F.when(F.col("delta").isNotNull(), F.greatest("delta", F.lit(0.0)))).over(frame)
    loss = F.avg(F.when(F.col("delta").isNotNull(), F.greatest(-F.col("delta"), F.lit(0.0)))).over(frame)
    full = F.count("delta").over(frame) >= n
    return moved.select("ticker_usd", "fecha", "adj_close", F.when(full, gain).alias("g"), F.when(full, loss).alias("l")).select(
        "ticker_usd", "fecha", "adj_close", rsi_value(F.col("g"), F.col("l")).alias("rsi")
    )


def moving_levels(prices: DataFrame) -> DataFrame:
    """Moving averages, bands and 252-row extremes at every date."""
    adj = F.col("adj_close")
    return prices.filter(adj.isNotNull()).select(
        "ticker_usd",
        "fecha",
        "adj_close",
        F.avg(adj).over(trailing(20)).alias("sma20"),
        F.stddev_pop(adj).over(trailing(20)).alias("std20"),
        F.avg(adj).over(trailing(50)).alias("sma50"),
        F.avg(adj).over(trailing(200)).alias("sma200"),
        F.count(adj).over(trailing(200)).alias("dias_sma200"),
        F.max(adj).over(trailing(252)).alias("max_52s"),
        F.min(adj).over(trailing(252)).alias("min_52s"),
        F.lag(adj, 21).over(by_date()).alias("precio_1m"),
        F.lag(adj, 63).over(by_date()).alias("precio_3m"),
        F.lag(adj, 126).over(by_date()).alias("precio_6m"),
    )


def volume_moments(prices: DataFrame, min_ratio: float = 2.0) -> DataFrame:
    """Days of unusual volume near the bottom or the top of the 180-row price range."""
    w = by_date()
    base = prices.filter(F.col("adj_close").isNotNull() & F.col("volume").isNotNull()).select(
        "ticker_usd",
        "fecha",
        "adj_close",
        "volume",
        F.avg("volume").over(w.rowsBetween(-90, -1)).alias("vol_prom"),
        F.min("adj_close").over(trailing(180, w)).alias("lo"),
        F.max("adj_close").over(trailing(180, w)).alias("hi"),
        F.count("*").over(trailing(180, w)).alias("dias"),
    )
    place = F.round(ratio(F.col("adj_close") - F.col("lo"), F.col("hi") - F.col("lo")), 2)
    kind = ladder([(place <= 0.25, "Acumulación (cerca de mínimo)"), (place >= 0.75, "Distribución/ruptura (cerca de máximo)")])
    return (
        base.filter((F.col("dias") >= 180) & (F.col("volume") >= min_ratio * F.col("vol_prom")))
        .select(
            "ticker_usd",
            "fecha",
            "adj_close",
            "volume",
            ratio("volume", "vol_prom").alias("ratio_volumen"),
            place.alias("percentil_precio_180d"),
            kind.alias("tipo"),
        )
        .filter(F.col("tipo").isNotNull())
    )
