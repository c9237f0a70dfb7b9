"""How companies behaved in the market's large falls."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.functions.expr import beta, change_pct, ladder, pearson, ratio, rounded
from tickerloom.functions.series import (
    broadcast_per_date,
    by_date,
    calendar_fill,
    drawdown_episodes,
    drawdowns,
    one_key,
)

MARKETS = ("usa_otros", "etf")
MIN_DAYS = 750
EPISODE_THRESHOLD = -0.10
REFUGE_CAPTURE, DEFENSIVE_CAPTURE, WORST_EPISODE_PCT = 0.3, 0.6, -10.0
CARRY_LIMIT = 3


def eligible_prices(prices: DataFrame, dim: DataFrame, markets: tuple[str, ...] = MARKETS) -> DataFrame:
    listed = dim.filter(F.col("mercado").isin(*markets)).select("ticker_usd")
    return prices.filter(F.col("adj_close") > 0).join(listed, "ticker_usd", "left_semi").select("ticker_usd", "fecha", "adj_close")


def index_series(macro: DataFrame, series: str) -> DataFrame:
    return macro.filter((F.col("serie") == series) & F.col("valor").isNotNull()).select("serie", "fecha", "valor")


def aligned_prices(prices: DataFrame, index: DataFrame) -> DataFrame:
    """Prices on the index calendar, carried over at most three missing dates: ticker_usd, fecha, idx, adj_close."""
    return calendar_fill(prices, index.select("fecha"), "adj_close", CARRY_LIMIT)


def paired_returns(aligned: DataFrame, index: DataFrame) -> DataFrame:
    """Return of each ticker and of the index between consecutive calendar dates, where both exist."""
    w = by_date(date="idx")
    market = broadcast_per_date(
        index.select("fecha", (ratio("valor", F.lag("valor").over(one_key(index))) - 1).alias("m"))
    )
    consecutive = F.lag("idx").over(w) == F.col("idx") - 1
    return (
        aligned.withColumn("a", F.when(consecutive, ratio("adj_close", F.lag("adj_close").over(w)) - 1))
        .filter(F.col("a").isNotNull())
        .join(market, "fecha")
        .filter(F.col("m").isNotNull())
        .select("ticker_usd", "fecha", "a", "m")
    )


def episode_returns(
    aligned: DataFrame, index: DataFrame, threshold: float = EPISODE_THRESHOLD, rounded_output: bool = True
) -> DataFrame:
    """Return of the index and of each ticker from peak to trough of every episode the ticker was trading for.

    Episodes become numbered points on the index calendar. Each bar takes the points that fall between it and the
    ticker's next bar, so a ticker meets each point once and nothing is crossed with nothing.
    """
    episodes = drawdown_episodes(index, "valor", "serie", threshold)
    ends = episodes.select(F.explode(F.array("episodio_pico", "episodio_piso")).alias("fecha")).distinct()
    days = index.select("fecha", "valor").join(ends.withColumn("punto", F.lit(1)), "fecha", "left")
    w = one_key(days)
    days = days.select(
        "fecha", "valor", "punto",
        F.coalesce(F.sum("punto").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("antes"),
    )
    points = days.filter(F.col("punto") == 1).select((F.col("antes") + 1).alias("nro"), F.col("fecha").alias("punto"))
    total = days.agg(F.coalesce(F.sum("punto"), F.lit(0)).cast("long")).scalar()
    marked = aligned.join(broadcast_per_date(days.select("fecha", "antes")), "fecha")
    upto = F.coalesce(F.lead("antes").over(by_date(date="idx")), total)
    at_point = (
        marked.withColumn("hasta", upto)
        .filter(F.col("hasta") > F.col("antes"))
        .select("ticker_usd", "adj_close", F.explode(F.sequence(F.col("antes") + 1, F.col("hasta"))).alias("nro"))
        .join(broadcast_per_date(points), "nro")
        .select("ticker_usd", "punto", "adj_close")
    )
    level = days.select("fecha", "valor")
    named = (
        episodes.join(level.select(F.col("fecha").alias("episodio_pico"), F.col("valor").alias("v0")), "episodio_pico")
        .join(level.select(F.col("fecha").alias("episodio_piso"), F.col("valor").alias("v1")), "episodio_piso")
        .select("episodio_pico", "episodio_piso", change_pct("v1", "v0").alias("retorno_sp"))
    )
    peak = at_point.select("ticker_usd", F.col("punto").alias("episodio_pico"), F.col("adj_close").alias("p0"))
    trough = at_point.select("ticker_usd", F.col("punto").alias("episodio_piso"), F.col("adj_close").alias("p1"))
    return (
        peak.join(broadcast_per_date(named), "episodio_pico")
        .join(trough, ["ticker_usd", "episodio_piso"])
        .select(
            "ticker_usd", "episodio_pico", "episodio_piso",
            rounded(F.col("retorno_sp"), 1, rounded_output).alias("retorno_sp_pct"),
            rounded(change_pct("p1", "p0"), 1, rounded_output).alias("retorno_pct"),
        )
    )


def kept_episodes(
    prices: DataFrame,
    macro: DataFrame,
    dim: DataFrame,
    index_code: str = "SP500",
    min_days: int = MIN_DAYS,
    threshold: float = EPISODE_THRESHOLD,
    rounded_output: bool = True,
) -> DataFrame:
    """Episode rows of the tickers with at least ``min_days`` paired returns, the ones that get a segment."""
    index = index_series(macro, index_code)
    aligned = aligned_prices(eligible_prices(prices, dim), index)
    enough = paired_returns(aligned, index).groupBy("ticker_usd").agg(F.count("*").alias("n")).filter(F.col("n") >= min_days)
    return episode_returns(aligned, index, threshold, rounded_output).join(enough, "ticker_usd", "left_semi")


def refuge(
    prices: DataFrame,
    macro: DataFrame,
    dim: DataFrame,
    index_code: str = "SP500",
    min_days: int = MIN_DAYS,
    threshold: float = EPISODE_THRESHOLD,
    rounded_output: bool = True,
) -> DataFrame:
    """Beta, down-market beta and capture, episode outcomes, worst drawdown and the resulting segment."""
    r = rounded_output
    index = index_series(macro, index_code)
    aligned = aligned_prices(eligible_prices(prices, dim), index)
    pairs = paired_returns(aligned, index)
    down = F.col("m") < 0
    a_down, m_down = F.when(down, F.col("a")), F.when(down, F.col("m"))
    stats = pairs.groupBy("ticker_usd").agg(
        F.count("*").alias("refugio_dias"),
        beta("a", "m").alias("beta"),
        beta(a_down, m_down).alias("beta_bajista"),
        ratio(F.avg(a_down), F.avg(m_down)).alias("captura"),
        pearson("a", "m").alias("corr"),
    )
    outcomes = (
        episode_returns(aligned, index, threshold, rounded_output=False)
        .groupBy("ticker_usd")
        .agg(
            F.count("*").alias("n_ep"),
            F.median("retorno_pct").alias("mediana"),
            F.min("retorno_pct").alias("peor"),
        )
    )
    worst = drawdowns(aligned, "adj_close", "ticker_usd").groupBy("ticker_usd").agg((F.min("caida") * 100).alias("dd"))
    capture, worst_ep = F.col("captura"), F.col("peor")
    return (
        stats.filter(F.col("refugio_dias") >= min_days)
        .join(outcomes, "ticker_usd", "left")
        .join(worst, "ticker_usd")
        .select(
            "ticker_usd", "refugio_dias",
            rounded(F.col("beta"), 2, r).alias("refugio_beta"),
            rounded(F.col("beta_bajista"), 2, r).alias("refugio_beta_bajista"),
            rounded(capture, 2, r).alias("refugio_captura_bajista"),
            rounded(F.col("corr"), 2, r).alias("refugio_corr_sp"),
            F.coalesce("n_ep", F.lit(0)).alias("refugio_episodios"),
            rounded(F.col("mediana"), 1, r).alias("refugio_ep_mediana_pct"),
            rounded(worst_ep, 1, r).alias("refugio_ep_peor_pct"),
            rounded(F.col("dd"), 1, r).alias("refugio_max_dd_pct"),
            ladder(
                [
                    ((capture <= REFUGE_CAPTURE) & (worst_ep >= WORST_EPISODE_PCT), "Refugio"),
                    (capture <= DEFENSIVE_CAPTURE, "Defensiva"),
                ],
                "No es refugio",
            ).alias("refugio_segmento"),
        )
    )
