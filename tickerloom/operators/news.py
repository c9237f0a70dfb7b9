"""Headline scoring, sentiment and insider activity."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.functions.expr import AsOf, as_of_date, ladder, rounded

WINDOW_DAYS = 7
TONE_THRESHOLD = 0.15
INSIDER_DAYS = 90
RELEVANT_AMOUNT = 100_000
# Positions whose purchases count whatever their size (fixed pattern).
CHIEF_PATTERN = r"chief executive|chief financial|\bceo\b|\bcfo\b"

Scorer = Callable[[pd.Series], pd.DataFrame]

# Scorers of this module travel with the job, so workers need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def news_sentiment(news: DataFrame, as_of: AsOf = None, days: int = WINDOW_DAYS, rounded_output: bool = True) -> DataFrame:
    """Headline counts and signed mean confidence per ticker over the last days."""
    today = as_of_date(as_of, news, "fecha_publicacion")
    label, score = F.col("sentimiento"), F.col("score_sentimiento")
    signed = F.when(label == "positive", score).when(label == "negative", -score).otherwise(0.0)
    mean = F.col("media")
    return (
        news.filter(F.col("fecha_publicacion") >= F.date_sub(today, days))
        .groupBy("ticker_usd")
        .agg(
            F.count("*").alias("sent_titulares_total"),
            *[
                F.count_if(label == tag).alias(name)
                for tag, name in (
                    ("positive", "sent_positivas"), ("negative", "sent_negativas"), ("neutral", "sent_neutrales")
                )
            ],
            F.avg(signed).alias("media"),
        )
        .withColumn("sent_score_promedio", rounded(mean, 3, rounded_output))
        .withColumn(
            "sent_clasificacion",
            ladder([(mean >= TONE_THRESHOLD, "Positivo"), (mean <= -TONE_THRESHOLD, "Negativo")], "Neutral/Mixto"),
        )
        .drop("media")
    )


def insider_signal(
    trades: DataFrame, as_of: AsOf = None, days: int = INSIDER_DAYS, relevant_amount: float = RELEVANT_AMOUNT
) -> DataFrame:
    """Purchases and sales of directors over the last days; every ticker with any trade on record keeps a row."""
    today = as_of_date(as_of, trades, "fecha")
    recent = F.col("fecha") >= F.date_sub(today, days)
    bought, sold = recent & (F.col("tipo") == "Compra"), recent & (F.col("tipo") == "Venta")
    chief = bought & F.lower("cargo").rlike(CHIEF_PATTERN)
    amount = F.col("ins_compras_monto_90d")
    # Distinct buyers are counted on their own so one ticker's many trades are reduced by (ticker, insider) first.
    buyers = trades.filter(bought).select("ticker_usd", "insider").distinct().groupBy("ticker_usd").agg(
        F.count("insider").alias("ins_compradores_90d")
    )
    return (
        trades.groupBy("ticker_usd")
        .agg(
            F.count_if(bought).alias("ins_compras_90d"),
            F.coalesce(F.sum(F.when(bought, F.col("valor"))), F.lit(0.0)).alias("ins_compras_monto_90d"),
            F.coalesce(F.bool_or(chief), F.lit(False)).alias("ins_compro_ceo_cfo"),
            F.max(F.when(bought, F.col("fecha"))).alias("ins_ultima_compra"),
            F.count_if(sold).alias("ins_ventas_90d"),
            F.coalesce(F.sum(F.when(sold, F.col("valor"))), F.lit(0.0)).alias("ins_ventas_monto_90d"),
        )
        .join(buyers, "ticker_usd", "left")
        .select(
            "ticker_usd", "ins_compras_90d", "ins_compras_monto_90d",
            F.coalesce("ins_compradores_90d", F.lit(0)).alias("ins_compradores_90d"),
            "ins_compro_ceo_cfo", "ins_ultima_compra", "ins_ventas_90d", "ins_ventas_monto_90d",
            F.when(F.col("ins_compro_ceo_cfo") | (amount >= relevant_amount), "Compra relevante")
            .otherwise("Sin compras relevantes")
            .alias("ins_senal"),
        )
    )


def recent_headlines(
    items: DataFrame, as_of: AsOf = None, days: int = WINDOW_DAYS, scanned: int | None = None, kept: int | None = None
) -> DataFrame:
    """The usable headlines of the window. A caller that mirrors one request per ticker can limit the feed items looked at
    (``scanned``) and the headlines taken of those (``kept``); by default nothing is cut.

    ``items``: ticker_usd, orden (position in the feed), titular, fecha_publicacion and any other columns.
    """
    today = as_of_date(as_of, items, "fecha_publicacion")
    feed = Window.partitionBy("ticker_usd").orderBy("orden")
    usable = F.col("titular").isNotNull() & (F.col("titular") != "") & (F.col("fecha_publicacion") >= F.date_sub(today, days))
    found = items
    if scanned is not None:
        found = found.withColumn("_n", F.row_number().over(feed)).filter(F.col("_n") <= scanned).drop("_n")
    found = found.filter(usable)
    if kept is not None:
        found = found.withColumn("_n", F.row_number().over(feed)).filter(F.col("_n") <= kept).drop("_n")
    return found


def new_headlines(items: DataFrame, stored: DataFrame) -> DataFrame:
    """Headlines not stored yet for their ticker; whole texts meet by their digest, so the stored side stays narrow."""
    digest = F.sha2("titular", 256).alias("_d")
    seen = stored.select("ticker_usd", digest).distinct()
    return items.withColumn("_d", digest).join(seen, ["ticker_usd", "_d"], "left_anti").select(*items.columns)


# Fixed word lists.
GOOD = ("beat", "beats", "gain", "gains", "growth", "high", "profit", "record", "rise", "rises", "strong", "surge", "up", "upgrade")
BAD = ("cut", "cuts", "down", "downgrade", "drop", "drops", "fall", "falls", "fraud", "loss", "low", "miss", "misses", "weak")


def word_pattern(words: tuple[str, ...]) -> str:
    """Whole words; only ASCII letters, digits and the underscore make a word longer."""
    return rf"(?<![a-z0-9_])(?:{'|'.join(words)})(?![a-z0-9_])"


def lexicon_score(text: Column, good: tuple[str, ...] = GOOD, bad: tuple[str, ...] = BAD) -> tuple[Column, Column]:
    """Label and confidence from counts of good and bad words; stands in where no model is installed."""
    lower = F.lower(F.coalesce(text, F.lit("")))
    g, b = (F.regexp_count(lower, F.lit(word_pattern(w))) for w in (good, bad))
    label = F.when(g > b, "positive").when(b > g, "negative").otherwise("neutral")
    return label, F.round((1 + F.abs(g - b)) / (2 + g + b), 3)


def score_headlines(
    items: DataFrame, stored: DataFrame, scorer: Scorer | None = None, text: str = "titular", good: tuple[str, ...] = GOOD, bad: tuple[str, ...] = BAD
) -> DataFrame:
    """Score the new headlines: by word counts in the plan itself, or in Arrow batches by a caller's model, which maps a series of
    texts to label and confidence."""
    fresh = new_headlines(items, stored)
    if scorer is None:
        label, score = lexicon_score(F.col(text), good, bad)
        return fresh.withColumns({"sentimiento": label, "score_sentimiento": score})

    def batches(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield scorer(part)

    # the hints must be live types for Spark to see an iterator UDF
    batches.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    run = F.pandas_udf(batches, "sentimiento string, score_sentimiento double")
    scored = fresh.withColumn("_s", run(F.col(text)))
    return scored.withColumn("sentimiento", F.col("_s.sentimiento")).withColumn(
        "score_sentimiento", F.round("_s.score_sentimiento", 3)
    ).drop("_s")
