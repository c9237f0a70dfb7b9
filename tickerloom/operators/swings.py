"""Price swings: zigzag pivots, candidate Elliott counts, Fibonacci state and the pivot back-test."""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.functions.expr import change_pct, ladder, ratio, rounded
from tickerloom.functions.series import by_date

VOLATILITY_FACTOR = 5
MIN_THRESHOLD_PCT, MAX_THRESHOLD_PCT = 8.0, 30.0
MIN_ROWS = 250
FIB_LEVELS = [23.6, 38.2, 50.0, 61.8, 78.6, 100.0]
FIB_TOLERANCE = 3.0
PIVOT_SCHEMA = "ticker_usd string, nro_pivot int, fecha date, precio double, tipo string, fecha_confirmacion date"

# The group function travels with the job, so workers need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _leg_end(prices: list[float], start: int, threshold: float, falling_ends: bool) -> tuple[int, int] | None:
    """(extreme, confirmation) of the leg that starts at ``start``, or None while it is still open.

    A rising leg (``falling_ends``) is over once the price is ``threshold`` below its running
    maximum, a falling leg once it is that far above its running minimum. Legs are short, so plain numbers beat arrays.
    """
    best, at = prices[start], start
    for i in range(start, len(prices)):
        x = prices[i]
        if falling_ends:
            if x > best:
                best, at = x, i
            if x <= best * (1 - threshold):
                return at, i
        else:
            if x < best:
                best, at = x, i
            if x >= best * (1 + threshold):
                return at, i
    return None


def find_pivots(prices: Sequence[float], threshold_pct: float) -> list[tuple[int, str, int]]:
    """Alternating (index, 'H' | 'L', confirmation index) of one price series in date order."""
    u = threshold_pct / 100
    prices = np.asarray(prices, float).tolist()
    high, low = _leg_end(prices, 0, u, True), _leg_end(prices, 0, u, False)
    options = [(leg[1], order, kind, leg) for order, (kind, leg) in enumerate((("H", high), ("L", low))) if leg]
    out: list[tuple[int, str, int]] = []
    if not options:
        return out
    _, _, kind, leg = min(options)
    while leg is not None:
        out.append((leg[0], kind, leg[1]))
        kind = "L" if kind == "H" else "H"
        leg = _leg_end(prices, leg[1], u, kind == "H")
    return out


def swing_thresholds(prices: DataFrame, min_rows: int = MIN_ROWS) -> DataFrame:
    """Positive closes of tickers with enough history, each row carrying its ticker's reversal threshold."""
    w, whole = by_date(), Window.partitionBy("ticker_usd")
    return (
        prices.filter(F.col("adj_close") > 0)
        .select("ticker_usd", "fecha", "adj_close")
        .withColumn("lr", F.log(F.col("adj_close")) - F.log(F.lag("adj_close").over(w)))
        .withColumn("n", F.count("*").over(whole))
        .withColumn(
            "umbral_pct",
            F.least(
                F.greatest(VOLATILITY_FACTOR * F.stddev_pop("lr").over(whole) * 100, F.lit(MIN_THRESHOLD_PCT)),
                F.lit(MAX_THRESHOLD_PCT),
            ),
        )
        .filter(F.col("n") >= min_rows)
        .select("ticker_usd", "fecha", "adj_close", "umbral_pct")
    )


def _pivots_of_group(rows: pa.Table) -> pa.Table:
    # Arrow and numpy alone: a frame per ticker would cost more than the walk
    prices, dates = rows["adj_close"].to_numpy(), rows["fecha"].combine_chunks()
    order = np.argsort(dates.cast(pa.int32()).fill_null(np.iinfo(np.int32).max).to_numpy(), kind="stable")  # without a date: last
    found = find_pivots(prices[order], rows["umbral_pct"][0].as_py())
    at, confirmed = (order[np.array([leg[i] for leg in found], np.int64)] for i in (0, 2))
    return pa.table(
        {
            "ticker_usd": pa.repeat(rows["ticker_usd"][0], len(found)),
            "nro_pivot": pa.array(np.arange(1, len(found) + 1, dtype="int32")),
            "fecha": dates.take(pa.array(at)),
            "precio": pa.array(prices[at]),
            "tipo": pa.array([kind for _, kind, _ in found], pa.string()),
            "fecha_confirmacion": dates.take(pa.array(confirmed)),
        }
    )


def zigzag(prices: DataFrame, min_rows: int = MIN_ROWS) -> DataFrame:
    """Confirmed pivots per ticker.

    Each pivot depends on the one before, so a ticker is walked in one group; a group is
    one row per trading date and cannot outgrow the calendar. Work scales over tickers.
    """
    return swing_thresholds(prices, min_rows).groupBy("ticker_usd").applyInArrow(_pivots_of_group, PIVOT_SCHEMA)


def _impulse(q: list[Column], complete: bool) -> Column:
    """Impulse rules on log prices of consecutive pivots, written for the rising case."""
    rules = (q[2] > q[0]) & (q[3] > q[1]) & (q[4] > q[1])
    if not complete:
        return rules
    first, third, fifth = q[1] - q[0], q[3] - q[2], q[5] - q[4]
    return rules & (q[5] > q[3]) & ~((third < first) & (third < fifth))


def with_elliott(pivots: DataFrame) -> DataFrame:
    """Add ``elliott_senal``: the count visible when each pivot was confirmed, NULL without one."""
    w = by_date(date="nro_pivot")
    logp = F.log("precio")
    last6 = [F.lag(logp, k).over(w) if k else logp for k in range(5, -1, -1)]
    mirrored = [-c for c in last6]
    high, low = F.col("tipo") == "H", F.col("tipo") == "L"
    signal = ladder(
        [
            (high & _impulse(last6, True), "Impulso alcista completo"),
            (low & _impulse(mirrored, True), "Impulso bajista completo"),
            (low & _impulse(last6[1:], False), "Ondas 1-4 alcistas, 5 en curso"),
            (high & _impulse(mirrored[1:], False), "Ondas 1-4 bajistas, 5 en curso"),
        ]
    )
    return pivots.withColumn("elliott_senal", signal)


def wave_state(pivots: DataFrame, prices: DataFrame, min_rows: int = MIN_ROWS, rounded_output: bool = True) -> DataFrame:
    """Current swing, retracement and Fibonacci levels per ticker with two pivots or more."""
    r = rounded_output
    w = by_date(date="nro_pivot")
    labelled = pivots if "elliott_senal" in pivots.columns else with_elliott(pivots)
    last_two = labelled.withColumn("previo", F.lag("precio").over(w))
    state = last_two.groupBy("ticker_usd").agg(
        F.max("nro_pivot").alias("onda_pivots_total"),
        F.max_by(F.struct("tipo", "fecha", "precio", "previo", "elliott_senal"), F.col("nro_pivot")).alias("u"),
    )
    now = swing_thresholds(prices, min_rows).groupBy("ticker_usd").agg(
        F.max("fecha").alias("fecha"), F.max_by("adj_close", "fecha").alias("actual"), F.max("umbral_pct").alias("umbral_pct")
    )
    last, prev, current = F.col("u.precio"), F.col("u.previo"), F.col("actual")
    swing = last - prev
    back = ratio(last - current, swing) * 100
    nearest = F.array_min(
        F.array(*[F.struct(F.abs(F.lit(x) - back).alias("d"), F.lit(x).alias("nivel")) for x in FIB_LEVELS])
    )
    high = F.col("u.tipo") == "H"
    return (
        state.filter(F.col("onda_pivots_total") >= 2)
        .join(now, "ticker_usd")
        .select(
            "ticker_usd",
            "fecha",
            rounded(F.col("umbral_pct"), 1, r).alias("onda_umbral_pct"),
            "onda_pivots_total",
            F.when(high, "Máximo").otherwise("Mínimo").alias("onda_ultimo_pivot_tipo"),
            F.col("u.fecha").alias("onda_ultimo_pivot_fecha"),
            rounded(last, 2, r).alias("onda_ultimo_pivot_precio"),
            F.when(high, "Baja").otherwise("Suba").alias("onda_pierna_actual"),
            rounded(change_pct(current, last), 1, r).alias("onda_pierna_actual_pct"),
            rounded(change_pct(last, prev), 1, r).alias("onda_swing_previo_pct"),
            rounded(back, 1, r).alias("onda_fib_retroceso_pct"),
            F.when(nearest["d"] <= FIB_TOLERANCE, nearest["nivel"]).alias("onda_fib_nivel_cercano"),
            rounded(last - 0.382 * swing, 2, r).alias("onda_fib_382"),
            rounded(last - 0.5 * swing, 2, r).alias("onda_fib_500"),
            rounded(last - 0.618 * swing, 2, r).alias("onda_fib_618"),
            rounded(prev + 1.618 * swing, 2, r).alias("onda_fib_ext_1618"),
            F.coalesce("u.elliott_senal", F.lit("Sin patrón")).alias("onda_elliott_candidato"),
        )
    )


def pivot_outcomes(pivots: DataFrame, prices: DataFrame, forward: int = 63, prior: int = 126) -> DataFrame:
    """Return over ``forward`` rows from each pivot's confirmation date, with the momentum before it."""
    w = by_date()
    px = prices.filter(F.col("adj_close") > 0).select(
        "ticker_usd",
        F.col("fecha").alias("fecha_confirmacion"),
        "adj_close",
        F.lead("adj_close", forward).over(w).alias("p_fwd"),
        F.lag("adj_close", prior).over(w).alias("p_prev"),
    )
    labelled = pivots if "elliott_senal" in pivots.columns else with_elliott(pivots)
    return (
        labelled.join(px, ["ticker_usd", "fecha_confirmacion"])
        .filter(F.col("p_fwd").isNotNull() & F.col("p_prev").isNotNull())
        .select(
            "ticker_usd",
            "tipo",
            F.coalesce("elliott_senal", F.lit("(sin patrón)")).alias("senal"),
            F.when(F.col("adj_close") > F.col("p_prev"), "venía subiendo").otherwise("venía bajando").alias("momentum_6m"),
            (ratio("p_fwd", "adj_close") - 1).alias("ret_63d"),
        )
    )


def pivot_backtest(outcomes: DataFrame, by_momentum: bool = False) -> DataFrame:
    """Count, median, mean and share of positive outcomes per pivot kind and signal."""
    from tickerloom.functions.ordering import exact_quantiles

    keys = ["tipo", *(["momentum_6m"] if by_momentum else []), "senal"]
    stats = outcomes.groupBy(*keys).agg(
        F.count("*").alias("n"),
        (F.avg("ret_63d") * 100).alias("media_pct"),
        (F.avg(F.when(F.col("ret_63d") > 0, 1.0).otherwise(0.0)) * 100).alias("pct_positivo"),
    )
    medians = exact_quantiles(outcomes, keys, "ret_63d", {"m": 0.5}).select(*keys, (F.col("m") * 100).alias("mediana_pct"))
    return stats.join(medians, keys, "left")
