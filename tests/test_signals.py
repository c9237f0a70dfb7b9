"""Every signal against its rule, worked out in pandas on random series, and what stays quiet without data."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from conftest import TODAY, bars, sessions

from tickerloom.operators import signals as S


@pytest.fixture(scope="module")
def watch(spark):
    return lambda rows: spark.createDataFrame(list(rows), "ticker_usd string, moneda string")


@pytest.fixture(scope="module")
def market():
    """Forty tickers of different length: calm and wild walks, falls with and without a recovery, days of heavy volume."""
    r, out = np.random.default_rng(11), {}
    for k in range(40):
        n = int(r.integers(5, 140))
        drift = np.where(np.arange(n) < n - r.integers(0, 12), r.choice([-0.012, 0.0, 0.006]), 0.008)
        close = np.round(60 * np.exp(np.cumsum(drift + r.normal(0, r.choice([0.002, 0.015]), n))), 3)
        high, low = close * (1 + r.uniform(0.001, 0.04, n)), close * (1 - r.uniform(0.001, 0.04, n))
        volume = r.integers(800, 1200, n) * np.where(r.random(n) < 0.06, 4, 1)
        out[f"M{k}"] = pd.DataFrame({"close": close, "high": high, "low": low, "volume": volume}, index=sessions(n))
    return out


@pytest.fixture(scope="module")
def prices(table, market):
    return table("fact_precios_daily", [x for t, f in market.items() for x in bars(t, list(f.close), list(f.volume), list(f.high), list(f.low))])


def active(df):
    return {r.ticker_usd: r.activa for r in df.collect()}


def both_ways(got, want):
    assert got == want
    assert set(want.values()) == {True, False}


def test_currency_did_not_rise_in_five_rows(table, watch):
    r = np.random.default_rng(2)
    series = {f"USDX{k:02d}": np.round(4 + np.cumsum(r.normal(0, 0.05, int(r.integers(1, 12)))), 2) for k in range(30)}
    macro = table("fact_macro_daily", [{"serie": s, "fecha": d, "valor": float(v)} for s, vs in series.items() for d, v in zip(sessions(len(vs)), vs)])
    got = active(S.currency_stable(watch((f"T{s}", s) for s in series), macro, TODAY))
    both_ways(got, {f"T{s}": len(v) >= 6 and bool(v[-1] <= v[-6]) for s, v in series.items()})


def test_capitulation(market, prices, watch):
    def rule(f):
        usual = f.volume.rolling(90, min_periods=30).mean().shift(1)
        upper = (f.close - f.low) / (f.high - f.low) >= 0.5
        return len(f) >= 40 and bool(((f.volume >= 3 * usual) & upper).iloc[-10:].any())

    both_ways(active(S.capitulation(watch((t, None) for t in market), prices, TODAY)), {t: rule(f.iloc[-100:]) for t, f in market.items()})


def test_stopped_falling(market, prices, watch):
    def rule(f):
        if len(f) < 10:
            return False
        low = int(np.argmin(f.close.to_numpy()[-20:])) + max(0, len(f) - 20)
        top = f.close.iloc[max(0, low - 60) : low + 1].max()
        c = f.close.to_numpy()
        return bool(c[low] / top - 1 <= -0.15 and len(f) - 1 - low >= 3 and c[-1] / c[low] - 1 >= 0.03)

    both_ways(active(S.stopped_falling(watch((t, None) for t in market), prices, TODAY)), {t: rule(f.iloc[-80:]) for t, f in market.items()})


def test_post_report(table, market, prices, watch):
    r = np.random.default_rng(5)
    days = {t: TODAY - dt.timedelta(days=int(r.integers(-4, 16))) for t in market}

    def rule(f, day):
        before = f.close[pd.Index(f.index) < day]
        return bool(0 <= (TODAY - day).days <= 10 and len(before) and f.close.iloc[-1] / before.iloc[-1] - 1 >= -0.03)

    eps = table("fact_eps_trimestral", [{"ticker_usd": t, "fecha_reporte": d} for t, d in days.items()])
    both_ways(active(S.post_report(watch((t, None) for t in market), prices, eps, TODAY)), {t: rule(f, days[t]) for t, f in market.items()})


def test_rsi_recovers(market, prices, watch):
    def rule(f):
        move = f.close.diff()
        up, down = (move.clip(lower=0)).rolling(14).mean(), (-move.clip(upper=0)).rolling(14).mean()
        rsi = 100 * up / (up + down)
        return len(f) >= 20 and bool((rsi.iloc[-15:] < 30).any() and rsi.iloc[-1] > 30)

    both_ways(active(S.rsi_recovers(watch((t, None) for t in market), prices, TODAY)), {t: rule(f.iloc[-60:]) for t, f in market.items()})


def test_every_watched_ticker_has_its_rows_whatever_is_known(table, watch, prices):
    out = S.evaluate_signals(watch([("M1", None), ("UNSEEN", "USDQQQ")]), prices, table("fact_macro_daily", []), table("fact_eps_trimestral", []), TODAY)
    rows = {(r.ticker_usd, r.senal): r.activa for r in out.collect()}
    assert {s for t, s in rows if t == "UNSEEN"} == set(S.SIGNALS) and {s for t, s in rows if t == "M1"} == set(S.SIGNALS) - {"moneda_estable"}
    assert not any(on for (t, _), on in rows.items() if t == "UNSEEN")
