"""Loads with a file ledger, and records that can not be used."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tickerloom.plans import load as LD
from tickerloom.sources import files as S
from tickerloom.sources import records as R
from tickerloom.sources.warehouse import Warehouse

HEAD = "Date,Open,High,Low,Close,Adj Close,Volume\n"


def deliver(folder, name, *closes):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(HEAD + "".join(f"2024-01-{d:02d},1,2,0.5,{c},{c},100\n" for d, c in enumerate(closes, 1)), encoding="utf-8")


@pytest.fixture
def feed(spark, tmp_path):
    symbols = spark.createDataFrame([("A", "A"), ("B", "B")], "ticker_usd string, ticker_yahoo string")
    return LD.Feed("precios", "fact_precios_daily", str(tmp_path / "in"), S.read_price_files, lambda raw: S.price_rows(raw, symbols), guard_days=0)


def closes(wh):
    return sorted((r.ticker_usd, r.fecha.day, r.close) for r in wh.read("fact_precios_daily").collect())


def test_two_days_loaded_twice(spark, tmp_path, feed):
    wh, folder = Warehouse(spark, str(tmp_path / "wh")), tmp_path / "in"
    deliver(folder / "monday", "A.csv", 1.0, 2.0)
    deliver(folder / "monday", "B.csv", 5.0)
    assert LD.load(wh, feed) == LD.Loaded(2, 3) and LD.load(wh, feed) == LD.Loaded(0, 0)
    first = closes(wh)
    deliver(folder / "tuesday", "A.csv", 1.0, 2.5, 3.0)
    assert LD.load(wh, feed) == LD.Loaded(1, 3) and LD.load(wh, feed) == LD.Loaded(0, 0)
    assert first == [("A", 1, 1.0), ("A", 2, 2.0), ("B", 1, 5.0)]
    assert closes(wh) == [("A", 1, 1.0), ("A", 2, 2.5), ("A", 3, 3.0), ("B", 1, 5.0)]
    deliver(folder / "monday", "B.csv", 6.0, 7.0)  # a file that changed is new
    assert LD.load(wh, feed) == LD.Loaded(1, 2) and ("B", 2, 7.0) in closes(wh)
    ledger = wh.read(LD.LEDGER)
    assert ledger.count() == 4 and ledger.agg(F.sum("filas")).first()[0] == 8


def test_a_load_that_dies_leaves_neither_rows_nor_ledger(spark, tmp_path, feed, monkeypatch):
    wh = Warehouse(spark, str(tmp_path / "wh"))
    deliver(tmp_path / "in", "A.csv", 1.0)
    with monkeypatch.context() as m:
        m.setattr(wh, "upsert", lambda *a, **k: (_ for _ in ()).throw(OSError("disk")))
        done = LD.load_all(wh, [feed, LD.Feed("vacio", "fact_macro_daily", str(tmp_path / "in"), S.read_series_files, lambda raw: S.series_rows(raw).limit(0))])
    assert isinstance(done["precios"], OSError) and closes(wh) == [] and wh.read(LD.LEDGER).filter("carga = 'precios'").count() == 0
    assert LD.load(wh, feed) == LD.Loaded(1, 1)
    states = sorted((r.script, r.estado) for r in wh.read("log_ejecuciones").collect())
    assert ("precios", "error") in states and ("precios", "ok") in states


def test_the_guard_skips_a_feed_that_ran(spark, tmp_path, feed):
    wh, today = Warehouse(spark, str(tmp_path / "wh")), dt.datetime.now(dt.timezone.utc).date()
    deliver(tmp_path / "in", "A.csv", 1.0)
    assert not LD.load(wh, feed, today).skipped
    deliver(tmp_path / "in", "B.csv", 2.0)
    assert LD.load(wh, feed, today) == LD.Loaded(0, 0, True) and len(closes(wh)) == 1
    assert LD.load(wh, feed, today + dt.timedelta(days=1)).files == 1


SCHEMA = "ticker string, n int, info struct<x:double>, m map<string,double>"


@pytest.mark.parametrize(
    ("line", "reasons"),
    [
        ('{"ticker": "A", "n": 1, "info": {"x": 2.5}, "m": {"2024-01-01": 1}}', []), ('{"ticker": "A"}', ["n"]), ('{"n": 3}', ["ticker"]), ("", [R.EMPTY]), (None, [R.EMPTY]), ("   ", [R.EMPTY]),
        ('{"ticker": "A", "n"', [R.BROKEN]), ("[1, 2]", [R.BROKEN]), ("null", [R.BROKEN]), ('{"ticker": "A", "n": "many"}', [R.BROKEN]), ('{"ticker": "A", "n": 1, "m": {"d": "x"}}', [R.BROKEN]),
        ('{"n": null, "unknown": 1}', ["ticker", "n"]), ("no json", [R.BROKEN]),
    ],
)
def test_every_line_is_good_or_has_reasons(spark, line, reasons):
    lines = spark.createDataFrame([(line, "f")], "texto string, archivo string")
    judged = R.judged(lines, SCHEMA, {"ticker": F.col("registro.ticker").isNotNull(), "n": F.col("registro.n") > 0})
    assert [r.motivos for r in judged.collect()] == [reasons]
    assert R.good(judged).count() == (not reasons) and R.rejected(judged).count() == bool(reasons)
    assert [r.texto for r in R.rejected(judged).collect()] == [line] * bool(reasons)


def test_good_records_keep_nested_values(spark):
    lines = spark.createDataFrame([('{"ticker": "A", "n": 1, "info": {"x": 2.5}, "m": {"d": 1, "e": null}}', "f")], "texto string, archivo string")
    row = R.good(R.judged(lines, SCHEMA)).first()
    assert (row.ticker, row.n, row.info.x, row.m) == ("A", 1, 2.5, {"d": 1.0, "e": None})
