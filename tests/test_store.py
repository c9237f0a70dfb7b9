"""Commits of the warehouse: whole or not at all, none lost, each batch once."""

import datetime as dt

import pytest
from conftest import bars
from pyspark.sql import functions as F

from tickerloom.plans import merge as G
from tickerloom.sources.manifest import Contended, Edit, Manifest, Part, Snapshot
from tickerloom.sources.warehouse import Warehouse

PRICES = "fact_precios_daily"


def priced(table, ticker, year, closes):
    return table(PRICES, bars(ticker, closes, last=dt.date(year, 6, 28)))


@pytest.fixture
def wh(spark, tmp_path):
    return Warehouse(spark, str(tmp_path))


def rows(wh):
    return sorted((r.ticker_usd, r.fecha.year, r.close) for r in wh.read(PRICES).collect())


def test_a_number_is_taken_once(spark, tmp_path):
    manifest = Manifest(spark, str(tmp_path))
    assert manifest.latest() == Snapshot()
    first = Edit(whole={"t": [Part(None, "t/a")]}).over(Snapshot())
    assert manifest.put(first) and not manifest.put(Edit(whole={"t": [Part(None, "t/b")]}).over(Snapshot()))
    assert manifest.latest() == first and [s.getPath().getName() for s in manifest.listing("_log") if not s.getPath().getName().endswith("json")] == []


def test_an_upsert_that_dies_between_years_changes_nothing(wh, table, monkeypatch):
    wh.upsert(PRICES, priced(table, "A", 2024, [1.0]).unionByName(priced(table, "A", 2025, [2.0])))
    before, real = rows(wh), wh.manifest.put
    with monkeypatch.context() as m:
        m.setattr(wh.manifest, "put", lambda _: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            wh.upsert(PRICES, priced(table, "A", 2024, [8.0]).unionByName(priced(table, "A", 2025, [9.0])))
    assert rows(wh) == before and wh.manifest.put == real
    wh.upsert(PRICES, priced(table, "A", 2025, [9.0]))
    assert rows(wh) == [("A", 2024, 1.0), ("A", 2025, 9.0)]


def test_a_write_that_fails_in_a_task_changes_nothing(wh, table, spark):
    wh.upsert(PRICES, priced(table, "A", 2024, [1.0]))
    bad = priced(table, "B", 2024, [2.0]).withColumn("close", F.raise_error(F.lit("torn")).cast("double"))
    with pytest.raises(Exception, match="torn"):
        wh.upsert(PRICES, bad)
    assert rows(wh) == [("A", 2024, 1.0)]


@pytest.mark.parametrize("other_year, merges", [(2025, 1), (2024, 2)])
def test_two_writers_lose_no_rows(wh, table, spark, other_year, merges):
    wh.upsert(PRICES, priced(table, "A", 2024, [1.0]).unionByName(priced(table, "A", 2025, [1.0])))
    rival, done = Warehouse(spark, wh.root), []

    def slow(stored, batch, key):
        done.append(1)
        if len(done) == 1:  # the rival commits between this writer's reading and its commit
            rival.upsert(PRICES, priced(table, "B", other_year, [5.0]))
        return G.upsert_overwrite(stored, batch, key)

    wh.upsert(PRICES, priced(table, "C", 2024, [7.0]), slow)
    assert rows(wh) == sorted([("A", 2024, 1.0), ("A", 2025, 1.0), ("B", other_year, 5.0), ("C", 2024, 7.0)])
    assert len(done) == merges  # a year nobody else touched is not merged again


def test_endless_rivals_are_reported(wh, monkeypatch):
    monkeypatch.setattr(wh.manifest, "put", lambda _: False)
    with pytest.raises(Contended):
        wh.manifest.commit(lambda _: Edit(), attempts=3)


def test_a_reader_keeps_its_snapshot(wh, table):
    wh.upsert(PRICES, priced(table, "A", 2024, [1.0]))
    held = wh.read(PRICES)
    wh.upsert(PRICES, priced(table, "A", 2024, [2.0]))
    assert [r.close for r in held.collect()] == [1.0] and [r.close for r in wh.read(PRICES).collect()] == [2.0]


def test_a_purge_rewrites_only_the_years_of_those_that_leave(wh, table, spark):
    wh.rewrite("dim_empresa", table("dim_empresa", [{"ticker_usd": t} for t in ("A", "B", "C")]))
    for ticker, year in (("A", 2023), ("B", 2023), ("A", 2024), ("C", 2025), ("A", 2025)):
        wh.upsert(PRICES, priced(table, ticker, year, [1.0]))
    wh.upsert("fact_metrics_daily", table("fact_metrics_daily", [{"ticker_usd": "A", "fecha": dt.date(2024, 1, 2)}]))
    before = wh.manifest.latest()
    keep = spark.createDataFrame([("A",), ("B",)], "ticker_usd string")
    assert [r[0] for r in wh.purge_rows(keep, min_share=0.5).collect()] == ["C"]
    after = wh.manifest.latest()
    assert after.number == before.number + 1
    assert [y for y in before.years(PRICES) if before.parts(PRICES, y) != after.parts(PRICES, y)] == [2025]
    assert before.parts("fact_metrics_daily") == after.parts("fact_metrics_daily")
    assert rows(wh) == [("A", 2023, 1.0), ("A", 2024, 1.0), ("A", 2025, 1.0), ("B", 2023, 1.0)]
    assert {r.ticker_usd for r in wh.keys(PRICES).collect()} == {"A", "B"} and wh.read("dim_empresa").count() == 2
    assert wh.purge_rows(spark.createDataFrame([("A",)], "ticker_usd string")).count() == 0  # the valve holds
    assert wh.purge(keep) == []


def test_a_batch_counts_once_whatever_the_merge(wh, table):
    def add(stored, batch, key):
        return stored.unionByName(batch.select(*stored.columns))

    for number in (0, 1, 1, 0):
        wh.upsert(PRICES, priced(table, f"T{number}", 2024, [float(number)]), add, stream=("prices", number))
    assert rows(wh) == [("T0", 2024, 0.0), ("T1", 2024, 1.0)] and wh.manifest.latest().batches == {"prices": 1}
    old = priced(table, "T1", 2024, [3.0])
    wh.replace_slices(PRICES, old, ["ticker_usd"], stream=("prices", 1))
    assert ("T1", 2024, 1.0) in rows(wh)
    wh.replace_slices(PRICES, old, ["ticker_usd"], stream=("prices", 2))
    assert rows(wh) == [("T0", 2024, 0.0), ("T1", 2024, 3.0)]


def test_appends_are_joined_and_leftovers_removed(wh, table, monkeypatch):
    monkeypatch.setattr("tickerloom.sources.warehouse.MANY_PARTS", 3)
    for i in range(5):
        wh.append("log_ejecuciones", table("log_ejecuciones", [{"script": f"s{i}"}]))
    assert wh.read("log_ejecuciones").count() == 5 and len(wh.manifest.latest().parts("log_ejecuciones")) < 4
    gone = wh.vacuum(keep=1, older_than_hours=0)
    assert gone and wh.read("log_ejecuciones").count() == 5 and wh.vacuum(keep=1, older_than_hours=0) == []
