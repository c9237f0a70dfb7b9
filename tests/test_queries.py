"""Every registered query against its SQL on the smallest provided data."""

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT / "scripts"))

from check_oracle import DATA, check, duck  # noqa: E402

from tickerloom.catalog import QUERIES  # noqa: E402

SF = DATA / "sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, name):
    diff, _, _ = check(spark, con, SF, QUERIES[name])
    assert diff is None


def test_entry_points(spark):
    sys.path.insert(0, str(ROOT))
    import __spark_entry__ as entry_points

    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
    assert entry_points.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["watch_states", "watchlist_alerts", "country_ranking", "pivot_backtest", "pivot_backtest_momentum"])
def test_lines_are_rolled_up_once(spark, monkeypatch, name):
    from tickerloom.sources import adapters as A

    calls = []
    for table in ("bars", "metrics"):
        monkeypatch.setattr(A, table, lambda *a, real=getattr(A, table), table=table: calls.append(table) or real(*a))
    QUERIES[name].dataframe(spark, str(SF))
    assert max(map(calls.count, calls)) == 1


@pytest.mark.parametrize("name", ["portfolio_candidates", "external_alerts"])
def test_candidates_read_the_lines_once_for_bars_and_once_for_sums(spark, name):
    plan = QUERIES[name].dataframe(spark, str(SF))._jdf.queryExecution().optimizedPlan().toString()
    used = [line for line in plan.splitlines() if "Relation [" not in line]
    assert not any("l_extendedprice" in line for line in used) and any("l_shipdate" in line for line in used)  # only the newest day is still looked up


def test_years_added_up_from_months(spark, tmp_path):
    import datetime as dt

    from tickerloom.sources import adapters as A

    day = dt.datetime
    rows = [(1, day(1995, m, 3), 10.25 * m, 0.05, 0.02, 3.0, "NRA"[m % 3], "OF"[m % 2]) for m in range(1, 13)] * 2
    rows += [(1, day(1996, 2, 29), 7.5, None, 0.01, 2.0, "N", "O"), (None, day(1995, 5, 1), 1.0, 0.1, 0.1, 1.0, None, None), (2, None, 5.0, 0.0, 0.0, 4.0, "A", "F"), (2, day(1995, 1, 1), None, 0.0, 0.0, None, "R", "O")]
    names = "l_suppkey long, l_shipdate timestamp, l_extendedprice double, l_discount double, l_tax double, l_quantity double, l_returnflag string, l_linestatus string"
    spark.createDataFrame(rows, names).write.parquet(f"{tmp_path}/lineitem.parquet")
    months = A.lines_by_month(spark, str(tmp_path))
    for read in (A.balances, A.consensus):
        alone, added = (sorted(map(repr, df.collect())) for df in (read(spark, str(tmp_path)), read(spark, str(tmp_path), months)))
        assert alone == added and len(alone) == 5


def test_stored_drops_its_shuffle_and_leaves_the_session_as_it_was(spark, tmp_path):
    from tickerloom.sources import scratch as X

    tracker = spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    before, held = spark.conf.get(X._CLEANUP, None), tracker.shuffleStatuses().size()
    df = X.stored_by(spark.range(1000).selectExpr("id % 7 as k", "id").groupBy("k").count(), "k", "count", "few")
    assert sorted(r["count"] for r in df.collect()) == [142] + [143] * 6
    assert spark.conf.get(X._CLEANUP, None) == before and tracker.shuffleStatuses().size() <= held
