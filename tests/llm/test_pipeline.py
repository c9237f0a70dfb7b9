import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parents[2]
sys.path.insert(0, str(ROOT))

import corpus_pipeline  # noqa: E402

from tickerloom.llm import exact, near  # noqa: E402
from tickerloom.llm.queries import QUERIES, SQL  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    own = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        own.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return own


@pytest.mark.parametrize("name", SQL)
def test_query_against_sql(spark, con, name):
    got = QUERIES[name](spark, SF).toPandas()
    want = con.sql(SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    same = [x[columns].convert_dtypes().astype(str).sort_values(columns).reset_index(drop=True) for x in (got, want)]
    assert same[0].equals(same[1])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_covers_all_documents(spark, name):
    ids = {r.doc_id for r in QUERIES[name](spark, SF).select("doc_id").distinct().collect()}
    assert ids == {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}


def test_stages(spark, docs, prose):
    rows = [(i, prose(i, 60)) for i in range(12)]
    rows += [(20, prose(3, 60)), (21, prose(4, 60).replace(" ", "  ")), (22, prose(5, 60) + " end"), (23, None), (24, "12 34"), (25, "")]
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    rows += [(26, prose(50, 20) + " " + benchmark + " " + prose(51, 20))]
    now, left = docs(rows), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, SF)
        left.append({r.doc_id for r in out.select("doc_id").collect()})
        assert name == "packing" or out.columns == now.columns
        now = out
    clean = set(range(12))
    assert left == [clean | {20, 21, 22, 26}, clean | {22, 26}, clean | {26}, clean, clean]
    empty = docs([])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_whole_pipeline(spark):
    ids = {r.doc_id for r in corpus_pipeline.run(spark, SF).select("doc_id").collect()}
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    copies = {r.doc_id for r in exact.exact_groups(documents).filter("not kept").collect()}
    alike = {r.doc_id for r in near.near_groups(documents).filter("not kept").collect()}
    leaking = {r.doc_id for r in QUERIES["op9_benchmark_leaks"](spark, SF).filter("contaminated").collect()}
    assert ids == {r.doc_id for r in documents.collect()} - copies - alike - leaking
