import datetime as dt

from conftest import TODAY, bars
from pyspark.sql import functions as F

from tickerloom.operators.news import news_sentiment
from tickerloom.schemas import TABLES
from tickerloom.sources.warehouse import Warehouse
from tickerloom.streaming import ingest as I


def test_stream_of_files_merges_like_a_batch(spark, table, tmp_path):
    table("fact_precios_daily", bars("A", [1.0, 2.0, 3.0])).coalesce(1).write.json(str(tmp_path / "in"), mode="append")
    wh = Warehouse(spark, str(tmp_path / "wh"))
    for extra in ([], bars("A", [9.0]) + bars("B", [4.0])):
        if extra:
            table("fact_precios_daily", extra).coalesce(1).write.json(str(tmp_path / "in"), mode="append")
        stream = I.file_stream(spark, str(tmp_path / "in"), TABLES["fact_precios_daily"].ddl)
        I.upsert_stream(stream, wh, "fact_precios_daily", str(tmp_path / "cp")).awaitTermination(120)
    assert sorted(r.close for r in wh.read("fact_precios_daily").collect()) == [1.0, 2.0, 4.0, 9.0]


def news(table):
    labels = ["positive", "negative", "neutral"]
    rows = [
        {"ticker_usd": f"T{i % 3}", "titular": f"h{i % 37}", "sentimiento": labels[i % 3 if i % 5 else 0], "score_sentimiento": (i % 10) / 10,
         "fecha_publicacion": dt.datetime.combine(TODAY - dt.timedelta(days=i % 12), dt.time(i % 24))}
        for i in range(120)
    ]
    return table("fact_noticias", rows)


def run(df, mode, name):
    df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start().awaitTermination(120)
    return df.sparkSession.table(name)


def test_headlines_pass_once(spark, table, tmp_path):
    news(table).write.parquet(str(tmp_path / "n"))
    stream = I.file_stream(spark, str(tmp_path / "n"), TABLES["fact_noticias"].ddl, "parquet")
    got = run(I.fresh_headlines(stream, "30 days"), "append", "titulares").select("ticker_usd", "titular")
    assert got.count() == got.distinct().count() == news(table).select("ticker_usd", "titular").distinct().count()


def test_sliding_sentiment_gives_the_batch_answer(spark, table, tmp_path):
    news(table).write.parquet(str(tmp_path / "n"))
    stream = I.file_stream(spark, str(tmp_path / "n"), TABLES["fact_noticias"].ddl, "parquet")
    got = run(I.sliding_sentiment(stream), "complete", "tono").filter(F.col("hasta") == F.lit(TODAY))
    cols = ["ticker_usd", "sent_titulares_total", "sent_positivas", "sent_negativas", "sent_neutrales", "sent_clasificacion"]
    batch = news_sentiment(news(table), TODAY)
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, batch.select(*cols).collect()))


def test_files_of_a_stream_become_more_with_the_rows(spark):
    from pathlib import Path

    from tickerloom.catalog.store import _files

    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64kb")
    try:
        numbers = [len(list(Path(_files(spark.range(n).selectExpr("id", "sha2(string(id), 512) AS t"), "parquet", n=None).removeprefix("file://")).glob("*.parquet"))) for n in (2_000, 40_000)]
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert numbers[1] > 8 * numbers[0] > 0
