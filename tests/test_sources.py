import datetime as dt
import json

import pytest
from conftest import TODAY
from pyspark.sql import functions as F

from tickerloom.sources import files as S
from tickerloom.sources import sinks


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")


def test_price_files(spark, tmp_path):
    head = "Date,Open,High,Low,Close,Adj Close,Volume\n"
    write(tmp_path / "p" / "BRK-B.csv", head + "2024-01-02 00:00:00-05:00,1,2,0.5,1.5,1.4,100\n2024-07-02 22:00:00-04:00,1,2,0.5,1.5,1.4,100\n")
    write(tmp_path / "p" / "GGAL.csv", head + "2024-01-02,9,9,9,9,8,7\n")
    raw = S.read_price_files(spark, str(tmp_path / "p"))
    symbols = spark.createDataFrame([("BRKB", "BRK-B"), ("NONE", "X")], "ticker_usd string, ticker_yahoo string")
    rows = S.price_rows(raw, symbols).orderBy("fecha").collect()
    assert [(r.ticker_usd, r.fecha) for r in rows] == [("BRKB", dt.date(2024, 1, 2)), ("BRKB", dt.date(2024, 7, 3))]
    assert rows[0].adj_close == 1.4 and rows[0].volume == 100
    pairs = spark.createDataFrame([("YPFD", "GGAL")], "ticker_usd string, ticker_adr string")
    adr, = S.adr_price_rows(raw, pairs).collect()
    assert (adr.ticker_usd, adr.ticker_adr, adr.close) == ("YPFD", "GGAL", 9.0)


def test_series_files_drop_open_bars(spark, tmp_path):
    write(tmp_path / "m" / "VIX.csv", "Date,Close\n2024-01-02,14.5\n2024-01-03,\n")
    assert [tuple(r) for r in S.series_rows(S.read_series_files(spark, str(tmp_path / "m"))).collect()] == [("VIX", dt.date(2024, 1, 2), 14.5)]


def test_mid_quotes(spark):
    rows = [("contadoconliqui", 1000.0, 1010.0, "2024-01-02"), ("blue", 1649.2, 1654.0, "2024-01-02"), ("blue", None, 1000.0, "2024-01-03"), ("otra", 1.0, 1.0, "2024-01-03")]
    got = {r.serie: r.valor for r in S.mid_quotes(spark.createDataFrame(rows, S.QUOTE_SCHEMA)).collect()}
    assert got == {"AR_CCL": 1005.0, "AR_BLUE": 1651.6} and len(S.QUOTE_SERIES) == 7


def test_snapshot(spark, tmp_path):
    write(tmp_path / "s" / "a.json", json.dumps({"ticker": "A", "info": {"grossMargins": 0.4786, "trailingPE": 12.345, "currency": "USD", "financialCurrency": "BRL"}}))
    snap = spark.read.schema(S.SNAPSHOT_SCHEMA).json(str(tmp_path / "s"))
    row, = S.snapshot_metrics(snap, F.lit(TODAY)).collect()
    assert row.margen_bruto_pct == 47.9 and row.pe_trailing == pytest.approx(12.35, abs=0.011) and row.beta is None
    uni = spark.createDataFrame([("A", "usa_otros"), ("B", "usa_otros")], "ticker_usd string, mercado string")
    dim, = S.snapshot_dimension(snap, uni).collect()
    assert (dim.ticker_usd, dim.moneda_cotizacion, dim.moneda_balance, dim.sector) == ("A", "USD", "BRL", None)


def test_statements(spark, tmp_path):
    data = {
        "ticker": "A", "ingresos_anuales": {"2022-12-31": 100.0, "2023-12-31": 0.0}, "ganancia_anual": {"2022-12-31": 12.34, "2021-12-31": 5.0},
        "deuda_anual": {"2022-12-31": 7.0}, "fcf_anual": {"2021-12-31": 3.0}, "eps_anual": {"2022-12-31": 1.5},
        "eps_trimestral": [{"fecha": f"2024-0{i}-01", "eps_reportado": None if i == 7 else 1.0} for i in range(7, 0, -1)],
    }
    write(tmp_path / "e" / "a.json", json.dumps(data))
    st = spark.read.schema(S.STATEMENT_SCHEMA).json(str(tmp_path / "e"))
    inc = {r.fecha_balance.year: r for r in S.income_rows(st).collect()}
    assert set(inc) == {2021, 2022, 2023} and inc[2022].margen_neto_pct == 12.3 and inc[2021].ingresos is None and inc[2023].margen_neto_pct is None
    bal = {r.fecha_balance.year: (r.deuda_total, r.efectivo, r.flujo_caja_libre) for r in S.balance_rows(st).collect()}
    assert bal == {2022: (7.0, None, None), 2021: (None, None, 3.0)}
    eps = S.eps_rows(st).collect()
    assert len(eps) == 7 and [r.fecha_reporte.month for r in eps][:5] == [7, 6, 5, 4, 3] and eps[0].eps_reportado is None
    assert [(r.fecha_balance.year, r.eps) for r in S.eps_annual_rows(st).collect()] == [(2022, 1.5)]


def test_quarterly(spark):
    q = dt.date(2024, 3, 31)
    ddl = "ticker_usd string, concepto string, fecha date, valor double"
    results = spark.createDataFrame([("A", "Total Revenue", q, 10.0), ("A", "Diluted EPS", q, 1.0), ("A", "Ignored", q, 5.0)], ddl)
    cash = spark.createDataFrame([("A", "Repurchase Of Capital Stock", q, -4.0), ("B", "Free Cash Flow", q, 1.0)], ddl)
    row, = S.quarterly_rows(results, cash).collect()
    assert (row.ticker_usd, row.ingresos, row.eps_diluido, row.recompras, row.ganancia_neta) == ("A", 10.0, 1.0, 4.0, None)
    files = spark.createDataFrame([("A", {"2024-03-31": {"Total Revenue": 10.0, "Net Income": None}})], "ticker_usd string, resultados map<string, map<string,double>>")
    assert {(r.concepto, r.valor) for r in S.quarterly_long(files, "resultados").collect()} == {("Total Revenue", 10.0), ("Net Income", None)}


def test_insiders(spark):
    rows = [(10.0, 5.0, " Purchase at price 1", "I", "CEO", "2024-01-02T00:00:00"), (None, None, "Sale at 3", "J", "D", "2024-01-03"), (1.0, 1.0, None, "K", "D", "2024-01-03")]
    raw = spark.createDataFrame(rows, S.INSIDER_SCHEMA).withColumn("ticker_usd", F.lit("T"))
    got = S.insider_rows(raw).collect()
    assert [r.tipo for r in got] == ["Compra", "Venta", "Otro"] and got[0].fecha == dt.date(2024, 1, 2) and got[1].acciones is None


def test_consensus_keeps_uncovered_companies(spark, tmp_path):
    lines = [{"ticker": "A", "targets": {"median": 5.0}, "recommendations": [{"period": "-1m", "buy": 9}, {"period": "0m", "buy": 3}]}, {"ticker": "B"}]
    write(tmp_path / "c" / "c.json", "\n".join(map(json.dumps, lines)))
    got = {r.ticker_usd: r for r in S.consensus_rows(spark.read.schema(S.CONSENSUS_SCHEMA).json(str(tmp_path / "c")), F.lit(TODAY)).collect()}
    assert got["A"].precio_objetivo_mediana == 5.0 and got["A"].rec_buy == 3 and got["B"].rec_buy is None


def test_news_feed(spark, tmp_path):
    item = lambda i, date, title: f"<item><title>{title}</title><link>l{i}</link><pubDate>{date}</pubDate><source url='u'>S{i}</source></item>"
    good = "Wed, 18 Nov 2026 10:00:00 GMT"
    items = [item(0, good, ""), item(1, "Mon, 02 Nov 2026 10:00:00 GMT", "old"), item(2, "junk", "undated")] + [item(i, good, f"t{i}") for i in range(3, 40)]
    write(tmp_path / "n" / "NU.xml", "<rss><channel>" + "".join(items) + "</channel></rss>")
    got = S.news_items(S.read_news_files(spark, str(tmp_path / "n")), TODAY).orderBy("orden").collect()
    assert [r.titular for r in got] == [f"t{i}" for i in range(3, 40)]
    assert got[0].fuente == "S3" and got[0].ticker_usd == "NU" and got[0].fecha_publicacion == dt.datetime(2026, 11, 18, 10)


def test_sinks(spark, tmp_path):
    mon = spark.createDataFrame([("A", ["x", "y"]), ("B", [])], "ticker_usd string, alertas array<string>")
    alerts = sinks.alert_rows(mon, "cartera")
    assert [(r.ticker_usd, r.alerta) for r in alerts.orderBy("alerta").collect()] == [("A", "x"), ("A", "y")]
    sinks.write_alerts(alerts, str(tmp_path / "a"))
    sinks.write_alerts(alerts.filter("false"), str(tmp_path / "a"))
    assert spark.read.schema("ticker_usd string").json(str(tmp_path / "a")).count() == 0
    sinks.export_csv(mon.select("ticker_usd"), str(tmp_path / "c"))
    assert {r.ticker_usd for r in spark.read.option("header", True).csv(str(tmp_path / "c")).collect()} == {"A", "B"}
    sinks.publish_view(mon, "vista_prueba")
    assert spark.table("vista_prueba").count() == 2


def test_price_files_do_not_grow_with_the_symbols(spark, tmp_path):
    from tickerloom.catalog import feeds

    rows = [(f"S{i}", dt.date(2024, 1, 2), 1.0, float(i), 7) for i in range(40)] + [(None, dt.date(2024, 1, 2), 1.0, 1.0, 7), ("S3", None, 1.0, 3.5, 7)]
    feeds._price_files(spark.createDataFrame(rows, "t string, fecha date, open double, close double, volume long").coalesce(2), F.col("t"), str(tmp_path / "p"))
    assert len(list((tmp_path / "p").rglob("*.csv"))) <= 2
    symbols = spark.createDataFrame([(f"T{i}", f"S{i}") for i in range(39)], "ticker_usd string, ticker_yahoo string")
    got = S.price_rows(S.read_bulk_price_files(spark, str(tmp_path / "p")), symbols).select("ticker_usd", "fecha", "open", "high", "close", "adj_close", "volume").collect()
    day = dt.date(2024, 1, 3)  # late evening in New York
    assert sorted(map(tuple, got), key=str) == sorted([*[(f"T{i}", day, 1.0, None, float(i), None, 7) for i in range(39)], ("T3", None, 1.0, None, 3.5, None, 7)], key=str)


def test_news_files_do_not_grow_with_the_tickers(spark, tmp_path, monkeypatch):
    from tickerloom.catalog import QUERIES, feeds

    data = {
        "documents": spark.createDataFrame([(i, "x", "en", "web", 10) for i in range(1, 90)], "doc_id long, text string, lang string, source string, n_chars long"),
        "labels": spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int"),
        "supplier": spark.range(30).select(F.col("id").alias("s_suppkey")),
    }
    for name, df in data.items():
        df.coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    monkeypatch.setattr(feeds, "scratch", lambda spark, name: str(tmp_path / name))
    got = QUERIES["xml_news_items"].dataframe(spark, str(tmp_path)).collect()
    assert sorted((r.ticker_usd, r.link) for r in got) == sorted((f"S{i % 30}", f"http://feed/{i}?a=1&b=2") for i in range(1, 90) if i % 13 and i % 17)
    assert 0 < len([p for p in (tmp_path / "rss").rglob("part-*") if p.suffix != ".crc"]) < 10


def test_items_of_many_tickers_in_a_file(spark, tmp_path):
    rows = [("B", "b1"), ("A", "a1"), (None, "n1"), ("B", "b2")]
    items = "".join(f"<item><title>{t}</title><pubDate>Wed, 18 Nov 2026 10:00:00 GMT</pubDate>" + (f"<ticker_usd>{k}</ticker_usd>" if k else "") + "</item>" for k, t in rows)
    write(tmp_path / "n" / "all.xml", "<rss><channel>" + items + "</channel></rss>")
    got = S.read_news_files(spark, str(tmp_path / "n"), named=True).collect()
    assert sorted((r.ticker_usd or "", r.orden, r.title) for r in got) == [("", 1, "n1"), ("A", 1, "a1"), ("B", 1, "b1"), ("B", 2, "b2")]
