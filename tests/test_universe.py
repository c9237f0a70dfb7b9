import numpy as np
from pyspark.sql import functions as F

from tickerloom.operators import universe as U


def panel(spark, rows):
    return spark.createDataFrame(rows, "simbolo string, descripcion string")


ETFS = [
    ("SPY", "Spdr S&P 500 Etf Trust"), ("SPYC", "Spdr S&P 500"), ("SPYD", "Spdr S&P 500"), ("XLK", "The Technology Select Sector Spdr"),
    ("XLKC", "The Technology Select S"), ("XLCC", "The Communication Servi"), ("XLYC", "The Consumer Discretion"), ("XLYD", "The Consumer Discret"),
    ("QQQ", "Invesco QQQ Trust"), ("GLDD", "Spdr gold"), ("AAPL", "Cedear Apple Inc."), ("AAPLC", "Cedear Apple Inc."),
]


def test_etfs_split_with_cut_descriptions(spark):
    split = U.split_etfs(panel(spark, ETFS))
    assert {r.simbolo for r in split.filter("not es_etf").collect()} == {"AAPL", "AAPLC"}
    rows = {r.ticker_usd: r for r in U.etf_rows(split.filter("es_etf")).collect()}
    assert set(rows) == {"SPY", "XLK", "XLC", "XLY", "QQQ", "GLDD"}
    assert rows["SPY"].variantes == "SPY, SPYC, SPYD" and rows["SPY"].nombre_empresa == "Spdr S&P 500 Etf Trust"
    assert rows["XLY"].variantes == "XLYC, XLYD" and rows["XLY"].mercado == "etf"


def union_find(keys):
    """Plain all-pairs grouping, as a check on the prefix join."""
    parent = {k: k for k in keys}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in parent:
        for b in parent:
            if a != b and len(a) >= 6 and b.startswith(a):
                parent[root(a)] = root(b)
    return {k: root(k) for k in parent}


def test_prefix_groups_against_all_pairs(spark):
    rng = np.random.default_rng(0)
    keys = sorted({"".join(rng.choice(list("ab"), int(rng.integers(3, 14)))) for _ in range(400)})
    got = {r.clave: r.grupo for r in U.prefix_groups(spark.createDataFrame([(k,) for k in keys], "clave string")).collect()}
    expected = union_find(keys)
    groups = lambda m: sorted(sorted(k for k in m if m[k] == g) for g in set(m.values()))
    assert groups(got) == groups(expected)


def test_only_lengths_that_occur_are_probed(spark):
    keys = ["abcdef", "abcdefgh", "abcdef" + "x" * 200, "zzzzzz" + "y" * 50, "short"]
    got = {(r.clave[:8], len(r.prefijo)) for r in U.offered_prefixes(spark.createDataFrame([(k,) for k in keys], "clave string")).collect()}
    assert got == {("abcdef", 6), ("abcdefgh", 6), ("abcdefgh", 8), ("abcdefxx", 6), ("abcdefxx", 8), ("abcdefxx", 206), ("zzzzzzyy", 56)}


def test_companies_keep_the_shortest_symbol_and_the_longest_name(spark):
    rows = [("ADBEC", "Cedear Adobe Systems Incorpor"), ("ADBE", "Cedear Adobe Systems Incorporated."), ("ADBED", "Adobe Sys"), ("BA", "Boeing Co"), ("BA.C", "Bank Of America"),
            ("RENT3", "Localiza"), ("AZNC", "Aztrazeneca"), ("BPA11", "Btg Pactual"), ("BRKB", "Berkshire")]
    got = {r.ticker_usd: r for r in U.company_rows(panel(spark, rows)).collect()}
    assert set(got) == {"ADBE", "BA", "BA.C", "RENT3", "BPA11", "BRKB"}
    assert got["ADBE"].nombre_empresa == "Adobe Systems Incorporated" and got["ADBE"].variantes == "ADBE, ADBEC, ADBED"
    assert got["BA.C"].ticker_yahoo == "BAC" and got["BRKB"].ticker_yahoo == "BRK-B" and got["BPA11"].ticker_yahoo == "BPAC11.SA"
    assert got["RENT3"].mercado == "brasil" and got["BA"].mercado == "usa_otros"


def test_universe_has_all_four_parts(spark):
    local = panel(spark, [("GGAL", "Grupo Financiero Galicia"), ("YPFD", "YPF"), ("ALUA", "Aluar")])
    uni = U.universe(panel(spark, ETFS), local)
    by = {r.ticker_usd: r for r in uni.collect()}
    assert by["YPFD"].ticker_adr_usa == "YPF" and by["YPFD"].ticker_yahoo == "YPFD.BA" and by["BTC"].mercado == "cripto"
    assert uni.count() == len(by) == 6 + 1 + 3 + 3
    assert {r.ticker_usd for r in U.has_fundamentals(uni).collect()} == {"AAPL", "GGAL", "YPFD", "ALUA"}
    assert {(r.ticker_usd, r.ticker_adr) for r in U.adr_pairs(uni).collect()} == {("GGAL", "GGAL"), ("YPFD", "YPF")}


def test_title_case_follows_every_separator(spark):
    df = spark.createDataFrame([("o'reilly s.a. (ñandú) 3m",)], "t string").select(U.title_case(F.col("t")).alias("t"))
    assert df.collect()[0].t == "o'reilly s.a. (ñandú) 3m".title()
