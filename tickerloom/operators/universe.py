"""From raw panels of listed symbols to the universe of companies, ETFs, local shares and crypto."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_PREFIX = 6

# Description pattern of an ETF, symbols whose base is not on the panel, duplicates of a company
# listed under another base, symbols the price source spells differently, local shares with a US ADR, and crypto.
ETF_PATTERN = (
    r"(?i)\betf\b|select sector|spdr|ishares|invesco|proshares|direxion"
    r"|van eck|vanguard|global x|\bipath\b|\btrust\b|\bfund\b"
)
ETF_BASE = {"XLCC": "XLC", "XLYC": "XLY", "XLYD": "XLY"}
DUPLICATE_STEMS = ["AZN", "BMY", "SHEL", "MDT", "IBM", "IFF", "UGP"]
DUPLICATE_SYMBOLS = ["GOGLC", "BKC*", "VAL3C", "BMNRD"]
PRICE_SYMBOL = {
    "BBAS3": "BBAS3.SA", "ITUB3": "ITUB3.SA", "SBSP3": "SBSP3.SA", "HAPV3": "HAPV3.SA", "RENT3": "RENT3.SA",
    "LREN3": "LREN3.SA", "MGLU3": "MGLU3.SA", "PRIO3": "PRIO3.SA", "SUZB3": "SUZB3.SA", "TIMS3": "TIMS3.SA",
    "WEGE3": "WEGE3.SA", "BPA11": "BPAC11.SA", "BRKB": "BRK-B", "BA.C": "BAC", "BNG": "BG", "KOFM": "KOF",
    "NOKA": "NOK", "PKS": "PKX", "TXR": "TX", "TRVV": "TRV", "DISN": "DIS", "WBO": "WB", "XROX": "XRX",
    "BBV": "BBVA", "ADGO": "AGRO", "BAYN": "BAYRY", "YZCA": "YZCAY", "ADS": "ADS.DE", "AKO.B": "AKO-B",
    "SMSN": "SMSN.IL",
}
LOCAL_ADR = {
    "GGAL": "GGAL", "BMA": "BMA", "YPFD": "YPF", "PAMP": "PAM", "CRES": "CRESY", "SUPV": "SUPV", "LOMA": "LOMA",
    "EDN": "EDN", "TGSU2": "TGS", "TECO2": "TEO", "BBAR": "BBAR", "IRSA": "IRS", "CEPU": "CEPU",
}
CRYPTO = [("BTC", "BTC-USD", "Bitcoin"), ("ETH", "ETH-USD", "Ethereum"), ("SOL", "SOL-USD", "Solana")]

UNIVERSE_COLUMNS = ["ticker_usd", "ticker_cedear", "ticker_yahoo", "ticker_adr_usa", "mercado", "nombre_empresa", "variantes"]


def lookup(table: dict[str, str], key: Column) -> Column:
    """Value of a short literal map; NULL for an unlisted key."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)


def title_case(text: Column) -> Column:
    """Every run of letters capitalised, whatever separates the runs."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda run: F.initcap(run)), "")


def company_name(description: Column) -> Column:
    """Description without the leading 'Cedear' and without trailing dots and commas."""
    bare = F.trim(F.regexp_replace(description, r"(?i)^cedear\s+", ""))
    return F.trim(F.regexp_replace(bare, r"[.,]+$", ""))


def grouping_key(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def market_of(ticker: Column) -> Column:
    """Symbols ending in a digit (and at most one letter) are Brazilian share classes."""
    return F.when(ticker.rlike(r"\d[A-Za-z]?$"), "brasil").otherwise("usa_otros")


def prefix_groups(keys: DataFrame, column: str = "clave", min_prefix: int = MIN_PREFIX) -> DataFrame:
    """(clave, grupo): keys connected by one being a prefix (of six characters or more) of the other.

    Prefixes of one key are prefixes of each other, so the relation is a forest and a key's group is named by its
    shortest prefix that is itself a key. A directory tells which lengths occur among the keys with the same first six
    characters; a key offers its prefixes of those lengths alone, and an equi-join finds the shortest that is a key.
    No pair of keys is compared and nothing has to be propagated.
    """
    distinct = keys.select(F.col(column).alias("clave")).filter(F.col("clave").isNotNull()).distinct()
    offered = offered_prefixes(distinct, min_prefix)
    heads = distinct.filter(F.length("clave") >= min_prefix).select(F.col("clave").alias("prefijo"))
    found = offered.join(heads, "prefijo", "left_semi").groupBy("clave").agg(F.min(F.length("prefijo")).alias("n"))
    return distinct.join(found, "clave", "left").select(
        "clave", F.coalesce(F.substring("clave", F.lit(1), F.col("n")), "clave").alias("grupo")
    )


def offered_prefixes(distinct: DataFrame, min_prefix: int = MIN_PREFIX) -> DataFrame:
    """(clave, prefijo): of each key the prefixes of the lengths that some key with the same head has, its own included. At most as many as lengths occur."""
    headed = distinct.filter(F.length("clave") >= min_prefix).withColumn("cabeza", F.substring("clave", 1, min_prefix))
    directory = headed.groupBy("cabeza").agg(F.collect_set(F.length("clave")).alias("largos"))
    probed = headed.join(directory, "cabeza").select("clave", F.explode(F.filter("largos", lambda n: n <= F.length("clave"))).alias("n"))
    return probed.select("clave", F.substring("clave", F.lit(1), F.col("n")).alias("prefijo"))


def symbols_with_group(panel: DataFrame) -> DataFrame:
    """``panel`` (simbolo, descripcion) with empresa and grupo."""
    named = panel.withColumn("empresa", company_name(F.col("descripcion"))).withColumn("clave", grouping_key(F.col("empresa")))
    return named.join(prefix_groups(named), "clave")


def dedup_companies(panel: DataFrame) -> DataFrame:
    """One row per company: shortest symbol, longest name, number of symbols; ``grupo`` links to the variants."""
    return (
        symbols_with_group(panel)
        .groupBy("grupo")
        .agg(
            F.min(F.struct(F.length("simbolo").alias("n"), "simbolo")).alias("s"),
            F.min(F.struct((-F.length("empresa")).alias("n"), "empresa")).alias("e"),
            F.count("*").alias("n_variantes"),
        )
        .select("grupo", F.col("s.simbolo").alias("ticker"), F.col("e.empresa").alias("empresa"), "n_variantes")
    )


def variant_texts(symbols: DataFrame, group: str) -> DataFrame:
    """Sorted symbols of each group as one text, the form the dimension stores (a handful per company)."""
    return symbols.groupBy(group).agg(F.array_join(F.array_sort(F.collect_list("simbolo")), ", ").alias("variantes"))


def is_known_duplicate(ticker: Column) -> Column:
    stem = F.substring(ticker, F.lit(1), F.length(ticker) - 1)
    return ticker.isin(DUPLICATE_SYMBOLS) | stem.isin(DUPLICATE_STEMS)


def _stem_cd(symbol: Column) -> Column:
    """The symbol without a final C or D; NULL when it has none."""
    return F.when(F.right(symbol, F.lit(1)).isin("C", "D"), F.substring(symbol, F.lit(1), F.length(symbol) - 1))


def _etf_bases(symbols: DataFrame, known: DataFrame) -> DataFrame:
    """(simbolo, base): the listed base, else the symbol without C/D when that is a known ETF symbol."""
    s = F.col("simbolo")
    k = known.select(F.col("simbolo").alias("_stem")).distinct().withColumn("_hit", F.lit(True))
    return (
        symbols.withColumn("_stem", _stem_cd(s))
        .join(k, "_stem", "left")
        .withColumn("base", F.coalesce(lookup(ETF_BASE, s), F.when(F.col("_hit"), F.col("_stem")), s))
        .drop("_stem", "_hit")
    )


def _symbols(df: DataFrame, values: list[str]) -> DataFrame:
    return df.sparkSession.createDataFrame([(v,) for v in values], "simbolo string")


def split_etfs(panel: DataFrame) -> DataFrame:
    """The panel with ``es_etf``: the description says so, or it is a C/D variant or the base of one that does."""
    described = panel.filter(F.coalesce(F.col("descripcion"), F.lit("")).rlike(ETF_PATTERN)).select("simbolo")
    etf = described.union(_symbols(panel, list(ETF_BASE))).distinct()
    bases = _etf_bases(etf, etf).select(F.col("base").alias("simbolo")).distinct()
    direct = etf.union(bases).distinct().withColumn("_a", F.lit(True))
    variant = bases.select(F.col("simbolo").alias("_stem")).withColumn("_b", F.lit(True))
    return (
        panel.join(direct, "simbolo", "left")
        .withColumn("_stem", _stem_cd(F.col("simbolo")))
        .join(variant, "_stem", "left")
        .withColumn("es_etf", F.col("_a").isNotNull() | F.col("_b").isNotNull())
        .drop("_a", "_b", "_stem")
    )


def etf_rows(etfs: DataFrame) -> DataFrame:
    """One universe row per ETF base."""
    known = etfs.select("simbolo").union(_symbols(etfs, sorted(set(ETF_BASE.values()))))
    based = _etf_bases(etfs.select("simbolo", "descripcion"), known)
    own = F.col("simbolo") == F.col("base")
    rows = based.groupBy("base").agg(
        F.min(F.struct(F.when(own, 0).otherwise(1).alias("o"), "simbolo", "descripcion")).alias("d")
    )
    return rows.join(variant_texts(based, "base"), "base").select(
        F.col("base").alias("ticker_usd"), F.col("base").alias("ticker_cedear"), F.col("base").alias("ticker_yahoo"),
        F.lit(None).cast("string").alias("ticker_adr_usa"), F.lit("etf").alias("mercado"),
        title_case(company_name(F.col("d.descripcion"))).alias("nombre_empresa"), "variantes",
    )


def _deduped(panel: DataFrame, variants: bool) -> DataFrame:
    if not variants:
        return dedup_companies(panel).withColumn("variantes", F.lit(None).cast("string"))
    return dedup_companies(panel).join(variant_texts(symbols_with_group(panel), "grupo"), "grupo")


def company_rows(companies: DataFrame, variants: bool = True) -> DataFrame:
    t = F.col("ticker")
    return _deduped(companies, variants).filter(~is_known_duplicate(t)).select(
        t.alias("ticker_usd"), t.alias("ticker_cedear"), F.coalesce(lookup(PRICE_SYMBOL, t), t).alias("ticker_yahoo"),
        F.lit(None).cast("string").alias("ticker_adr_usa"), market_of(t).alias("mercado"),
        title_case(F.col("empresa")).alias("nombre_empresa"), "variantes",
    )


def local_rows(local_panel: DataFrame, variants: bool = True) -> DataFrame:
    t = F.col("ticker")
    return _deduped(local_panel, variants).select(
        t.alias("ticker_usd"), F.lit(None).cast("string").alias("ticker_cedear"), F.concat(t, F.lit(".BA")).alias("ticker_yahoo"),
        lookup(LOCAL_ADR, t).alias("ticker_adr_usa"), F.lit("argentina_local").alias("mercado"),
        title_case(F.col("empresa")).alias("nombre_empresa"), "variantes",
    )


def universe(panel: DataFrame, local_panel: DataFrame, variants: bool = True) -> DataFrame:
    """Companies, ETFs, local shares and crypto as one frame.

    ``variants=False`` leaves the text of a company's symbols out, for panels where one company may have
    more symbols than fit in a value; ``symbols_with_group`` keeps them as rows.
    """
    split = split_etfs(panel)
    crypto = panel.sparkSession.createDataFrame(
        [(t, None, y, None, "cripto", n, t) for t, y, n in CRYPTO], ", ".join(f"{c} string" for c in UNIVERSE_COLUMNS)
    )
    return (
        company_rows(split.filter(~F.col("es_etf")).drop("es_etf"), variants)
        .unionByName(etf_rows(split.filter("es_etf")))
        .unionByName(local_rows(local_panel, variants))
        .unionByName(crypto)
    )


def has_fundamentals(universe_df: DataFrame) -> DataFrame:
    """Without crypto and ETFs, which file no statements."""
    return universe_df.filter(~F.col("mercado").isin("cripto", "etf"))


def adr_pairs(universe_df: DataFrame) -> DataFrame:
    """(local ticker, ADR ticker) of local shares that also trade as an ADR."""
    return universe_df.filter((F.col("mercado") == "argentina_local") & F.col("ticker_adr_usa").isNotNull()).select(
        "ticker_usd", F.col("ticker_adr_usa").alias("ticker_adr")
    )


def universe_profile(dim: DataFrame) -> DataFrame:
    """Companies by sector and market."""
    return dim.groupBy("sector", "mercado").agg(F.count("*").alias("empresas"))
