"""Portfolio: candidates, quality filter, ranking, diversified choice, saving and evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.functions.expr import AsOf, as_of_date, change_pct, joined, ratio, rounded, texts
from tickerloom.functions.ordering import exact_quantiles, with_rank_pcts
from tickerloom.functions.series import asof_backward, latest_rows

SIZE, MAX_PER_SECTOR, MAX_PER_REGION = 9, 2, 2
COLLAPSED_PROFIT_PCT = -20
MIN_VOLUME, MIN_HISTORY_DAYS, RELIABLE_HISTORY_DAYS = 50_000, 252, 1000
LOCAL_PANELS = ("argentina_local", "brasil")
# Companies whose legal domicile is not where the business is (fixed values).
REAL_REGION = {"PDD": "China", "TCOM": "China"}
MATURE_DAYS = 63


def quality_summary(quality: DataFrame) -> DataFrame:
    """Errors and warnings per ticker as sorted texts, and whether the profit looks non-recurring."""
    severity = F.col("severidad")
    return quality.groupBy("ticker_usd").agg(
        joined(F.when(severity == "error", F.col("regla"))).alias("errores_datos"),
        joined(
            F.when(severity == "advertencia", F.concat("regla", F.lit(" ("), "detalle", F.lit(")"))), "; "
        ).alias("advertencias_datos"),
        F.bool_or(F.col("regla") == "margen_incoherente").alias("ganancia_no_recurrente"),
    )


def price_depth(prices: DataFrame, as_of: AsOf = None) -> DataFrame:
    """Days of price history and mean volume of the last 30 calendar days."""
    today = as_of_date(as_of, prices, "fecha")
    return (
        prices.filter(F.col("adj_close").isNotNull())
        .groupBy("ticker_usd")
        .agg(
            F.count("*").alias("dias_precio"),
            F.avg(F.when(F.col("fecha") >= F.date_sub(today, 30), F.col("volume"))).alias("vol_prom_30d"),
        )
    )


def candidates(
    styles: DataFrame, comps: DataFrame, health: DataFrame, tech: DataFrame, consensus: DataFrame, sentiment: DataFrame,
    prices: DataFrame, quality: DataFrame, as_of: AsOf = None,
) -> DataFrame:
    """One row per company with everything the selection reads. Every input is one row per ticker before it joins."""
    recs = ["precio_objetivo_mediana", "rec_strong_buy", "rec_buy", "rec_hold", "rec_sell", "rec_strong_sell"]
    return (
        styles.filter(F.col("mercado") != "cripto")
        .select(
            "ticker_usd", "nombre_empresa", "sector", "mercado", "pais_origen", "lynch_categoria_auto",
            "lynch_checklist_score", "crecimiento_ingresos_anual_pct", "crecimiento_ganancia_anual_pct",
        )
        .join(comps.select("ticker_usd", "comp_pe_vs_sector_pct", "comp_percentil_crecimiento_en_sector"), "ticker_usd")
        .join(health.select("ticker_usd", "salud_score", "salud_evaluables", "salud_clasificacion", "margen_neto_pct"), "ticker_usd")
        .join(tech.select("ticker_usd", "tech_rsi14", "tech_rsi_senal", "tech_tendencia"), "ticker_usd", "left")
        .join(latest_rows(consensus).select("ticker_usd", *recs), "ticker_usd", "left")
        .join(sentiment.select("ticker_usd", "sent_score_promedio", "sent_clasificacion"), "ticker_usd", "left")
        .join(price_depth(prices, as_of), "ticker_usd", "left")
        .join(quality_summary(quality), "ticker_usd", "left")
        .withColumn("ganancia_no_recurrente", F.coalesce("ganancia_no_recurrente", F.lit(False)))
    )


def quality_filter(
    df: DataFrame, min_volume: float = MIN_VOLUME, min_history: int = MIN_HISTORY_DAYS
) -> DataFrame:
    """Companies fit for selection. Unknown numbers fail; an unknown health class does not."""
    return df.filter(
        (F.col("salud_clasificacion").isNull() | (F.col("salud_clasificacion") != "Riesgo"))
        & (F.col("crecimiento_ganancia_anual_pct") > COLLAPSED_PROFIT_PCT)
        & (F.col("margen_neto_pct") > 0)
        & (F.col("vol_prom_30d") >= min_volume)
        & (F.col("dias_precio") >= min_history)
        & F.col("errores_datos").isNull()
    )


def rank_candidates(df: DataFrame) -> DataFrame:
    """Percentile scores and their mean over the available ones.

    The P/E rank counts every company, and only then turns neutral where the P/E says little. Ranks are over the
    whole set, computed by value counts rather than in one sorted task. The frame is read several times: a stored one is
    cheaper than the whole chain of joins behind it.
    """
    scored = df.withColumn("_barata", -F.col("comp_pe_vs_sector_pct")).withColumn(
        "salud_ratio", ratio("salud_score", "salud_evaluables")
    )
    scored = with_rank_pcts(
        scored, {"lynch_checklist_score": "pct_checklist", "_barata": "pct_barata", "salud_ratio": "pct_salud"}, "ticker_usd"
    )
    neutral = (F.col("lynch_categoria_auto") == "Ciclica") | F.col("ganancia_no_recurrente")
    scored = scored.withColumn("pe_no_confiable", neutral).withColumn(
        "pct_barata", F.when(neutral, F.lit(0.5)).otherwise(F.col("pct_barata"))
    )
    parts = ["pct_checklist", "pct_barata", "pct_salud"]
    present = sum((F.col(p).isNotNull().cast("int") for p in parts), F.lit(0))
    score = sum((F.coalesce(F.col(p), F.lit(0.0)) for p in parts), F.lit(0.0))
    return scored.withColumn("score_compuesto", ratio(score, present)).drop("_barata")


def external_alerts(df: DataFrame) -> DataFrame:
    """Flags from outside the ranking, and their reasons as one text."""
    zero = F.lit(0)
    sells = F.coalesce("rec_sell", zero) + F.coalesce("rec_strong_sell", zero)
    buys = F.coalesce("rec_buy", zero) + F.coalesce("rec_strong_buy", zero)
    flagged = (
        df.withColumn("alerta_analistas", sells > buys)
        .withColumn("alerta_sentimiento", F.coalesce(F.col("sent_clasificacion") == "Negativo", F.lit(False)))
        .withColumn("alerta_historia_corta", F.coalesce(F.col("dias_precio") < RELIABLE_HISTORY_DAYS, F.lit(False)))
        .withColumn("alerta_datos", F.col("advertencias_datos").isNotNull())
    )
    return flagged.withColumn(
        "alertas",
        texts(
            F.when(F.col("alerta_analistas"), "mayoría de analistas en sell/strong sell"),
            F.when(F.col("alerta_sentimiento"), F.format_string("sentimiento negativo (score %.2f)", "sent_score_promedio")),
            F.when(
                F.col("alerta_historia_corta"),
                F.format_string(f"solo %d días de historial de precio (< {RELIABLE_HISTORY_DAYS})", "dias_precio"),
            ),
            F.when(F.col("alerta_datos"), F.concat(F.lit("datos: "), "advertencias_datos")),
        ),
    )


def region(real_region: dict[str, str] = REAL_REGION) -> Column:
    """Local panels are one region each; elsewhere the (corrected) country."""
    out = F.when(F.col("mercado").isin(*LOCAL_PANELS), F.col("mercado"))
    for ticker, place in real_region.items():
        out = out.when(F.col("ticker_usd") == ticker, place)
    return out.otherwise(F.col("pais_origen"))


def reachable_rows(size: int, max_sector: int, max_region: int) -> tuple[int, int, int, int]:
    """How deep a capped walk of ``size`` picks can look: per (sector, region), per sector, per region, overall.

    Before the last pick at most (size - 1) // cap sectors and as many regions can be full. A row is passed over
    only because its sector or its region is full, and of one (sector, region) pair only the first min(cap)
    rows can matter. So in one sector at most cap rows plus those lost to full regions are
    looked at before the sector itself fills up, and likewise for a region; overall, the picks plus what full
    sectors and full regions held.
    """
    pair = min(max_sector, max_region)
    full_sectors, full_regions = (size - 1) // max_sector, (size - 1) // max_region
    per_sector = max_sector + pair * full_regions
    per_region = max_region + pair * full_sectors
    return pair, per_sector, per_region, size + full_sectors * per_sector + full_regions * per_region


def select_diversified(
    ranked: DataFrame, size: int = SIZE, max_sector: int = MAX_PER_SECTOR, max_region: int = MAX_PER_REGION,
    score: str = "score_compuesto",
) -> DataFrame:
    """Walk the ranking taking the best company whose sector and region still have room, up to ``size``.

    The walk is sequential, but it can only ever reach the rows counted by ``reachable_rows``, a number that
    depends on the caps alone. Those are cut out with top-k windows (limited before the shuffle too) and a top-n,
    and the walk folds over that one short array. NULL sectors or regions form one group each.
    """
    pair, per_sector, per_region, overall = reachable_rows(size, max_sector, max_region)
    best = [F.col(score).desc_nulls_last(), F.col("ticker_usd").asc()]
    df = ranked.withColumn("region", region())

    def top(frame: DataFrame, keys: list[str], k: int) -> DataFrame:
        return (
            frame.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*best)))
            .filter(F.col("_k") <= k)
            .drop("_k")
        )

    short = top(top(top(df, ["sector", "region"], pair), ["sector"], per_sector), ["region"], per_region)
    short = short.orderBy(*best).limit(overall)
    none = F.lit("\x00")
    row = F.struct(
        F.struct((-F.col(score)).alias("s"), F.col("ticker_usd").alias("t")).alias("o"),
        F.coalesce("sector", none).alias("sector"), F.coalesce("region", none).alias("region"),
    )
    # sort_array puts NULL scores first; give them the last place instead
    row = row.withField("o.s", F.coalesce(-F.col(score), F.lit(float("inf"))))
    start = F.expr("cast(array() as array<struct<o:struct<s:double,t:string>,sector:string,region:string>>)")

    def step(taken: Column, x: Column) -> Column:
        used = lambda name: F.size(F.filter(taken, lambda y: y[name] == x[name]))
        room = (F.size(taken) < size) & (used("sector") < max_sector) & (used("region") < max_region)
        return F.when(room, F.concat(taken, F.array(x))).otherwise(taken)

    chosen = (
        short.agg(F.array_sort(F.collect_list(row)).alias("filas"))
        .select(F.posexplode(F.aggregate("filas", start, step)).alias("i", "f"))
        .select(F.col("f.o.t").alias("ticker_usd"), (F.col("i") + 1).alias("puesto"))
    )
    return short.join(F.broadcast(chosen), "ticker_usd")


def portfolio_rows(chosen: DataFrame, prices: DataFrame, origin: str) -> DataFrame:
    """Rows to save: dated at, and priced with, the latest close used."""
    last = (
        prices.filter(F.col("adj_close").isNotNull())
        .join(F.broadcast(chosen.select("ticker_usd")), "ticker_usd", "left_semi")
        .groupBy("ticker_usd")
        .agg(F.max("fecha").alias("f"), F.max_by("adj_close", "fecha").alias("precio_seleccion"))
    )
    whole = Window.partitionBy(F.lit(0))
    return (
        chosen.join(last, "ticker_usd")
        .withColumn("fecha_seleccion", F.max("f").over(whole))
        .select(
            "fecha_seleccion", F.lit(origin).alias("origen"), "ticker_usd", "puesto", "score_compuesto", "precio_seleccion",
            "sector", "region", "alertas",
        )
    )


def evaluate_portfolios(
    saved: DataFrame, prices: DataFrame, macro: DataFrame, dim: DataFrame, calendar_ticker: str = "AAPL",
    index_code: str = "SP500", rounded_output: bool = True,
) -> DataFrame:
    """Equal-weight result of each saved portfolio against the universe's median and the index, since its date."""
    r = rounded_output
    known = prices.filter(F.col("adj_close").isNotNull())
    last = known.groupBy("ticker_usd").agg(F.max("fecha").alias("fecha_hoy"), F.max_by("adj_close", "fecha").alias("precio_hoy"))
    own = (
        saved.join(last, "ticker_usd")
        .groupBy("fecha_seleccion", "origen")
        .agg(
            (F.avg(ratio("precio_hoy", "precio_seleccion") - 1) * 100).alias("cartera"),
            F.count("*").alias("empresas"),
            F.max("fecha_hoy").alias("hasta"),
        )
    )
    dates = saved.select("fecha_seleccion").distinct().withColumn("k", F.lit(0))
    trading = prices.filter(F.col("ticker_usd") == calendar_ticker).select("fecha", F.col("fecha").alias("fecha_base"), F.lit(0).alias("k"))
    based = asof_backward(dates, trading, ["k"], "fecha_seleccion", "fecha", {"fecha_base": "fecha_base"}).drop("k")
    listed = dim.filter(~F.col("mercado").isin("cripto", "etf")).select("ticker_usd")
    since = (
        prices.filter(F.col("adj_close") > 0)
        .select("ticker_usd", "fecha", "adj_close")
        .join(F.broadcast(based.filter(F.col("fecha_base").isNotNull()).withColumnRenamed("fecha_base", "fecha")), "fecha")
        .join(listed, "ticker_usd", "left_semi")
        .join(last, "ticker_usd")
        .select("fecha_seleccion", ratio("precio_hoy", "adj_close").alias("g"))
    )
    universe = exact_quantiles(since, ["fecha_seleccion"], "g", {"m": 0.5}).select(
        "fecha_seleccion", ((F.col("m") - 1) * 100).alias("universo")
    )
    level = macro.filter(F.col("serie") == index_code).select("fecha", "valor", F.lit(0).alias("k"))
    now = level.agg(F.max_by("valor", "fecha")).scalar()
    index = asof_backward(dates, level, ["k"], "fecha_seleccion", "fecha", {"valor": "v0"}).select(
        "fecha_seleccion", ((ratio(now, F.col("v0")) - 1) * 100).alias("indice")
    )
    return (
        own.join(universe, "fecha_seleccion")
        .join(index, "fecha_seleccion")
        .select(
            "fecha_seleccion", "origen", "empresas", "hasta",
            F.datediff("hasta", "fecha_seleccion").alias("dias"),
            rounded(F.col("cartera"), 1, r).alias("cartera_pct"),
            rounded(F.col("universo"), 1, r).alias("universo_mediana_pct"),
            rounded(F.col("indice"), 1, r).alias("sp500_pct"),
            rounded(F.col("cartera") - F.col("universo"), 1, r).alias("vs_universo_pp"),
        )
    )


def verdict(evaluated: DataFrame, mature_days: int = MATURE_DAYS) -> DataFrame:
    """Over the portfolios old enough to judge: how many, share that beat the universe, median difference."""
    mature = evaluated.filter(F.col("dias") >= mature_days)
    return mature.agg(
        F.count("*").alias("carteras"),
        (F.avg(F.when(F.col("vs_universo_pp") > 0, 1.0).otherwise(0.0)) * 100).alias("gana_pct"),
        F.median("vs_universo_pp").alias("diferencia_mediana_pp"),
    )


def stretch_groups(
    styles: DataFrame, health: DataFrame, tech: DataFrame, consensus_up: DataFrame, waves: DataFrame, comps: DataFrame, sentiment: DataFrame
) -> DataFrame:
    """Companies with a sector to compare with, split by quality and by how stretched their price is, with the state of the current leg."""
    passes = F.coalesce(
        (F.col("salud_clasificacion").isNull() | (F.col("salud_clasificacion") != "Riesgo"))
        & (F.col("crecimiento_ganancia_anual_pct") > COLLAPSED_PROFIT_PCT)
        & (F.col("margen_neto_pct") > 0),
        F.lit(False),
    )
    stretched = F.coalesce(F.col("tech_rsi14") >= 70, F.lit(False)) | F.coalesce(F.col("upside_pct") < 0, F.lit(False))
    return (
        styles.select("ticker_usd", "nombre_empresa", "sector", "lynch_checklist_score", "crecimiento_ganancia_anual_pct")
        .join(health.select("ticker_usd", "salud_clasificacion", "margen_neto_pct"), "ticker_usd")
        .join(comps.select("ticker_usd", "pe_trailing", "comp_pe_vs_sector_pct", "roe_pct"), "ticker_usd")
        .join(sentiment.select("ticker_usd", "sent_clasificacion"), "ticker_usd", "left")
        .join(tech.select("ticker_usd", "tech_rsi14", "tech_dist_max_52s_pct", "tech_volumen_prom_30d"), "ticker_usd", "left")
        .join(consensus_up.select("ticker_usd", "upside_pct"), "ticker_usd", "left")
        .join(waves.select("ticker_usd", "onda_pierna_actual", "onda_pierna_actual_pct"), "ticker_usd", "left")
        .withColumn("pasa_calidad", passes)
        .withColumn("pasa_liquidez", F.coalesce(F.col("tech_volumen_prom_30d") >= MIN_VOLUME, F.lit(False)))
        .withColumn(
            "grupo",
            F.when(~F.col("pasa_calidad"), "No pasa calidad").when(stretched, "Calidad, estirada").otherwise("Calidad, no estirada"),
        )
        .withColumn(
            "estado",
            F.when(F.col("tech_rsi14") <= 30, "Cayendo, sobrevendida")
            .when(F.col("onda_pierna_actual") == "Baja", "Cayendo")
            .otherwise("Rebotando"),
        )
    )
