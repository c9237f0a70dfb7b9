"""Company fundamentals: style categories, sector comparables, solvency, momentum and statement series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.functions.expr import as_int, change_pct, ladder, ratio, rounded, total
from tickerloom.functions.ordering import exact_quantiles, with_percent_rank, with_position
from tickerloom.functions.series import by_date, first_rows, known_at_latest, latest_rows
from tickerloom.schemas import METRIC_COLUMNS

CYCLICAL_SECTORS = ["Energy", "Basic Materials", "Industrials"]
COLLAPSED_PROFIT_PCT = -20
CYCLICAL_BETA = 1.4
HIGH_GROWTH_PCT, STEADY_GROWTH_PCT = 18, 5
LOW_INSTITUTIONAL_PCT = 30
LOW_DEBT_TO_EQUITY = 50
SMALL_CAP = 10_000_000_000
BUYBACK_MIN_DAYS = 30
UNRELIABLE_HOLDING_RULE = "tenencia_institucional_no_confiable"
MARKET_CURRENCY = {"argentina_local": "ARS", "brasil": "BRL"}
MAX_USABLE_PE = 200
PUBLISHED_STATEMENTS = ["ingresos", "costo_ingresos", "beneficio_bruto", "gastos_operativos", "ganancia_neta"]


def corrected_sector() -> Column:
    return F.coalesce(F.col("sector_corregido"), F.col("sector"))


def style_categories(
    metrics: DataFrame, dim: DataFrame, quality: DataFrame, cyclical_sectors: list[str] = CYCLICAL_SECTORS
) -> DataFrame:
    """Growth-style category, PEG reading and the six-point checklist of each company."""
    latest = known_at_latest(metrics, METRIC_COLUMNS)
    first = first_rows(metrics.select("ticker_usd", "fecha", "shares_outstanding")).select(
        "ticker_usd", F.col("fecha").alias("fecha_primera"), F.col("shares_outstanding").alias("acciones_primera")
    )
    unreliable = (
        quality.filter(F.col("regla") == UNRELIABLE_HOLDING_RULE)
        .select("ticker_usd")
        .distinct()
        .withColumn("tenencia_dudosa", F.lit(True))
    )
    identity = dim.select(
        "ticker_usd", "nombre_empresa", corrected_sector().alias("sector"), "industria", "pais_origen", "mercado",
        F.col("lynch_category").alias("lynch_categoria_manual"), "modelo_negocio",
    )
    base = (
        latest.join(first, "ticker_usd", "left")
        .join(identity, "ticker_usd")
        .join(unreliable, "ticker_usd", "left")
        .withColumn(
            "institutional_holding_pct", F.when(F.col("tenencia_dudosa").isNull(), F.col("institutional_holding_pct"))
        )
    )
    revenue, profit = F.col("crecimiento_ingresos_anual_pct"), F.col("crecimiento_ganancia_anual_pct")
    peg, pb = F.col("peg_ratio"), F.col("price_to_book")

    def sure(cond: Column) -> Column:
        return F.coalesce(cond, F.lit(False))

    hidden_asset = sure((pb > 0) & (pb < 1))
    checks = {
        "lynch_chk_baja_cobertura_institucional": sure(F.col("institutional_holding_pct") < LOW_INSTITUTIONAL_PCT),
        "lynch_chk_deuda_baja": sure(F.col("deuda_patrimonio") < LOW_DEBT_TO_EQUITY),
        "lynch_chk_activo_oculto": hidden_asset,
        "lynch_chk_empresa_pequena": sure(F.col("market_cap") < SMALL_CAP),
        "lynch_chk_peg_atractivo": sure(peg < 1),
        "lynch_chk_recompra_acciones": F.when(
            F.datediff("fecha", "fecha_primera") >= BUYBACK_MIN_DAYS,
            F.col("shares_outstanding") < F.col("acciones_primera"),
        ),
    }
    return base.select(
        "ticker_usd", "nombre_empresa", "sector", "industria", "pais_origen", "mercado", "fecha",
        ladder(
            [
                ((profit < COLLAPSED_PROFIT_PCT) | (F.col("margen_neto_pct") < 0), "Recuperable"),
                ((F.col("beta") >= CYCLICAL_BETA) | F.col("sector").isin(cyclical_sectors), "Ciclica"),
                (revenue >= HIGH_GROWTH_PCT, "Alto Crecimiento"),
                (revenue >= STEADY_GROWTH_PCT, "Estable"),
                (revenue.isNotNull(), "Bajo Crecimiento"),
            ],
            "Sin clasificar (falta crecimiento de ingresos)",
        ).alias("lynch_categoria_auto"),
        hidden_asset.alias("lynch_activo_oculto_potencial"),
        ladder(
            [(peg.isNull(), "Sin dato"), (peg < 0.5, "Muy barata"), (peg < 1, "Barata"), (peg < 1.5, "Razonable"), (peg < 2, "Cara")],
            "Muy cara",
        ).alias("lynch_valuacion_peg"),
        *[c.alias(name) for name, c in checks.items()],
        total([as_int(c) for c in checks.values()]).alias("lynch_checklist_score"),
        "crecimiento_ingresos_anual_pct", "crecimiento_ganancia_anual_pct", "aceleracion_ingresos_pct", "peg_ratio",
        "pe_trailing", "price_to_book", "deuda_patrimonio", "dividend_yield_pct", "institutional_holding_pct",
        "insider_holding_pct", "market_cap", "beta", "lynch_categoria_manual", "modelo_negocio",
    )


def comparables(metrics: DataFrame, dim: DataFrame, rounded_output: bool = True) -> DataFrame:
    """Each company against its sector: medians, differences, count and growth percentile.

    Sectors are few and can each hold a large share of all companies, so medians and ranks come
    from value counts spread over many tasks rather than from one window per sector.
    """
    r = rounded_output
    wanted = ["market_cap", "pe_trailing", "peg_ratio", "margen_neto_pct", "crecimiento_ingresos_anual_pct", "roe_pct"]
    identity = dim.select(
        "ticker_usd", "nombre_empresa", corrected_sector().alias("sector"), "industria", "mercado",
        ladder([(F.col("mercado") == m, c) for m, c in MARKET_CURRENCY.items()], "USD").alias("comp_moneda"),
    ).filter(F.col("sector").isNotNull())
    base = known_at_latest(metrics, wanted).join(identity, "ticker_usd")

    pe, peg = F.col("pe_trailing"), F.col("peg_ratio")
    measured = base.select(
        "sector",
        F.when((pe > 0) & (pe < MAX_USABLE_PE), pe).alias("pe"),
        F.when(peg > 0, peg).alias("peg"),
        F.col("margen_neto_pct").alias("margen_neto"),
        F.col("crecimiento_ingresos_anual_pct").alias("crecimiento"),
        F.col("roe_pct").alias("roe"),
    )
    names = ["pe", "peg", "margen_neto", "crecimiento", "roe"]
    long = measured.unpivot("sector", names, "medida", "valor")
    medians = exact_quantiles(long, ["sector", "medida"], "valor", {"mediana": 0.5})
    sector_stats = (
        base.groupBy("sector").agg(F.count("*").alias("comp_pares_en_sector"))
        .join(
            medians.groupBy("sector").agg(
                *[F.max(F.when(F.col("medida") == n, F.col("mediana"))).alias(f"comp_{n}_mediana_sector") for n in names]
            ),
            "sector",
            "left",
        )
    )
    ranked = with_percent_rank(base, "crecimiento_ingresos_anual_pct", "pr", ["sector"]).join(sector_stats, "sector")
    return ranked.select(
        "ticker_usd", "nombre_empresa", "sector", "industria", "mercado", "comp_moneda", "fecha", "market_cap",
        "pe_trailing", "comp_pe_mediana_sector",
        rounded(change_pct("pe_trailing", "comp_pe_mediana_sector"), 1, r).alias("comp_pe_vs_sector_pct"),
        "peg_ratio", "comp_peg_mediana_sector",
        "margen_neto_pct", "comp_margen_neto_mediana_sector",
        rounded(F.col("margen_neto_pct") - F.col("comp_margen_neto_mediana_sector"), 1, r).alias("comp_margen_vs_sector_pp"),
        "crecimiento_ingresos_anual_pct", "comp_crecimiento_mediana_sector",
        rounded(F.col("crecimiento_ingresos_anual_pct") - F.col("comp_crecimiento_mediana_sector"), 1, r).alias("comp_crecimiento_vs_sector_pp"),
        "roe_pct", "comp_roe_mediana_sector",
        "comp_pares_en_sector",
        rounded(F.col("pr") * 100, 0, r).alias("comp_percentil_crecimiento_en_sector"),
    )


def similar_peers(comps: DataFrame, n: int = 5, tickers: list[str] | None = None) -> DataFrame:
    """The ``n`` companies nearest in market cap, same sector and currency, for every company (or for ``tickers``).

    On each side of a company the distance only grows with the position in market-cap order, so its nearest ``n``
    lie among the ``n`` before and the ``n`` after it: companies meet by position, never all against all. Ties go
    to the nearer position, then to the lower one.
    """
    keys = ["sector", "comp_moneda"]
    placed = with_position(comps, keys, "market_cap", "ticker_usd", "pos")
    steps = [s for k in range(1, n + 1) for s in (-k, k)]
    targets = placed.select(
        *keys, "ticker_usd", F.col("market_cap").alias("cap"), "pos", F.explode(F.array(*[F.lit(s) for s in steps])).alias("paso")
    )
    if tickers is not None:
        targets = targets.filter(F.col("ticker_usd").isin(tickers))
    targets = targets.withColumn("pos", F.col("pos") + F.col("paso"))
    others = placed.select(
        *keys, "pos", F.col("ticker_usd").alias("par_ticker"), F.col("nombre_empresa").alias("par_nombre"),
        F.col("market_cap").alias("par_market_cap"), F.col("pe_trailing").alias("par_pe_trailing"),
        F.col("crecimiento_ingresos_anual_pct").alias("par_crecimiento_pct"),
        F.col("margen_neto_pct").alias("par_margen_neto_pct"), F.col("roe_pct").alias("par_roe_pct"),
    )
    near = targets.join(others, [*keys, "pos"]).withColumn("distancia", F.abs(F.col("par_market_cap") - F.col("cap")))
    best = Window.partitionBy("ticker_usd").orderBy(F.col("distancia").asc_nulls_last(), F.abs("paso"), "paso")
    return (
        near.withColumn("orden", F.row_number().over(best))
        .filter(F.col("orden") <= n)
        .select(
            "ticker_usd", "orden", "par_ticker", "par_nombre", "par_market_cap", "par_pe_trailing",
            "par_crecimiento_pct", "par_margen_neto_pct", "par_roe_pct", "distancia",
        )
    )


def financial_health(metrics: DataFrame, balances: DataFrame, dim: DataFrame, rounded_output: bool = True) -> DataFrame:
    """Five solvency checks, how many could be evaluated, and the resulting class."""
    m = known_at_latest(metrics, ["razon_corriente", "deuda_patrimonio", "roe_pct", "margen_neto_pct"])
    b = latest_rows(balances.select("ticker_usd", "fecha_balance", "deuda_total", "flujo_caja_libre"), date="fecha_balance")
    debt, fcf = F.col("deuda_total"), F.col("flujo_caja_libre")
    checks = {
        "salud_chk_liquidez": F.col("razon_corriente") >= 1.2,
        "salud_chk_apalancamiento": F.col("deuda_patrimonio") <= 100,
        "salud_chk_rentabilidad": F.col("roe_pct") >= 10,
        "salud_chk_margen_positivo": F.col("margen_neto_pct") > 0,
        "salud_chk_cobertura_deuda": F.when(
            debt.isNotNull() & fcf.isNotNull(), (debt <= 0) | (ratio(debt, fcf) <= 5)
        ),
    }
    score = F.col("salud_score")
    known = F.col("salud_evaluables")
    return (
        m.join(b.drop("fecha_balance"), "ticker_usd", "left")
        .join(dim.select("ticker_usd", "nombre_empresa", "sector"), "ticker_usd")
        .select(
            "ticker_usd", "nombre_empresa", "sector", "fecha", "razon_corriente", "deuda_patrimonio", "roe_pct",
            "margen_neto_pct", "deuda_total", "flujo_caja_libre",
            F.when(fcf > 0, rounded(ratio(debt, fcf), 1, rounded_output)).alias("anios_pagar_deuda"),
            *[c.alias(name) for name, c in checks.items()],
        )
        .withColumn("salud_score", total([as_int(F.col(c)) for c in checks]))
        .withColumn("salud_evaluables", total([F.col(c).isNotNull().cast("int") for c in checks]))
        .withColumn(
            "salud_clasificacion",
            ladder(
                [(known == 0, "Sin datos suficientes"), (score >= 0.8 * known, "Sólida"), (score >= 0.5 * known, "Aceptable")],
                "Riesgo",
            ),
        )
    )


def statement_momentum(
    income: DataFrame, eps_annual: DataFrame, eps_reports: DataFrame, rounded_output: bool = True, last_reported: int = 4
) -> DataFrame:
    """Growth, acceleration, EPS growth rates and earnings surprises per company.

    ``income``: ticker_usd, fecha_balance, ingresos, ganancia_neta. ``eps_annual``: ticker_usd, fecha_balance, eps.
    ``eps_reports``: ticker_usd, fecha_reporte, eps_reportado, sorpresa_pct; the surprise figures are over
    the ``last_reported`` newest of those with a result.
    """
    r = rounded_output
    w = by_date(date="fecha_balance")
    newest = Window.partitionBy("ticker_usd").orderBy(F.col("fecha_balance").desc())

    def growth(column: str) -> DataFrame:
        # a zero base gives no growth figure and leaves the sequence
        prev = F.lag(column).over(w)
        seq = (
            income.filter(F.col(column).isNotNull())
            .withColumn("g", ratio(F.col(column) - prev, F.abs(prev)) * 100)
            .filter(F.col("g").isNotNull())
            .withColumn("n", F.row_number().over(newest))
        )
        return seq.groupBy("ticker_usd").agg(
            F.max(F.when(F.col("n") == 1, F.col("g"))).alias("g1"), F.max(F.when(F.col("n") == 2, F.col("g"))).alias("g2")
        )

    revenue = growth("ingresos").select(
        "ticker_usd",
        rounded(F.col("g1"), 1, r).alias("crecimiento_ingresos_anual_pct"),
        rounded(F.col("g1") - F.col("g2"), 1, r).alias("aceleracion_ingresos_pct"),
    )
    profit = growth("ganancia_neta").select("ticker_usd", rounded(F.col("g1"), 1, r).alias("crecimiento_ganancia_anual_pct"))

    def cagr(years: int) -> Column:
        last, base = F.col("e1"), F.col(f"e{years + 1}")
        return F.when((last > 0) & (base > 0), (F.pow(last / base, F.lit(1 / years)) - 1) * 100)

    eps = (
        eps_annual.filter(F.col("eps").isNotNull())
        .withColumn("n", F.row_number().over(newest))
        .groupBy("ticker_usd")
        .agg(*[F.max(F.when(F.col("n") == k, F.col("eps"))).alias(f"e{k}") for k in (1, 4, 6)])
        .select("ticker_usd", *[rounded(cagr(y), 1, r).alias(f"eps_growth_{y}y_pct") for y in (3, 5)])
    )
    reported = (
        eps_reports.filter(F.col("eps_reportado").isNotNull())
        .withColumn("n", F.row_number().over(Window.partitionBy("ticker_usd").orderBy(F.col("fecha_reporte").desc())))
        .filter((F.col("n") <= last_reported) & F.col("sorpresa_pct").isNotNull())
        .groupBy("ticker_usd")
        .agg(
            rounded(F.avg("sorpresa_pct"), 1, r).alias("sorpresa_eps_prom_4q_pct"),
            F.count_if(F.col("sorpresa_pct") > 0).cast("int").alias("trimestres_superando_estimado"),
        )
    )
    tickers = income.select("ticker_usd").union(eps_annual.select("ticker_usd")).union(eps_reports.select("ticker_usd")).distinct()
    out = tickers
    for part in (revenue, profit, eps, reported):
        out = out.join(part, "ticker_usd", "left")
    return out


def annual_performance(income: DataFrame) -> DataFrame:
    """Revenue, net income (thousand millions) and margin by fiscal year."""
    return income.select(
        "ticker_usd", F.year("fecha_balance").alias("anio"), (F.col("ingresos") / 1e9).alias("ingresos_mm"),
        (F.col("ganancia_neta") / 1e9).alias("ganancia_neta_mm"), "margen_neto_pct",
    )


def income_waterfall(income: DataFrame) -> DataFrame:
    """Revenue to net income in five steps from the last balance; companies missing a step give no rows."""
    last = latest_rows(income.select("ticker_usd", "fecha_balance", *PUBLISHED_STATEMENTS), date="fecha_balance").dropna(
        subset=PUBLISHED_STATEMENTS
    )
    steps = [
        ("1", "Ingresos", F.col("ingresos"), F.col("ingresos")),
        ("2", "COGS", -F.col("costo_ingresos"), F.col("ingresos") - F.col("costo_ingresos")),
        ("3", "Bruto", F.lit(0.0), F.col("beneficio_bruto")),
        ("4", "Gastos op.", -F.col("gastos_operativos"), F.col("beneficio_bruto") - F.col("gastos_operativos")),
        ("5", "Neto", F.lit(0.0), F.col("ganancia_neta")),
    ]
    rows = F.array(
        *[
            F.struct(F.lit(int(i)).alias("paso"), F.lit(name).alias("concepto"), delta.alias("delta"), level.alias("acumulado"))
            for i, name, delta, level in steps
        ]
    )
    return last.select("ticker_usd", "fecha_balance", F.explode(rows).alias("s")).select("ticker_usd", "fecha_balance", "s.*")


def debt_and_cash(balances: DataFrame) -> DataFrame:
    return balances.select("ticker_usd", F.year("fecha_balance").alias("anio"), "deuda_total", "efectivo", "flujo_caja_libre")


def eps_history(eps: DataFrame) -> DataFrame:
    """Estimated against reported EPS, with the next report marked."""
    pending = F.col("eps_reportado").isNull()
    upcoming = F.min(F.when(pending, F.col("fecha_reporte"))).over(Window.partitionBy("ticker_usd"))
    return eps.select(
        "ticker_usd", "fecha_reporte", "eps_estimado", "eps_reportado", "sorpresa_pct",
        F.coalesce(pending & (F.col("fecha_reporte") == upcoming), F.lit(False)).alias("es_proximo"),
    )


def consensus_upside(consensus: DataFrame, prices: DataFrame, dim: DataFrame, rounded_output: bool = True) -> DataFrame:
    """Distance from the last price to the median analyst target."""
    target = latest_rows(consensus)
    last = prices.filter(F.col("adj_close").isNotNull()).groupBy("ticker_usd").agg(F.max_by("adj_close", "fecha").alias("precio_actual"))
    return (
        target.join(dim.select("ticker_usd", "nombre_empresa", "sector"), "ticker_usd")
        .join(last, "ticker_usd", "left")
        .withColumn("upside_pct", rounded(change_pct("precio_objetivo_mediana", "precio_actual"), 1, rounded_output))
    )
