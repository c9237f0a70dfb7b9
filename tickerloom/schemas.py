"""Table schemas of the warehouse, one DDL string per table, and their keys. Table and column names are fixed values."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Table:
    """Columns, key and the date column used to lay the table out on disk."""

    name: str
    ddl: str
    key: tuple[str, ...]
    date_column: str | None = None

    @property
    def schema(self) -> T.StructType:
        return T.StructType.fromDDL(self.ddl)

    @property
    def value_columns(self) -> list[str]:
        return [c for c in self.schema.names if c not in self.key]


METRIC_COLUMNS = [
    "crecimiento_ingresos_anual_pct", "crecimiento_ganancia_anual_pct", "aceleracion_ingresos_pct",
    "eps_growth_3y_pct", "eps_growth_5y_pct", "sorpresa_eps_prom_4q_pct", "trimestres_superando_estimado",
    "market_cap", "enterprise_value", "pe_trailing", "pe_forward", "peg_ratio", "price_to_book", "ev_ebitda",
    "margen_bruto_pct", "margen_operativo_pct", "margen_neto_pct", "roe_pct", "roa_pct", "deuda_patrimonio",
    "razon_corriente", "dividend_yield_pct", "payout_ratio_pct", "beta", "insider_holding_pct",
    "institutional_holding_pct", "shares_outstanding",
]


def _doubles(*names: str) -> str:
    return ", ".join(f"{n} double" for n in names)


TABLES: dict[str, Table] = {
    t.name: t
    for t in [
        Table(
            "dim_empresa",
            "ticker_usd string, ticker_cedear string, ticker_yahoo string, ticker_adr_usa string, mercado string, "
            "nombre_empresa string, sector string, sector_corregido string, industria string, pais_origen string, "
            "modelo_negocio string, lynch_category string, variantes string, actualizado_en timestamp, "
            "moneda_cotizacion string, moneda_balance string",
            ("ticker_usd",),
        ),
        Table(
            "fact_metrics_daily",
            "ticker_usd string, fecha date, "
            + ", ".join(
                f"{c} {'int' if c == 'trimestres_superando_estimado' else 'double'}" for c in METRIC_COLUMNS
            ),
            ("ticker_usd", "fecha"),
            "fecha",
        ),
        Table(
            "fact_precios_daily",
            "ticker_usd string, fecha date, " + _doubles("open", "high", "low", "close", "adj_close") + ", volume bigint",
            ("ticker_usd", "fecha"),
            "fecha",
        ),
        Table(
            "fact_income_statement_annual",
            "ticker_usd string, fecha_balance date, "
            + _doubles("ingresos", "costo_ingresos", "beneficio_bruto", "gastos_operativos", "ganancia_neta",
                       "margen_neto_pct"),
            ("ticker_usd", "fecha_balance"),
            "fecha_balance",
        ),
        Table(
            "fact_eps_trimestral",
            "ticker_usd string, fecha_reporte date, " + _doubles("eps_estimado", "eps_reportado", "sorpresa_pct"),
            ("ticker_usd", "fecha_reporte"),
            "fecha_reporte",
        ),
        Table(
            "fact_balance_cashflow_annual",
            "ticker_usd string, fecha_balance date, " + _doubles("deuda_total", "efectivo", "flujo_caja_libre"),
            ("ticker_usd", "fecha_balance"),
            "fecha_balance",
        ),
        Table("fact_macro_daily", "serie string, fecha date, valor double", ("serie", "fecha"), "fecha"),
        Table(
            "fact_consenso_analistas",
            "ticker_usd string, fecha date, "
            + _doubles("precio_objetivo_actual", "precio_objetivo_bajo", "precio_objetivo_alto",
                       "precio_objetivo_mediana")
            + ", rec_strong_buy int, rec_buy int, rec_hold int, rec_sell int, rec_strong_sell int",
            ("ticker_usd", "fecha"),
            "fecha",
        ),
        Table(
            "fact_noticias",
            "ticker_usd string, titular string, fuente string, fecha_publicacion timestamp, link string, "
            "sentimiento string, score_sentimiento double, fecha_procesado date",
            ("ticker_usd", "titular"),
        ),
        Table(
            "fact_cartera_seleccionada",
            "fecha_seleccion date, origen string, ticker_usd string, puesto int, score_compuesto double, "
            "precio_seleccion double, sector string, region string, alertas string",
            ("fecha_seleccion", "origen", "ticker_usd"),
        ),
        Table(
            "fact_precios_adr",
            "ticker_usd string, ticker_adr string, fecha date, close double, adj_close double, volume bigint",
            ("ticker_usd", "fecha"),
            "fecha",
        ),
        Table(
            "fact_resultados_trimestrales",
            "ticker_usd string, fecha_trimestre date, "
            + _doubles("ingresos", "ganancia_operativa", "ganancia_neta", "resultado_participaciones",
                       "resultados_no_recurrentes", "eps_diluido", "acciones_diluidas", "flujo_caja_operativo",
                       "flujo_caja_libre", "recompras", "pagos_en_acciones"),
            ("ticker_usd", "fecha_trimestre"),
            "fecha_trimestre",
        ),
        Table(
            "fact_insider_transacciones",
            "ticker_usd string, fecha date, insider string, cargo string, tipo string, acciones bigint, "
            "valor double, texto string",
            ("ticker_usd", "fecha", "insider", "acciones", "tipo"),
            "fecha",
        ),
        Table(
            "seguimiento",
            "ticker_usd string, desde date, motivo string, nivel_soporte double, nivel_resistencia double, "
            "nivel_salida double, activo boolean, moneda string",
            ("ticker_usd",),
        ),
        Table(
            "log_ejecuciones",
            "script string, inicio timestamp, fin timestamp, estado string, filas_afectadas int, error_detalle string",
            (),
        ),
        Table(
            "archivos_cargados",
            "carga string, ruta string, bytes bigint, modificado timestamp, filas bigint, cargado timestamp",
            ("carga", "ruta", "bytes", "modificado"),
        ),
        Table(
            "silver_calidad_datos",
            "ticker_usd string, regla string, severidad string, detalle string, fecha_evaluacion date",
            ("ticker_usd", "regla"),
        ),
    ]
}

# Names of the per-company fact tables. What people chose themselves (watchlist, saved portfolios) is not among them.
PURGED_TABLES = [
    "fact_precios_daily", "fact_metrics_daily", "fact_income_statement_annual", "fact_balance_cashflow_annual",
    "fact_eps_trimestral", "fact_consenso_analistas", "fact_noticias", "fact_precios_adr",
    "fact_resultados_trimestrales", "fact_insider_transacciones",
]


def conform(df: DataFrame, table: str) -> DataFrame:
    """Project ``df`` onto a table's schema: absent columns become NULL, types are cast, extras are left out."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in TABLES[table].schema.fields
        ]
    )
