"""Idempotent merges: keyed upserts, slice replacement, overlays and the universe purge.

All of them are plain DataFrame plans (a stored frame and an incoming one go in, the new state comes
out), so a lost task is simply recomputed; ``sources.warehouse`` persists the result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.functions.expr import AsOf
from tickerloom.schemas import PURGED_TABLES

PURGE_MIN_SHARE = 0.9
KEEP_NEW, KEEP_KNOWN, KEEP_STORED = "new", "known", "stored"


def last_of_key(incoming: DataFrame, key: Sequence[str], order_by: str | Column | None = None) -> DataFrame:
    """One row per key of a batch: the last by ``order_by`` (ties: the largest row)."""
    rest = [c for c in incoming.columns if c not in key]
    order = F.struct(*([F.col(order_by) if isinstance(order_by, str) else order_by] if order_by is not None else []), *rest)
    picked = incoming.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("_r"))
    return picked.select(*key, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*incoming.columns)


def upsert_overwrite(stored: DataFrame, incoming: DataFrame, key: Sequence[str], order_by: str | None = None) -> DataFrame:
    """Incoming rows replace stored ones whole, NULLs included."""
    new = last_of_key(incoming, key, order_by)
    return stored.join(new.select(*key), list(key), "left_anti").unionByName(
        new.select(*[c for c in stored.columns if c in new.columns]), allowMissingColumns=True
    )


def upsert_by_policy(
    stored: DataFrame, incoming: DataFrame, key: Sequence[str], policy: dict[str, str], default: str = KEEP_KNOWN,
    order_by: str | None = None,
) -> DataFrame:
    """Merge column by column on existing keys; new keys enter as they are.

    ``new`` takes the incoming value even if NULL, ``known`` takes it unless it is NULL, ``stored`` never
    changes what is there. A column the batch does not carry keeps its stored value.
    """
    key = list(key)
    new = last_of_key(incoming, key, order_by)
    marked = new.select(*key, *[F.col(c).alias(f"_n_{c}") for c in new.columns if c not in key], F.lit(True).alias("_in"))
    both = stored.withColumn("_old", F.lit(True)).join(marked, key, "full_outer")

    def merged(c: str) -> Column:
        if c in key:
            return F.col(c)
        if f"_n_{c}" not in marked.columns:
            return F.col(c)
        fresh, old = F.col(f"_n_{c}"), F.col(c)
        rule = policy.get(c, default)
        if rule == KEEP_STORED:
            changed = old
        elif rule == KEEP_NEW:
            changed = F.when(F.col("_in"), fresh).otherwise(old)
        else:
            changed = F.coalesce(fresh, old)
        return F.when(F.col("_old").isNull(), fresh).otherwise(changed).alias(c)

    return both.select(*[merged(c) for c in stored.columns])


def upsert_coalesce(stored: DataFrame, incoming: DataFrame, key: Sequence[str], order_by: str | None = None) -> DataFrame:
    """Two writers share a row: a known incoming value wins, an unknown one leaves what was there."""
    return upsert_by_policy(stored, incoming, key, {}, KEEP_KNOWN, order_by)


# Columns of the company dimension by how an automatic load may touch them.
DIM_POLICY = {
    **{c: KEEP_NEW for c in ("ticker_cedear", "ticker_yahoo", "ticker_adr_usa", "mercado", "nombre_empresa", "variantes", "actualizado_en")},
    **{c: KEEP_KNOWN for c in ("sector", "industria", "pais_origen", "moneda_cotizacion", "moneda_balance")},
    **{c: KEEP_STORED for c in ("sector_corregido", "lynch_category", "modelo_negocio")},
}


def upsert_dimension(stored: DataFrame, incoming: DataFrame, now: Column | None = None) -> DataFrame:
    """Refresh identity and classification; hand-made columns stay as they are, or empty for a new company."""
    manual = [c for c, rule in DIM_POLICY.items() if rule == KEEP_STORED]
    automatic = incoming.drop(*manual).withColumn("actualizado_en", now if now is not None else F.current_timestamp())
    return upsert_by_policy(stored, automatic, ["ticker_usd"], DIM_POLICY)


def replace_slice(stored: DataFrame, incoming: DataFrame, slice_key: Sequence[str]) -> DataFrame:
    """Drop every stored row of the slices the batch brings, then add the batch."""
    slices = incoming.select(*slice_key).distinct()
    return stored.join(slices, list(slice_key), "left_anti").unionByName(incoming, allowMissingColumns=True)


def week_already_saved(saved: DataFrame, date: AsOf, origin: str = "semanal") -> DataFrame:
    """One row with ``ya``: whether that week (Monday to Sunday) already has a portfolio of the origin."""
    day = date if isinstance(date, Column) else F.lit(date)
    same_week = F.date_trunc("week", "fecha_seleccion") == F.date_trunc("week", day.cast("date"))
    return saved.agg(F.coalesce(F.bool_or((F.col("origen") == origin) & same_week), F.lit(False)).alias("ya"))


def save_portfolio(saved: DataFrame, rows: DataFrame) -> DataFrame:
    """Replace the (date, origin) slice; a 'semanal' batch is kept only if its week has none yet."""
    weekly = saved.filter(F.col("origen") == "semanal").select(F.date_trunc("week", "fecha_seleccion").alias("_w")).distinct()
    fresh = rows.withColumn("_w", F.when(F.col("origen") == "semanal", F.date_trunc("week", "fecha_seleccion")))
    fresh = fresh.join(weekly, "_w", "left_anti").drop("_w")
    return replace_slice(saved, fresh, ["fecha_seleccion", "origen"])


def overlay(stored: DataFrame, corrections: DataFrame, key: str, column: str) -> DataFrame:
    """Set one column from a short list of corrections, leaving the other rows alone."""
    fixes = last_of_key(corrections.select(key, F.col(column).alias("_fix")), [key])
    return (
        stored.join(fixes, key, "left")
        .withColumn(column, F.coalesce("_fix", F.col(column)))
        .select(*stored.columns)
    )


def purge_universe(
    dim: DataFrame, facts: dict[str, DataFrame], universe: DataFrame, min_share: float = PURGE_MIN_SHARE
) -> tuple[DataFrame, dict[str, DataFrame], DataFrame]:
    """(dim, facts, removed): only companies of the new universe remain, unless the universe looks incomplete.

    When fewer than ``min_share`` of today's companies are in it nothing is removed. The decision is a scalar
    subquery inside each plan.
    """
    keep = universe.select("ticker_usd").distinct()
    known = dim.select("ticker_usd").distinct()
    counts = known.join(keep.withColumn("_in", F.lit(1)), "ticker_usd", "left").agg(
        (F.coalesce(F.count("_in") < min_share * F.count("*"), F.lit(False)) & (F.count("*") > 0)).alias("corto")
    )
    short = counts.scalar()

    def kept(df: DataFrame) -> DataFrame:
        flagged = df.join(keep.withColumn("_in", F.lit(True)), "ticker_usd", "left")
        return flagged.filter(short | F.col("_in").isNotNull()).select(*df.columns)

    touched = {name: df for name, df in facts.items() if name in PURGED_TABLES}
    ids = known
    for df in touched.values():
        ids = ids.union(df.select("ticker_usd").distinct())
    removed = ids.distinct().join(keep, "ticker_usd", "left_anti").filter(~short)
    new_facts = {name: kept(df) if name in touched else df for name, df in facts.items()}
    return kept(dim), new_facts, removed


def watch_add(watch: DataFrame, entries: DataFrame, dim: DataFrame) -> DataFrame:
    """Add or refresh watchlist entries of known companies; the start date of one already listed stays."""
    fresh = (
        entries.withColumn("ticker_usd", F.upper("ticker_usd"))
        .join(dim.select("ticker_usd"), "ticker_usd", "left_semi")
        .withColumn("activo", F.lit(True))
    )
    policy = {c: KEEP_NEW for c in watch.columns if c not in ("ticker_usd", "desde")} | {"desde": KEEP_STORED}
    return upsert_by_policy(watch, fresh, ["ticker_usd"], policy)


def watch_remove(watch: DataFrame, tickers: list[str]) -> DataFrame:
    gone = F.col("ticker_usd").isin([t.upper() for t in tickers])
    return watch.withColumn("activo", F.when(gone, F.lit(False)).otherwise(F.col("activo")))


def watch_list(watch: DataFrame) -> DataFrame:
    return watch.filter("activo").orderBy("desde", "ticker_usd")
