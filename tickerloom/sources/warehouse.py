"""The warehouse: tables as parquet folders, dated ones cut by year, under snapshots of ``sources.manifest``.

Every write goes to new folders and becomes visible with one commit, whatever number of years or tables it touches. An upsert of a dated table
reads and rewrites only the years its batch touches; two writers of different years both go through, of the same year the later one merges anew.
Company tables keep, beside each year's rows, the tickers that occur in it: a purge rewrites the years of those that leave and nothing else.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.plans import merge
from tickerloom.schemas import PURGED_TABLES, TABLES, conform
from tickerloom.sources.manifest import Edit, Manifest, Part, Snapshot

YEAR, KEY = "anio", "ticker_usd"
MANY_PARTS = 32  # folders of one year before an append joins them


class Warehouse:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.manifest = Manifest(spark, self.root)

    # -- folders

    def _rows(self, table: str, parts: list[Part]) -> DataFrame:
        # the known schema: no file is opened to learn it, and a column added to a table later reads as NULL in older files
        if not parts:
            return self.spark.createDataFrame([], TABLES[table].ddl)
        return self.spark.read.schema(TABLES[table].ddl).parquet(*[f"{self.root}/{p.data}" for p in parts])

    def _write(self, table: str, df: DataFrame) -> list[Part]:
        """Rows of a table in a new folder, cut by year, with the keys of each year where the table can be purged."""
        date = TABLES[table].date_column
        year = F.coalesce(F.year(date), F.lit(0)) if date else F.lit(0)
        name = f"{table}/{uuid.uuid4().hex[:16]}"
        # spread rows so that a year is written by several tasks, not by one, and files stay large
        laid = conform(df, table).withColumn(YEAR, year).hint("rebalance", YEAR)
        laid.write.partitionBy(YEAR).option("partitionOverwriteMode", "static").parquet(f"{self.root}/{name}")
        keyed = table in PURGED_TABLES
        if keyed:
            written = self.spark.read.schema(f"{KEY} string, {YEAR} int").parquet(f"{self.root}/{name}")
            written.select(KEY, YEAR).distinct().write.partitionBy(YEAR).parquet(f"{self.root}/{name}-keys")
        years = [s.getPath().getName() for s in self.manifest.listing(name)]
        years = sorted(int(y.removeprefix(f"{YEAR}=")) for y in years if y.startswith(f"{YEAR}="))
        return [Part(y, f"{name}/{YEAR}={y}", f"{name}-keys/{YEAR}={y}" if keyed else None) for y in years]

    def keys(self, table: str, snapshot: Snapshot | None = None) -> DataFrame:
        """(tabla, anio, ticker_usd): the companies in each year of a table, read from the summaries alone."""
        found = None
        for part in (snapshot or self.manifest.latest()).parts(table):
            own = self.spark.read.schema(f"{KEY} string").parquet(f"{self.root}/{part.keys}")
            own = own.select(F.lit(table).alias("tabla"), F.lit(part.year).alias(YEAR), KEY)
            found = own if found is None else found.unionByName(own)
        return self.spark.createDataFrame([], f"tabla string, {YEAR} int, {KEY} string") if found is None else found

    # -- reading and writing

    def read(self, table: str) -> DataFrame:
        """The table as of now; the frame keeps reading this snapshot whatever is committed later."""
        return self._rows(table, self.manifest.latest().parts(table))

    def rewrite(self, table: str, df: DataFrame) -> None:
        """Replace the whole table. What is worked out from the stored rows goes through ``update``."""
        parts = self._write(table, df)
        self.manifest.commit(lambda _: Edit(whole={table: parts}))

    def update(self, table: str, how: Callable[[DataFrame], DataFrame]) -> None:
        """Replace the whole table by ``how`` of its rows; done again if somebody changes it meanwhile."""
        self.manifest.commit(lambda now: Edit(whole={table: self._write(table, how(self._rows(table, now.parts(table))))}, reads={(table, None)}))

    def publish(self, name: str, df: DataFrame) -> DataFrame:
        """Store a derived result under its own name and hand back the stored rows: what follows reads those, not the plan behind them."""
        target = f"{name}/{uuid.uuid4().hex[:16]}"
        df.write.parquet(f"{self.root}/{target}")
        self.manifest.commit(lambda _: Edit(whole={name: [Part(None, target)]}))
        return self.spark.read.parquet(f"{self.root}/{target}")

    def published(self, name: str) -> DataFrame:
        parts = self.manifest.latest().parts(name)
        if not parts:
            raise LookupError(f"{name} has not been published yet")
        return self.spark.read.parquet(*[f"{self.root}/{p.data}" for p in parts])

    def append(self, table: str, df: DataFrame) -> None:
        """Add rows; appends never wait for each other."""
        parts = self._write(table, df)
        now = self.manifest.commit(lambda _: Edit(added={table: parts}))
        crowded = [y for y in now.years(table) if len(now.parts(table, y)) > MANY_PARTS]
        if crowded:
            self._change_years(table, crowded, lambda stored: stored)

    def _change_years(
        self, table: str, years: list[int], how: Callable[[DataFrame], DataFrame], stream: tuple[str, int] | None = None, alongside: tuple[str, DataFrame] | None = None
    ) -> None:
        def change(now: Snapshot) -> Edit | None:
            if stream and now.batches.get(stream[0], -1) >= stream[1]:
                return None
            stored = self._rows(table, [p for y in years for p in now.parts(table, y)])
            parts = self._write(table, how(stored))
            return Edit(
                by_year={(table, y): [p for p in parts if p.year == y] for y in {*years, *(p.year for p in parts)}},
                added={alongside[0]: self._write(*alongside)} if alongside else {}, batches=dict([stream]) if stream else {}, reads={(table, y) for y in years},
            )

        self.manifest.commit(change)

    def upsert(
        self, table: str, batch: DataFrame, how: Callable[..., DataFrame] = merge.upsert_overwrite, stream: tuple[str, int] | None = None,
        alongside: tuple[str, DataFrame] | None = None, **options,
    ) -> None:
        """Merge a batch by the table's key with ``how`` (``merge.upsert_overwrite``, ``upsert_coalesce``, ...).

        ``stream`` is a stream's name and the number of its batch: a batch that was committed before changes nothing, so a replay is harmless
        for any ``how``, and the number is committed together with the rows. ``alongside`` is a table and rows appended to it in the same commit.
        """
        spec, batch = TABLES[table], conform_present(batch, table)
        years = [0]
        if spec.date_column:
            found = batch.select(F.coalesce(F.year(spec.date_column), F.lit(0)).alias(YEAR)).distinct().collect()  # one small integer per calendar year
            years = sorted(r[0] for r in found)
        if years or stream or alongside:
            self._change_years(table, years, lambda stored: how(stored, batch, spec.key, **options), stream, alongside)

    def replace_slices(self, table: str, batch: DataFrame, slice_key: list[str], stream: tuple[str, int] | None = None) -> None:
        """Every slice of ``slice_key`` the batch brings is replaced by the batch's rows of it."""
        years = self.manifest.latest().years(table) or [0]
        self._change_years(table, years, lambda stored: merge.replace_slice(stored, conform(batch, table), slice_key), stream)

    def upsert_dimension(self, batch: DataFrame) -> None:
        self.update("dim_empresa", lambda stored: merge.upsert_dimension(stored, conform_present(batch, "dim_empresa")))

    # -- purge

    def purge_rows(self, universe: DataFrame, min_share: float = merge.PURGE_MIN_SHARE) -> DataFrame:
        """Drop companies outside the universe everywhere in one commit; returns the tickers that left (none when the valve held).

        They are found in the key summaries and stay a stored frame; the driver learns only which years of which tables hold any of them.
        """
        keep = universe.select(KEY).distinct()
        name = f"_purged/{uuid.uuid4().hex[:16]}"

        def change(now: Snapshot) -> Edit | None:
            dim = self._rows("dim_empresa", now.parts("dim_empresa"))
            known = dim.select(KEY).distinct()
            counts = known.join(keep.withColumn("_in", F.lit(1)), KEY, "left").agg(F.count("_in").alias("kept"), F.count("*").alias("all")).first()
            if counts["kept"] < min_share * counts["all"]:
                known = known.limit(0)
            every = {t: self.keys(t, now) for t in PURGED_TABLES if now.parts(t)} if counts["kept"] >= min_share * counts["all"] else {}
            for own in every.values():
                known = known.union(own.select(KEY))
            known.distinct().join(keep, KEY, "left_anti").write.mode("overwrite").parquet(f"{self.root}/{name}")
            gone = self.spark.read.schema(f"{KEY} string").parquet(f"{self.root}/{name}")
            if gone.isEmpty():
                return None
            edit = Edit(reads={("dim_empresa", None), *((t, None) for t in every)})
            edit.whole["dim_empresa"] = self._write("dim_empresa", dim.join(gone, KEY, "left_anti"))
            for table, own in every.items():
                years = [r[0] for r in own.join(gone, KEY, "left_semi").select(YEAR).distinct().collect()]
                if years:
                    rows = self._rows(table, [p for y in years for p in now.parts(table, y)])
                    parts = self._write(table, rows.join(gone, KEY, "left_anti"))
                    edit.by_year.update({(table, y): [p for p in parts if p.year == y] for y in years})
            return edit

        self.manifest.commit(change)
        return self.spark.read.schema(f"{KEY} string").parquet(f"{self.root}/{name}")

    def purge(self, universe: DataFrame) -> list[str]:
        """``purge_rows`` for a universe whose removed tickers are few enough to name."""
        return [r[KEY] for r in self.purge_rows(universe).orderBy(KEY).collect()]

    def vacuum(self, keep: int = 10, older_than_hours: float = 24) -> list[str]:
        """Delete what the last ``keep`` snapshots do not refer to, sparing folders that a writer may still be filling."""
        return self.manifest.vacuum(keep, int(older_than_hours * 3_600_000))

    def logged(self, script: str):
        """Context manager that leaves a row in the run log."""
        from tickerloom.plans.runlog import Run

        return Run(self.spark, script, lambda row: self.append("log_ejecuciones", row))


def conform_present(df: DataFrame, table: str) -> DataFrame:
    """Only the columns the frame has, cast to the table's types: an absent column is not the same as a NULL one."""
    types = {f.name: f.dataType for f in TABLES[table].schema.fields}
    return df.select(*[F.col(c).cast(types[c]).alias(c) for c in df.columns if c in types])
