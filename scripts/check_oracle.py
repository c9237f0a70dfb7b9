"""Run registered queries on Spark and their SQL on DuckDB over the same parquet files and compare.

usage: check_oracle.py [--sf sf0.001] [name ...]
"""

from __future__ import annotations

import argparse
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tickerloom.catalog import QUERIES  # noqa: E402
from tickerloom.session import build_session  # noqa: E402

DATA = Path("/root/testdata")


def duck(sf_dir: Path):
    con = duckdb.connect()
    for file in sorted(sf_dir.glob("*.parquet")):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def same(a: list[tuple], b: list[tuple]) -> str | None:
    """None when equal, else a short difference. Rows are compared as multisets, exactly."""
    key = lambda row: tuple((x is not None, str(x)) for x in row)
    a, b = sorted(a, key=key), sorted(b, key=key)
    if len(a) != len(b):
        return f"{len(a)} rows against {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} of {len(a)} rows differ, first {bad[0]}" if bad else None


def check(spark, con, sf_dir: Path, query) -> tuple[str | None, int, float]:
    t = time.time()
    names = sorted(n for n, _ in query.columns)
    df = query.dataframe(spark, str(sf_dir)).select(*names)
    rows = [tuple(r) for r in df.collect()]
    took = time.time() - t
    sql = query.sql()
    if sql is None:
        return None, len(rows), took
    return same(rows, con.execute(f"SELECT {', '.join(names)} FROM ({sql})").fetchall()), len(rows), took


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="sf0.001")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    sf_dir = DATA / args.sf
    spark = build_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("OFF")
    con, failed = duck(sf_dir), 0
    for name, query in QUERIES.items():
        if args.names and name not in args.names:
            continue
        try:
            diff, n, took = check(spark, con, sf_dir, query)
        except Exception as error:  # report and go on with the others
            diff, n, took = f"{type(error).__name__}: {str(error)[:600]}", -1, 0.0
        failed += diff is not None
        print(f"{'FAIL' if diff else 'ok  '} {name} rows={n} {took:.1f}s {'' if query.body else '(no SQL)'} {diff or ''}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main())
