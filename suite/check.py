"""Runs registered queries on Spark and their SQL on DuckDB and compares the rows.

    python -m suite.check --sf 0.01 [name ...]
"""

from __future__ import annotations

import argparse
import math
import time

BASE_DIR = "/root/testdata"


def normal(value):
    """One comparable form of a value whatever engine made it."""
    if value is None:
        return None
    if isinstance(value, bool):
        return int(value)
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, int | str):
        return value
    if isinstance(value, list | tuple):
        return tuple(normal(v) for v in value)
    return str(value)


def rows_of(columns: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(normal(r[i]) for i in order) for r in rows]
    return sorted(out, key=repr)


def duck(sf_dir: str):
    import duckdb

    from suite.views import BASE

    con = duckdb.connect()
    for name in BASE:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def compare(spark, con, sf_dir: str, name: str) -> str:
    """'ok ...' or a description of the first difference."""
    from suite import ORACLE, QUERIES

    df = QUERIES[name](spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    if name not in ORACLE:
        return f"ok   rows={len(got)} (no SQL)"
    cur = con.execute(ORACLE[name])
    columns = [d[0] for d in cur.description]
    if sorted(columns) != sorted(df.columns):
        return f"FAIL columns {sorted(df.columns)} <> {sorted(columns)}"
    want = rows_of(columns, cur.fetchall())
    if got == want:
        return f"ok   rows={len(got)}"
    missing = [r for r in want if r not in set(got)][:2]
    extra = [r for r in got if r not in set(want)][:2]
    return f"FAIL rows {len(got)} <> {len(want)}\n   missing {str(missing)[:700]}\n   extra   {str(extra)[:700]}"


def main() -> int:
    from suite import QUERIES

    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    from citespark.session import build_session

    spark = build_session(
        "check", "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"{BASE_DIR}/sf{args.sf}"
    con = duck(sf_dir)
    bad = 0
    for name in args.names or QUERIES:
        start = time.time()
        try:
            verdict = compare(spark, con, sf_dir, name)
        except Exception as e:  # noqa: BLE001 - report and go on
            verdict = f"FAIL {type(e).__name__}: {str(e)[:900]}"
        bad += verdict.startswith("FAIL")
        print(f"{name:32s} {time.time() - start:6.2f}s {verdict}", flush=True)
    print(f"{bad} failed")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
