"""Compare registered queries with their SQL counterparts: ``python tests/compare.py [sf_dir] [name ...]``."""

from __future__ import annotations

import datetime
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from plumbline.queries.oracle import ORACLE  # noqa: E402
from plumbline.queries import files  # noqa: F401  # noqa: E402
from plumbline.queries.spark import REGISTRY  # noqa: E402
from plumbline.queries.views import TABLES  # noqa: E402


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def canonical(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return 0.0 if value == 0 else value
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return value


def normal_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(canonical(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=lambda r: tuple((v is None, str(v)) for v in r))


def compare(spark, con, sf_dir: str, name: str) -> tuple[bool, str]:
    start = time.time()
    df = REGISTRY[name](spark, sf_dir)
    columns, got = normal_rows(df.columns, [tuple(r) for r in df.collect()])
    spent = time.time() - start
    if name not in ORACLE:
        return True, f"rows only, {len(got)} rows, {spent:.1f}s"
    start = time.time()
    result = con.execute(ORACLE[name])
    want_columns, want = normal_rows([d[0] for d in result.description], result.fetchall())
    note = f"{len(got)} rows, {spent:.1f}s, sql {time.time() - start:.1f}s"
    if columns != want_columns:
        return False, f"columns {columns} <> {want_columns}"
    if len(got) != len(want):
        return False, f"{note}; sql has {len(want)} rows"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return False, f"{note}; {len(bad)} rows differ, e.g. {bad[0][0]} <> {bad[0][1]}"
    types = sorted({f"{c}:{type(a).__name__}/{type(b).__name__}" for g, w in zip(got[:50], want[:50])
                    for c, a, b in zip(columns, g, w) if type(a) is not type(b)})
    return not types, note + (f"; types {types}" if types else "")


if __name__ == "__main__":
    from plumbline.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    chosen = sys.argv[2:] or list(REGISTRY)
    spark = build_session(master="local[8]", spark_sql_shuffle_partitions="8", spark_driver_memory="8g", spark_ui_enabled="false")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = []
    for name in chosen:
        try:
            ok, note = compare(spark, con, sf_dir, name)
        except Exception as error:  # one broken query must not hide the others
            ok, note = False, f"{type(error).__name__}: {str(error)[:600]}"
        print("ok  " if ok else "FAIL", name, note, flush=True)
        if not ok:
            failed.append(name)
    print(f"{len(chosen) - len(failed)} of {len(chosen)} agree; failed: {failed}")
