"""Run registered queries next to DuckDB and compare names, kinds and values.

    python tests/compare.py /root/testdata/sf0.01 [name-prefix ...]
"""

from __future__ import annotations

import datetime as dt
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from trialmill.plans.fixtures import TABLES  # noqa: E402


def oracle(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _kind(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return "bool"
    if isinstance(v, int):
        return "int"
    if isinstance(v, float):
        return "float"
    if isinstance(v, (dt.datetime, dt.date)):
        return "time"
    return type(v).__name__


def _plain(v):
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], [tuple(_plain(r[i]) for i in order) for r in rows]


def difference(spark_cols, spark_rows, sql_cols, sql_rows) -> str | None:
    """None when both results hold the same rows, else what differs first."""
    a_cols, a = rows_of(spark_cols, spark_rows)
    b_cols, b = rows_of(sql_cols, sql_rows)
    if a_cols != b_cols:
        return f"columns {a_cols} vs {b_cols}"
    if len(a) != len(b):
        return f"{len(a)} rows vs {len(b)}"
    for i, c in enumerate(a_cols):
        kinds = ({_kind(r[i]) for r in a} - {None}), ({_kind(r[i]) for r in b} - {None})
        if kinds[0] != kinds[1]:
            return f"column {c}: kinds {kinds[0]} vs {kinds[1]}"

    def key(r):
        return tuple((x is not None, str(x)) for x in r)

    a, b = sorted(a, key=key), sorted(b, key=key)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} rows differ, first\n   {bad[0][0]}\n   {bad[0][1]}"
    return None


def main() -> int:
    from trialmill.plans.registry import load_all
    from trialmill.session import local_session

    sf_dir, prefixes = sys.argv[1], tuple(sys.argv[2:])
    spark, con, failed = local_session(), oracle(sf_dir), 0
    for name, q in load_all().items():
        if prefixes and not name.startswith(prefixes):
            continue
        began = time.time()
        try:
            df = q.build(spark, sf_dir)
            rows = [tuple(r) for r in df.collect()]
            took = time.time() - began
            if q.sql is None:
                print(f"rows  {name}: {len(rows)} rows, {took:.1f}s")
                continue
            cur = con.execute(q.sql)
            what = difference(df.columns, rows, [c[0] for c in cur.description], cur.fetchall())
        except Exception as e:  # noqa: BLE001
            what, took = f"{type(e).__name__}: {str(e)[:900]}", time.time() - began
        failed += what is not None
        print(f"{'FAIL' if what else 'ok   '} {name}: {what or str(len(rows)) + ' rows'}, {took:.1f}s", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main())
