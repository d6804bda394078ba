"""Run named queries next to their SQL and report differences: python tests/compare.py [sf dir] [name prefix …]"""
from __future__ import annotations

import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for f in glob.glob(os.path.join(sf_dir, "*.parquet")):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


def canonical(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "∅" if v is None else "nan"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return repr(v)
    return str(v)


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(canonical(r[i]) for i in order) for r in rows)


def differences(con, sql: str, df, rows=None) -> str:
    cur = con.execute(sql)
    theirs_cols = [c[0] for c in cur.description]
    theirs = rows_of(theirs_cols, cur.fetchall())
    if sorted(theirs_cols) != sorted(df.columns):
        return f"columns {sorted(df.columns)} vs {sorted(theirs_cols)}"
    ours = rows_of(df.columns, rows if rows is not None else df.collect())
    if len(ours) != len(theirs):
        return f"rows {len(ours)} vs {len(theirs)}"
    bad = [(a, b) for a, b in zip(ours, theirs) if a != b]
    return f"{len(bad)} rows differ, first {bad[0][0]} vs {bad[0][1]} ({sorted(df.columns)})" if bad else ""


def main() -> int:
    import __spark_entry__ as entry
    from assayer.session import build_session
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = tuple(sys.argv[2:]) or ("",)
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                                "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con, oracle, failed = connect(sf_dir), entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if not name.startswith(prefixes):
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in oracle:
                found = differences(con, oracle[name], df)
            else:
                found = "" if len(df.collect()) else "no rows"
        except Exception as e:  # noqa: BLE001
            found = f"{type(e).__name__}: {str(e)[:600]}"
        failed += bool(found)
        print(f"{'FAIL' if found else 'ok  '} {name} {time.time() - start:.1f}s {'' if name in oracle else '(rows only)'} {found}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
