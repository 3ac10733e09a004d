"""Run the registered checks against DuckDB: python -m waymark.checks.run SF_DIR [names...]."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

from waymark.checks import load_all
from waymark.checks.base import ORACLES, QUERIES
from waymark.session import local_session


def connect(sf: str):
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def canonical(columns, rows):
    """Rows with columns in name order, as sortable text."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "~"
        if isinstance(v, bool):
            return str(v)
        if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
            return repr(float(v))
        return str(v)

    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, name: str, sf: str) -> tuple[str, float, int]:
    start = time.time()
    df = QUERIES[name](spark, sf)
    rows = [tuple(r) for r in df.collect()]
    took = time.time() - start
    if name not in ORACLES:
        return "rows-only", took, len(rows)
    cur = con.execute(ORACLES[name])
    cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(cols) != sorted(df.columns):
        return f"columns {sorted(df.columns)} vs {sorted(cols)}", took, len(rows)
    got, exp = canonical(df.columns, rows), canonical(cols, want)
    if got == exp:
        return "ok", took, len(rows)
    if len(got) != len(exp):
        extra = [g for g in got if g not in set(exp)][:2]
        lack = [e for e in exp if e not in set(got)][:2]
        return f"rows {len(got)} vs {len(exp)}; spark only {extra}; sql only {lack}", took, len(rows)
    names = sorted(cols)
    for g, e in zip(got, exp):
        if g != e:
            diff = {n: (a, b) for n, a, b in zip(names, g, e) if a != b}
            return f"values {diff} in {g}", took, len(rows)
    return "?", took, len(rows)


def main() -> int:
    sf, names = sys.argv[1], sys.argv[2:]
    load_all()
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    bad = 0
    for name in QUERIES:
        if names and not any(n in name for n in names):
            continue
        try:
            verdict, took, n = compare(spark, con, name, sf)
        except Exception as exc:  # report and go on
            verdict, took, n = "error " + " ".join(str(exc).split())[:700], 0.0, -1
        if verdict not in ("ok", "rows-only"):
            bad += 1
        print(f"{name:42s} {took:6.2f}s {n:7d} {verdict}", flush=True)
    print(f"{len(QUERIES)} checks, {len(ORACLES)} with SQL, {bad} bad")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
