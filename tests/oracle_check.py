"""Compare registered Spark queries with their DuckDB oracle texts.

Usage: python tests/oracle_check.py [sf_dir] [name ...]
Values are compared as multisets of rows after sorting columns by name;
doubles are compared after rounding to 9 significant digits, or exactly
with ``--strict``.
"""

from __future__ import annotations

import collections
import math
import sys
import time

import duckdb

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])

from tessera.plans.catalog import all_queries  # noqa: E402
from tessera.session import get_session  # noqa: E402
from tessera.sources.tables import TABLES  # noqa: E402


STRICT = False


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v) if STRICT else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return _norm(tuple(v))
    return v


def compare(spark, con, name, q, sf):
    t = time.time()
    sdf = q.build(spark, sf)
    cols = sorted(sdf.columns)
    srows = [tuple(_norm(r[c]) for c in cols) for r in sdf.collect()]
    st = time.time() - t
    if q.oracle is None:
        return f"{name}: rows={len(srows)} (no oracle) {st:.1f}s"
    res = con.execute(q.oracle)
    ocols = [d[0] for d in res.description]
    orows_raw = res.fetchall()
    if sorted(ocols) != cols:
        return f"{name}: COLUMN MISMATCH spark={cols} oracle={sorted(ocols)}"
    idx = [ocols.index(c) for c in cols]
    orows = [tuple(_norm(r[i]) for i in idx) for r in orows_raw]
    a, b = collections.Counter(srows), collections.Counter(orows)
    if a == b:
        return f"{name}: OK rows={len(srows)} {st:.1f}s"
    diff_a = list((a - b).elements())[:3]
    diff_b = list((b - a).elements())[:3]
    return f"{name}: VALUE MISMATCH spark={len(srows)} oracle={len(orows)}\n  spark-only {diff_a}\n  oracle-only {diff_b}"


def main():
    global STRICT
    args = [a for a in sys.argv[1:] if a != "--strict"]
    STRICT = len(args) != len(sys.argv) - 1
    sf = args[0] if args else "/root/testdata/sf0.01"
    names = args[1:]
    spark = get_session("local[8]", shuffle_partitions=8)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    qs = all_queries()
    bad = 0
    for name, q in qs.items():
        if names and name not in names:
            continue
        try:
            msg = compare(spark, con, name, q, sf)
        except Exception as exc:  # report and continue
            msg = f"{name}: ERROR {type(exc).__name__}: {str(exc)[:600]}"
        if "OK" not in msg and "no oracle" not in msg:
            bad += 1
        print(msg, flush=True)
    print(f"failures: {bad}")


if __name__ == "__main__":
    main()
