"""Run bound queries against their oracles: check.py [-d DIR] [name-prefix ...]"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from rampwise.bindings import catalog  # noqa: E402
from rampwise.session import local_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(d: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{d}/{t}.parquet')")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):  # an undefined ratio is NaN in one engine, null in the other
        return "~null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return repr(0.0 if v == 0 else v)
    return str(v)


def normal(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, name: str, d: str):
    """(ok, message); ok is None for a query without an oracle."""
    df = catalog.QUERIES[name](spark, d)
    got = df.collect()
    if name not in catalog.ORACLES:
        return None, f"rows={len(got)}"
    rel = con.sql(catalog.ORACLES[name])
    names, want = normal(rel.columns, rel.fetchall())
    names2, have = normal(df.columns, [tuple(r) for r in got])
    kinds = dict(df.dtypes)
    theirs = dict(zip(rel.columns, map(str, rel.types)))
    same = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "int": "INTEGER",
            "date": "DATE", "timestamp": "TIMESTAMP"}
    if names != names2:
        return False, f"columns {names2} != {names}"
    odd = [f"{c}:{kinds[c]}/{theirs[c]}" for c in names if same.get(kinds[c]) != theirs[c]]
    if len(want) != len(have):
        return False, f"rows {len(have)} != {len(want)} {odd or ''}"
    bad = [(h, w) for h, w in zip(have, want) if h != w]
    if bad:
        return False, f"{len(bad)} of {len(want)} rows differ; columns {names}; have {bad[0][0]} want {bad[0][1]} {odd or ''}"
    if odd:
        return False, f"types {odd}"
    return True, f"rows={len(have)}"


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("-d", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    spark, con = local_session("check"), connect(args.d)
    bad = 0
    for name in catalog.QUERIES:
        if args.names and not any(name.startswith(p) for p in args.names):
            continue
        t0 = time.time()
        try:
            ok, note = compare(spark, con, name, args.d)
        except Exception as e:  # noqa: BLE001
            ok, note = False, f"{type(e).__name__}: {str(e)[:900]}"
        bad += ok is False
        print(f"{'rows' if ok is None else 'ok' if ok else 'BAD':5s}{time.time() - t0:6.1f}s {name:34s} {note}", flush=True)
    print(f"{bad} bad")


if __name__ == "__main__":
    main()
