"""Compare every query with its SQL statement: ``python tools/check.py [folder] [name ...]``."""

from __future__ import annotations

import math
import os
import sys
import time
from importlib import import_module

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from shelfsight.plans import registry  # noqa: E402
from shelfsight.plans.derived_sql import BASE_TABLES  # noqa: E402
from shelfsight.session import local_session  # noqa: E402
from verification import oracle  # noqa: E402

TYPES = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN",
         "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP", "binary": "BLOB"}


def canon(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    return "\0" if value is None else str(value)


def run(folder: str, names: list[str]) -> int:
    registry._MODULES = tuple(m for m in registry._MODULES if _there("shelfsight.plans", m))
    oracle._MODULES = tuple(m for m in oracle._MODULES if _there("verification", m))
    queries, oracles = registry.all_queries(), oracle.all_oracles()
    names = [n for n in queries if not names or n in names or any(x.endswith("*") and n.startswith(x[:-1]) for x in names)]
    spark = local_session()
    con = duckdb.connect()
    for t in BASE_TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    bad = 0
    for name in names:
        started = time.time()
        try:
            df = queries[name](spark, folder)
            rows = [tuple(r) for r in df.collect()]
        except Exception as e:  # noqa: BLE001
            print(f"ERR   {name}: {str(e)[:1500]}")
            bad += 1
            continue
        took = time.time() - started
        if name not in oracles:
            print(f"rows  {name}: {len(rows)} rows, {took:.2f}s")
            continue
        try:
            res = con.execute(oracles[name])
            want_cols = [(d[0], str(d[1])) for d in res.description]
            want = res.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"SQLERR {name}: {str(e)[:1500]}")
            bad += 1
            continue
        cols = sorted(df.columns)
        got_types = {f.name: TYPES.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema.fields}
        want_types = dict(want_cols)
        if cols != sorted(want_types):
            print(f"COLS  {name}: {cols} vs {sorted(want_types)}")
            bad += 1
            continue
        types = {c: (got_types[c], want_types[c]) for c in cols if got_types[c] != want_types[c]}
        at = [df.columns.index(c) for c in cols]
        wat = [[d for d, _ in want_cols].index(c) for c in cols]
        a = sorted(tuple(canon(r[i]) for i in at) for r in rows)
        b = sorted(tuple(canon(r[i]) for i in wat) for r in want)
        if a != b or types:
            bad += 1
            sa, sb = set(a), set(b)
            print(f"DIFF  {name}: {len(a)} vs {len(b)} rows; types {types}; cols {cols}")
            for x in sorted(sa - sb)[:3]:
                print("   spark ", str(x)[:600])
            for x in sorted(sb - sa)[:3]:
                print("   oracle", str(x)[:600])
        else:
            print(f"ok    {name}: {len(a)} rows, {took:.2f}s" + ("  EMPTY" if not a else ""))
    print("bad:", bad, "of", len(names))
    return bad


def _there(package: str, module: str) -> bool:
    try:
        import_module(f"{package}.{module}")
        return True
    except ModuleNotFoundError as e:
        if module in str(e):
            return False
        raise


if __name__ == "__main__":
    args = sys.argv[1:]
    folder = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    sys.exit(1 if run(folder, args) else 0)
