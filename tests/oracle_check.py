"""Compare registered queries with their SQL on DuckDB.

    python tests/oracle_check.py [--sf 0.01] [name-prefix ...]
"""
from __future__ import annotations

import argparse
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if v is None:
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def key(row):
    return tuple((v is None, "" if v is None else (f"{v:.4g}" if isinstance(v, float) else str(v))) for v in row)


def compare(spark_df, con, text: str):
    cols = sorted(spark_df.columns)
    rows = [tuple(norm(r[c]) for c in cols) for r in spark_df.collect()]
    res = con.execute(text)
    names = [d[0] for d in res.description]
    if sorted(names) != cols:
        return f"columns differ: {cols} vs {sorted(names)}"
    types = {d[0]: str(d[1]) for d in res.description}
    want_raw = res.fetchall()
    order = [names.index(c) for c in cols]
    want = [tuple(norm(r[i]) for i in order) for r in want_raw]
    if len(rows) != len(want):
        return f"rows {len(rows)} vs {len(want)}"
    rows.sort(key=key)
    want.sort(key=key)
    exact = True
    for a, b in zip(rows, want):
        for c, x, y in zip(cols, a, b):
            if x == y and type(x) is type(y):
                continue
            if isinstance(x, (int, float)) and isinstance(y, (int, float)) and not isinstance(x, bool):
                if math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9):
                    exact = False
                    continue
            return f"value {c}: {x!r} vs {y!r} in {dict(zip(cols, a))}"
    small = {"long": "BIGINT", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
             "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE"}
    bad = [f"{f.name}:{f.dataType.simpleString()}/{types[f.name]}" for f in spark_df.schema
           if small.get(f.dataType.simpleString()) != types[f.name]]
    note = "" if exact else " (within 1e-9)"
    return ("TYPES " + ",".join(bad)) if bad else "ok" + note


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    from __spark_entry__ import oracle_sql, queries
    from tidewatch.session import build_session

    spark = build_session("oracle-check", cores="8")
    sf_dir = f"/root/testdata/sf{args.sf}"
    con = duck(sf_dir)
    oracle, failed = oracle_sql(), []
    for name, fn in queries().items():
        if args.names and not any(name.startswith(p) for p in args.names):
            continue
        t = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in oracle:
                msg = compare(df, con, oracle[name])
            else:
                msg = f"ok rows-only {df.count()}"
        except Exception as e:  # report and go on
            msg = f"FAILED {type(e).__name__}: {str(e)[-700:]}"
        if not msg.startswith("ok"):
            failed.append(name)
        print(f"{time.time() - t:6.2f}s {name}: {msg}", flush=True)
    print("failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
