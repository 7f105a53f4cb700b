"""Compare registered Spark queries with their DuckDB oracle SQL.

Usage: python tests/oracle_check.py [SF_DIR] [name-substring ...]
Prints one line per query: rows, schema and value-hash agreement.
"""

from __future__ import annotations

import hashlib
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402

EXACT = bool(os.environ.get("EXACT"))   # compare floats bit for bit (no rounding)

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if hasattr(v, "item") and not hasattr(v, "tolist") is False and getattr(v, "ndim", 1) == 0:
        v = v.item()
    if isinstance(v, float):
        if math.isnan(v):
            return None
        if not EXACT:
            v = round(v, 6)
        return int(v) if v.is_integer() else v
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if isinstance(v, pd.Timestamp):
        return v.to_pydatetime().replace(tzinfo=None).isoformat()
    return v


def digest(df: pd.DataFrame) -> str:
    cols = sorted(df.columns)
    rows = [repr(tuple(_norm(r[c]) for c in cols)) for r in df.to_dict("records")]
    rows.sort()
    return hashlib.sha1("\n".join(rows).encode()).hexdigest()[:12]


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    pats = sys.argv[2:]
    import __spark_entry__ as E
    from reelrank.session import get_session
    spark = get_session("local[8]")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    qs, sqls = E.queries(), E.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if pats and not any(p in name for p in pats):
            continue
        t0 = time.time()
        try:
            sdf = fn(spark, sf_dir).toPandas()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: spark error {str(e)[:400]}")
            bad += 1
            continue
        dt = time.time() - t0
        if name not in sqls:
            print(f"rows-only {name}: {len(sdf)} rows {dt:.1f}s")
            continue
        try:
            odf = con.execute(sqls[name]).df()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: duckdb error {str(e)[:400]}")
            bad += 1
            continue
        ok_rows = len(sdf) == len(odf)
        ok_cols = sorted(sdf.columns) == sorted(odf.columns)
        ok_hash = ok_cols and digest(sdf) == digest(odf)
        status = "ok  " if (ok_rows and ok_cols and ok_hash) else "FAIL"
        if status != "ok  ":
            bad += 1
        print(f"{status} {name}: rows {len(sdf)}/{len(odf)} cols={ok_cols} hash={ok_hash} {dt:.1f}s")
        if not ok_cols:
            print("   spark:", sorted(sdf.columns), "\n   duck: ", sorted(odf.columns))
        elif not ok_hash and os.environ.get("SHOW"):
            cols = sorted(sdf.columns)
            a = sdf[cols].sort_values(cols).reset_index(drop=True)
            b = odf[cols].sort_values(cols).reset_index(drop=True)
            print(a.head(5).to_string(), "\n", b.head(5).to_string())
    print(f"bad={bad}")
    spark.stop()


if __name__ == "__main__":
    main()
