"""Run registered queries against their SQL twins: python tests/check_queries.py [name-part ...]"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import numpy as np
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")


def connect(sf: str = SF):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def canon(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype.kind == "f":
            df[c] = df[c].astype("float64") + 0.0
        elif df[c].dtype == object:
            df[c] = df[c].map(lambda v: v.tolist() if isinstance(v, np.ndarray) else v).map(lambda v: None if v is None or (isinstance(v, float) and np.isnan(v)) else str(v))
    return df.sort_values(list(df.columns), na_position="first").reset_index(drop=True)


def compare(a: pd.DataFrame, b: pd.DataFrame) -> str:
    if sorted(a.columns) != sorted(b.columns):
        return f"columns differ: {sorted(a.columns)} vs {sorted(b.columns)}"
    if len(a) != len(b):
        return f"rows differ: {len(a)} vs {len(b)}"
    a, b = canon(a), canon(b)
    for c in a.columns:
        ka, kb = a[c].dtype.kind, b[c].dtype.kind
        if ka != kb and {ka, kb} == set("fi") and (a[c].isna().any() or b[c].isna().any()):  # pandas has no plain integers with nulls
            a[c], b[c] = a[c].astype("float64"), b[c].astype("float64")
        elif ka != kb and not {ka, kb} <= set("OU"):
            if not (len(a) == 0):
                return f"{c}: type {a[c].dtype} vs {b[c].dtype}"
        x, y = a[c], b[c]
        bad = ~((x == y) | (x.isna() & y.isna()))
        if bad.any():
            i = bad.idxmax()
            return f"{c}: {int(bad.sum())} values differ, first\n{a.loc[i].to_dict()}\n{b.loc[i].to_dict()}"
    return "ok"


def main() -> None:
    import __spark_entry__ as entry
    from heliograde.session import local_session, release

    spark = local_session("check", os.environ.get("CHECK_CPUS", "8"))
    con = connect()
    queries, oracles = entry.queries(), entry.oracle_sql()
    want = sys.argv[1:]
    failed = []
    for name, fn in queries.items():
        if want and not any(name.startswith(w) for w in want):
            continue
        t = time.time()
        try:
            got = fn(spark, SF).toPandas()
            t1 = time.time()
            res = compare(got, con.execute(oracles[name]).df()) if name in oracles else f"no oracle, {len(got)} rows"
        except Exception as e:  # report and go on
            t1, got, res = time.time(), [], "ERROR " + str(e)[:700]
        if res != "ok" and not res.startswith("no oracle"):
            failed.append(name)
        print(f"{name:36s} {t1 - t:6.1f}s duck {time.time() - t1:5.1f}s rows {len(got):6d} {res}", flush=True)
        spark.catalog.clearCache()
        release(spark)
    print("FAILED", len(failed), failed)


if __name__ == "__main__":
    main()
