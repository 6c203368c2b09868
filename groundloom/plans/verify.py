"""Compare registered queries with their oracle SQL in DuckDB: python -m groundloom.plans.verify [names...]"""

from __future__ import annotations

import os
import sys
import time

import numpy as np
import pandas as pd

from groundloom.plans import catalog
from groundloom.plans.tables import PARQUET


def duck(folder: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    con.execute("SET temp_directory='/tmp/duckdb_spill'")
    con.execute("SET max_temp_directory_size='4GB'")
    for t in PARQUET:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype == object and len(df) and df[c].map(lambda v: isinstance(v, (list, np.ndarray))).any():
            df[c] = df[c].map(lambda v: None if v is None else str(list(v)))
    return df.sort_values(list(df.columns), na_position="last", kind="mergesort").reset_index(drop=True)


def differences(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    """None when equal; otherwise what differs."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} vs {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    a, b = canonical(got), canonical(want)
    notes = []
    for c in a.columns:
        ta, tb = str(a[c].dtype), str(b[c].dtype)
        if ta != tb and not (ta.startswith("datetime") and tb.startswith("datetime")) and not (len(a) and a[c].isna().all()):
            notes.append(f"type of {c}: {ta} vs {tb}")
        same = (a[c] == b[c]) | (a[c].isna() & b[c].isna())
        if not same.all():
            k = int(np.nonzero(~same.to_numpy())[0][0])
            notes.append(f"{c}: {int((~same).sum())} of {len(a)} differ, first {a[c][k]!r} vs {b[c][k]!r}")
    return "; ".join(notes) or None


def main(argv: list[str]) -> int:
    from groundloom.session import local_session

    catalog.load()
    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    names = argv or list(catalog.QUERIES)
    names = [n for n in catalog.QUERIES if any(n == a or (a.endswith("*") and n.startswith(a[:-1])) for a in names)] if argv else names
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(folder)
    bad = 0
    for n in names:
        try:
            t = time.time()
            got = catalog.QUERIES[n](spark, folder).toPandas()
            t1 = time.time() - t
            if n not in catalog.ORACLES:
                print(f"rows  {n:26s} {len(got):8d} {t1:6.2f}s", flush=True)
                continue
            t = time.time()
            want = con.execute(catalog.ORACLES[n]).df()
            diff = differences(got, want)
            bad += diff is not None
            print(f"{'ok   ' if diff is None else 'DIFF '} {n:26s} {len(got):8d} {t1:6.2f}s duck {time.time() - t:5.2f}s {diff or ''}", flush=True)
        except Exception as e:  # report and go on with the next query
            bad += 1
            print(f"FAIL  {n:26s} {type(e).__name__}: {str(e)[:600]}", flush=True)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
