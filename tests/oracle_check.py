"""Run registered queries next to their SQL and compare values.

    python tests/oracle_check.py /root/testdata/sf0.01 [query ...]
"""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb
import numpy as np
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def ordered(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns), kind="stable", ignore_index=True)


def difference(spark_df: pd.DataFrame, sql_df: pd.DataFrame, slack: float = 0.0) -> str | None:
    """What differs between two results; None if nothing does. Exact without ``slack``."""
    if sorted(spark_df.columns) != sorted(sql_df.columns):
        return f"columns {sorted(spark_df.columns)} against {sorted(sql_df.columns)}"
    if len(spark_df) != len(sql_df):
        return f"{len(spark_df)} rows against {len(sql_df)}"
    a, b = ordered(spark_df), ordered(sql_df)
    for c in a.columns:
        if a[c].dtype.kind != b[c].dtype.kind and not a[c].isna().any():
            return f"column {c}: type {a[c].dtype} against {b[c].dtype}"
        x, y = a[c], b[c]
        if y.dtype.kind in "fiub":
            x, y = x.astype(float).to_numpy(), y.astype(float).to_numpy()
            bad = ~((x == y) | (np.isnan(x) & np.isnan(y)) | (np.abs(x - y) <= slack))
        else:
            bad = (x.fillna("") != y.fillna("")).to_numpy()
        if bad.any():
            i = int(np.argmax(bad))
            return f"column {c}: {int(bad.sum())} differ, first {x[i]!r} against {y[i]!r}"
    return None


def main(sf: str, names: list[str]) -> int:
    from __spark_entry__ import oracle_sql, queries
    from furlong.session import local_session

    spark = local_session(8)
    con = connect(sf)
    sql, failed = oracle_sql(), []
    for name, run in queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            got = run(spark, sf).toPandas()
        except Exception as e:
            failed.append(name)
            print(f"FAIL {name}: {type(e).__name__} {str(e)[:1500]}", flush=True)
            continue
        took = time.time() - start
        start = time.time()
        if name not in sql:
            print(f"rows {name}: {len(got)} rows, {took:.1f}s\n{got.head(20)}", flush=True)
            continue
        diff = difference(got, con.execute(sql[name]).df())
        print(f"{'FAIL' if diff else 'ok  '} {name}: {diff or f'{len(got)} rows'}, "
              f"{took:.1f}s, sql {time.time() - start:.1f}s", flush=True)
        if diff:
            failed.append(name)
    print("failed:", failed)
    return bool(failed)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
