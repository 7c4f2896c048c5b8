"""Runs registered queries and their oracle SQL on the same tables and compares the results.

    python tests/oracle_check.py [--sf DIR] [query-prefix ...]
"""

import argparse
import glob
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb
import numpy as np
import pandas as pd


def connect(sf_dir):
    connection = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def canonical(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)]
    keys = [c for c in frame.columns if frame[c].dtype.kind not in "f"] or list(frame.columns)
    rest = [c for c in frame.columns if c not in keys]
    return frame.sort_values(keys + rest, kind="stable").reset_index(drop=True)


def differences(spark_frame: pd.DataFrame, oracle_frame: pd.DataFrame) -> list[str]:
    """Empty when columns, kinds, row counts and all values agree exactly."""
    a, b = canonical(spark_frame), canonical(oracle_frame)
    if list(a.columns) != list(b.columns):
        return [f"columns {list(a.columns)} vs {list(b.columns)}"]
    if len(a) != len(b):
        return [f"rows {len(a)} vs {len(b)}"]
    found = []
    for c in a.columns:
        if a[c].dtype != b[c].dtype and not (a[c].dtype.kind == b[c].dtype.kind == "O"):
            found.append(f"{c}: type {a[c].dtype} vs {b[c].dtype}")
        equal = (a[c] == b[c]) | (a[c].isna() & b[c].isna())
        if not equal.all():
            bad = ~equal
            worst = ""
            if a[c].dtype.kind in "if" and b[c].dtype.kind in "if":
                worst = f", largest {np.nanmax(np.abs(a[c][bad].astype(float) - b[c][bad].astype(float)))}"
            found.append(f"{c}: {bad.sum()} values differ{worst}")
        elif a[c].dtype.kind == "f" and (np.signbit(a[c].fillna(0)) != np.signbit(b[c].fillna(0))).any():
            found.append(f"{c}: sign of zero")
    return found


def main():
    from faultframe.plans.registry import oracles, registered
    from faultframe.session import local_session

    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    options = parser.parse_args()
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(options.sf)
    failed = 0
    for name, build in registered().items():
        if options.names and not any(name.startswith(p) for p in options.names):
            continue
        began = time.time()
        try:
            frame = build(spark, options.sf).toPandas()
            took = time.time() - began
            if name in oracles():
                began = time.time()
                problems = differences(frame, connection.execute(oracles()[name]).df())
                oracle_took = time.time() - began
            else:
                problems, oracle_took = [] if len(frame) else ["no rows"], float("nan")
            empty = " EMPTY" if not len(frame) else ""
            print(f"{'ok  ' if not problems else 'FAIL'} {name} rows={len(frame)}{empty} {took:.1f}s/{oracle_took:.1f}s {problems or ''}", flush=True)
            failed += bool(problems)
        except Exception as error:
            failed += 1
            print(f"FAIL {name} {type(error).__name__}: {str(error)[:600]}", flush=True)
    print("failed", failed)
    return failed


if __name__ == "__main__":
    sys.exit(bool(main()))
