"""Compare registered queries with their SQL oracle.

usage: python tools/check.py [sf] [name-prefix ...]
"""

from __future__ import annotations

import importlib
import sys
import time
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def kind(s: pd.Series) -> str:
    if pd.api.types.is_bool_dtype(s):
        return "bool"
    if pd.api.types.is_integer_dtype(s):
        return "int"
    if pd.api.types.is_float_dtype(s):
        return "float"
    return type(s.dropna().iloc[0]).__name__ if len(s.dropna()) else "empty"


def canon(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    rows = []
    for row in df.itertuples(index=False):
        out = []
        for v in row:
            if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and np.isnan(v)):
                out.append("NULL")
            elif isinstance(v, (float, np.floating)):
                out.append(repr(float(v)))
            elif isinstance(v, (int, np.integer)) and not isinstance(v, bool):
                out.append(repr(float(v)))
            elif isinstance(v, (list, np.ndarray)):
                out.append(repr([x for x in v]))
            else:
                out.append(str(v))
        rows.append(tuple(out))
    return sorted(rows)


def compare(got: pd.DataFrame, want: pd.DataFrame) -> str:
    if sorted(got.columns) != sorted(want.columns):
        return f"COLUMNS {sorted(got.columns)} vs {sorted(want.columns)}"
    if len(got) != len(want):
        return f"ROWS {len(got)} vs {len(want)}"
    a, b = canon(got), canon(want)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"VALUES {len(bad)} differ, e.g. {bad[0][0]} vs {bad[0][1]}"
    kinds = {c: (kind(got[c]), kind(want[c])) for c in got.columns
             if kind(got[c]) != kind(want[c])}
    return f"ok (kinds {kinds})" if kinds else "ok"


def spark_session(cpus: str = "8"):
    from pyspark.sql import SparkSession
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("check")
             .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
             .config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC")
             .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].startswith("0.") else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    entry = importlib.import_module("__spark_entry__")
    queries, oracle = entry.queries(), entry.oracle_sql()
    names = [n for n in queries if not args or any(n == a or (a.endswith("*") and n.startswith(a[:-1]))
                                                   for a in args)]
    spark, con = spark_session(), connect(sf_dir)
    bad = 0
    for n in names:
        t = time.time()
        try:
            got = queries[n](spark, sf_dir).toPandas()
        except Exception as exc:  # report and go on with the other queries
            msg = str(exc)
            print(f"FAIL {n}: SPARK {msg[:700]}", flush=True)
            bad += 1
            continue
        dt = time.time() - t
        if n not in oracle:
            print(f"rows {n}: {len(got)} rows {dt:.1f}s", flush=True)
            continue
        try:
            want = con.execute(oracle[n]).fetchdf()
        except Exception as exc:
            print(f"FAIL {n}: DUCKDB {str(exc)[:700]}", flush=True)
            bad += 1
            continue
        res = compare(got, want)
        bad += not res.startswith("ok")
        print(f"{'' if res.startswith('ok') else 'FAIL '}{n}: {res} {len(got)} rows {dt:.1f}s", flush=True)
    print(f"{len(names)} checked, {bad} bad")


if __name__ == "__main__":
    main()
