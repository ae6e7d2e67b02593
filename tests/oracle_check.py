"""Compare every registered query with its SQL on one scale; run as a script for a report."""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{sf}/{name}.parquet')")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype.kind == "f":
            df[c] = df[c].round(9)
        df[c] = df[c].astype(object).where(df[c].notna(), None)
        df[c] = df[c].map(lambda v: v if v is None else (repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)))
    return df.sort_values(list(df.columns), na_position="first", ignore_index=True)


def difference(spark_df: pd.DataFrame, sql_df: pd.DataFrame) -> str | None:
    """None if the two hold the same rows, else what differs first."""
    if sorted(spark_df.columns) != sorted(sql_df.columns):
        return f"columns {sorted(spark_df.columns)} and {sorted(sql_df.columns)}"
    if len(spark_df) != len(sql_df):
        return f"{len(spark_df)} and {len(sql_df)} rows"
    a, b = canonical(spark_df), canonical(sql_df)
    for c in a.columns:
        off = a[c].fillna("\0") != b[c].fillna("\0")
        if off.any():
            i = off.idxmax()
            return f"{c} at row {i}: {str(a[c][i])[:200]!r} and {str(b[c][i])[:200]!r} ({off.sum()} rows)"
    return None


def main() -> None:
    import __spark_entry__ as entry
    from spanmill.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(entry.queries())
    spark = local_session(8)
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf)
    oracles = entry.oracle_sql()
    bad = 0
    for name in names:
        start = time.time()
        try:
            got = entry.queries()[name](spark, sf).toPandas()
        except Exception as e:
            bad += 1
            print(f"FAIL {name}: spark {str(e)[:600]}", flush=True)
            continue
        middle = time.time()
        try:
            want = con.sql(oracles[name]).df() if name in oracles else None
            wrong = difference(got, want) if want is not None else "no SQL"
        except Exception as e:
            wrong = f"sql {str(e)[:600]}"
        bad += wrong is not None
        print(f"{'ok  ' if wrong is None else 'FAIL'} {name}: {len(got)} rows, spark {middle - start:.1f}s, sql {time.time() - middle:.1f}s{'' if wrong is None else ': ' + wrong}", flush=True)
    print(f"{len(names)} queries, {bad} different")


if __name__ == "__main__":
    main()
