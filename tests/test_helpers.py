"""Compare a query's rows with those of its SQL in DuckDB, whatever their order."""

from __future__ import annotations

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        at = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{at + '/*.parquet' if os.path.isdir(at) else at}'")
    return con


def plain(frame, columns):
    def value(v):
        if pd.isna(v):
            return None
        return f"{v:.9g}" if isinstance(v, float) else str(v)

    return sorted([tuple(value(v) for v in r) for r in frame[columns].astype(object).itertuples(index=False)], key=str)


def same_rows(df, sql, sf_dir):
    got, want = df.toPandas(), connection(sf_dir).execute(sql).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert plain(got, columns) == plain(want, columns)
