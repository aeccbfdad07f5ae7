"""Spark against SQL over the same Parquet tables."""

import os

import duckdb
import pandas as pd


def connection(folder):
    c = duckdb.connect()
    for f in os.listdir(folder):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{folder}/{f}'")
    return c


def _text(v):
    if v is None or (not hasattr(v, "__len__") and pd.isna(v)):
        return "NULL"
    if isinstance(v, float):
        return repr(round(v, 6))
    return pd.Timestamp(v).tz_localize(None).isoformat() if hasattr(v, "isoformat") else str(v)


def canonical(df):
    df = df[sorted(df.columns)]
    return sorted("|".join(map(_text, r)) for r in df.itertuples(index=False))


def check(spark, connection, folder, run, sql):
    got, want = run(spark, folder).toPandas(), connection.sql(sql).to_df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)
