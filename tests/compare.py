"""Side-by-side comparison of a registered query with its DuckDB SQL."""

from __future__ import annotations

import datetime
import decimal

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Largest difference of two numbers that agree, relative to the larger of 1 and the number.
TOLERANCE = 2e-6


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(column: pd.Series) -> pd.Series:
    """Numbers, truth values and instants (in seconds) as floats, all else as text; null is NaN or None."""
    if pd.api.types.is_datetime64_any_dtype(column):
        column = column.dt.tz_convert("UTC").dt.tz_localize(None) if column.dt.tz else column
        return pd.Series(np.where(column.isna(), np.nan, column.astype("datetime64[us]").astype("int64") / 1e6), dtype="float64")
    known = column.dropna()
    if pd.api.types.is_numeric_dtype(column) or len(known) and isinstance(known.iloc[0], (bool, np.bool_, int, float, decimal.Decimal)):
        return column.astype("float64")
    if len(known) and isinstance(known.iloc[0], (datetime.date, datetime.datetime)):
        return plain(pd.to_datetime(column))
    return column.map(lambda x: None if x is None or x is pd.NaT or isinstance(x, float) and np.isnan(x) else str(x)).astype(object)


def table(data: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({n: plain(data[n].reset_index(drop=True)) for n in sorted(data.columns)})


def in_order(df: pd.DataFrame) -> pd.DataFrame:
    """Rows in an order that a number's last digits don't change."""
    keys = pd.DataFrame({c: df[c].round(4) if df[c].dtype == float else df[c].fillna("\0") for c in df})
    keys = keys.assign(**{f"\1{c}": df[c] for c in df if df[c].dtype == float})
    return df.loc[keys.sort_values(list(keys.columns), kind="stable").index].reset_index(drop=True)


def compare(spark, con, query, sql: str, sf_dir: str) -> str:
    """Empty when rows agree; else what differs."""
    got, want = query(spark, sf_dir).toArrow().to_pandas(date_as_object=False), con.execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} against {sorted(want.columns)}"
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}"
    a, b = in_order(table(got)), in_order(table(want))
    bad = np.zeros(len(a), bool)
    for c in a:
        if a[c].isna().all() and b[c].isna().all():
            continue
        if a[c].dtype == float and b[c].dtype == float:
            x, y = a[c].to_numpy(), b[c].to_numpy()
            with np.errstate(invalid="ignore"):
                bad |= (np.isnan(x) != np.isnan(y)) | (np.abs(x - y) > TOLERANCE * np.maximum(1, np.abs(y)))
        else:
            bad |= (a[c].fillna("\0") != b[c].fillna("\0")).to_numpy()
    if not bad.any():
        return ""
    k = int(np.flatnonzero(bad)[0])
    return f"{int(bad.sum())} rows differ, first {a.iloc[k].to_dict()} against {b.iloc[k].to_dict()}"
