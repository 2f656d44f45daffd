from __future__ import annotations

from datetime import datetime, timedelta, timezone

import duckdb
import numpy as np
import pandas as pd
from pyspark.sql import Row

T0 = datetime(2024, 5, 1, 8, 0, 0, tzinfo=timezone.utc)
RAW = "row_seq long, createdAt timestamp, value string, lat double, lon double, boxId string, boxName string"
LAT, LON = 51.96, 7.62
M_LAT, M_LON = 1 / 111_250, 1 / 68_700  # about a metre


def at(s: float | None) -> datetime | None:
    return None if s is None else T0 + timedelta(seconds=s)


def us(s: float) -> int:
    return int(T0.timestamp()) * 1_000_000 + round(s * 1e6)


def reading(seq, s, value="0", lat=LAT, lon=LON, box="b", name="n"):
    return (seq, at(s), value, lat, lon, box, name)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is None, str(x)) for x in r))


def dicts(df):
    return [r.asDict() if isinstance(r, Row) else r for r in df.collect()]


def views(sf):
    from pathlib import Path

    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for p in Path(sf).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def cell(v) -> str:
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
        return "null"
    return f"{float(v):.6f}" if isinstance(v, float | np.floating) else str(v)


def alike(a: pd.DataFrame, b: pd.DataFrame) -> tuple[list, list]:
    assert sorted(a.columns) == sorted(b.columns)
    for c in a.columns:
        if a[c].dtype != b[c].dtype and pd.api.types.is_numeric_dtype(a[c]) and pd.api.types.is_numeric_dtype(b[c]) and not pd.api.types.is_bool_dtype(a[c]):
            a[c], b[c] = a[c].astype(float), b[c].astype(float)
    return tuple(sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False)) for df in (a, b))
