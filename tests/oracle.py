"""Order-insensitive comparison of a Spark result with DuckDB SQL."""

from __future__ import annotations

import datetime as dt
import decimal
import math

import duckdb

from kiln.tables import TABLE_NAMES


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLE_NAMES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _canon(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    if isinstance(v, decimal.Decimal):
        return v.normalize()
    if isinstance(v, (list, tuple)):
        return tuple(_canon(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _canon(x)) for k, x in v.items()))
    if isinstance(v, dt.datetime) and v.tzinfo is not None:
        return v.replace(tzinfo=None)
    return v


def rows(table) -> tuple[list[str], list[tuple]]:
    cols = sorted(table.column_names)
    data = table.select(cols).to_pylist()
    return cols, sorted((tuple(_canon(r[c]) for c in cols) for r in data), key=repr)


def assert_same(spark_df, con, sql: str) -> int:
    st = spark_df.toArrow()
    dtab = con.sql(sql).to_arrow_table()
    sc, sr = rows(st)
    dc, dr = rows(dtab)
    assert sc == dc, f"columns differ: {sc} vs {dc}"
    assert len(sr) == len(dr), f"row counts differ: {len(sr)} vs {len(dr)}"
    diff = [(a, b) for a, b in zip(sr, dr) if a != b][:3]
    assert not diff, f"values differ, e.g. {diff}"
    return len(sr)
