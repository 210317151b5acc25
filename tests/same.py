"""Rows of a query against rows of its SQL in DuckDB."""

import os

import duckdb


def tables(d: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in os.listdir(d):
        c.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{d}/{t}'")
    return c


def rows_of(df) -> list:
    names = sorted(df.columns)
    return _sorted([tuple(_plain(r[n]) for n in names) for r in df.select(*names).collect()])


def rows_of_sql(sql: str, d: str, names: list) -> list:
    r = tables(d).execute(sql)
    have = [x[0] for x in r.description]
    assert sorted(have) == sorted(names)
    at = [have.index(n) for n in sorted(names)]
    return _sorted([tuple(_plain(x[i]) for i in at) for x in r.fetchall()])


def _plain(v):
    return round(v, 6) if isinstance(v, float) else v


def _sorted(rows: list) -> list:
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))
