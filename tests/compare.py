"""Rows of a DataFrame against rows of DuckDB SQL over the same files."""

import duckdb

from siltstone.session import TABLES


def same_rows(df, sql: str, sf: str) -> None:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    columns = sorted(names)
    key = lambda rows: sorted(map(repr, rows))
    got = key(tuple(r[c] for c in columns) for r in df.collect())
    at = [names.index(c) for c in columns]
    assert got == key(tuple(r[i] for i in at) for r in want.fetchall())
