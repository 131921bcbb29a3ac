"""Compares a query with its SQL in DuckDB: columns by name, rows as a bag."""

from pathlib import Path

import duckdb


def duck(sf_dir):
    con = duckdb.connect()
    con.execute("set threads to 4")
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


def plain(v):
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


def both(df, sql, con):
    columns = sorted(df.columns)
    key = lambda row: tuple(str(v) for v in row)
    names = ", ".join(f'"{c}"' for c in columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=key)
    want = sorted((tuple(map(plain, r)) for r in con.execute(f"select {names} from ({sql})").fetchall()), key=key)
    return got, want
