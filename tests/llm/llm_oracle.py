"""Runs a query's SQL in DuckDB beside it."""

from pathlib import Path

import duckdb


def duck(sf_dir):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


def agree(df, sql, sf_dir):
    columns = sorted(df.columns)
    key = lambda row: tuple(str(v) for v in row)
    norm = lambda v: v if not isinstance(v, list) else tuple(v)
    got = sorted((tuple(norm(r[c]) for c in columns) for r in df.collect()), key=key)
    names = ", ".join(f'"{c}"' for c in columns)
    want = sorted((tuple(norm(v) for v in r) for r in duck(sf_dir).execute(f"select {names} from ({sql})").fetchall()), key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g == w
    return got
