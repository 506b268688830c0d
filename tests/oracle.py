"""Compares a query's rows with those of its SQL in DuckDB."""

import os

import duckdb


def normal(v):
    if isinstance(v, float):
        return None if v != v else round(v, 5) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(normal, v))
    return str(v)[:19] if hasattr(v, "isoformat") else v


def same_rows(df, sql, sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        path = f"{sf_dir}/{name}"
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(map(normal, r)) for r in found.fetchall()), key=repr)
    got = sorted((tuple(normal(r[n]) for n in names) for r in df.collect()), key=repr)
    assert got == want
    return len(got)
