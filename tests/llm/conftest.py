import os

import duckdb
import pytest


@pytest.fixture(scope="session")
def llm_dir(tmp_path_factory):
    """Small tables with the columns of the driver's, in the same file layout."""
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def same_rows(spark, llm_dir):
    """Asserts that a query and its SQL return the same rows."""

    def check(df, sql, sf_dir=llm_dir, digits=6):
        con = duckdb.connect()
        for name in os.listdir(sf_dir):
            path = f"{sf_dir}/{name}"
            con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
        found = con.execute(sql)
        names = [d[0] for d in found.description]
        assert sorted(names) == sorted(df.columns)
        flat = lambda rows: sorted((tuple(round(v, digits) if isinstance(v, float) else v for v in r) for r in rows), key=repr)
        assert flat(tuple(r[n] for n in names) for r in df.collect()) == flat(found.fetchall())

    return check
