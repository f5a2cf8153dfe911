"""Every registered query of the catalog part against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from concordat import queries_catalog, queries_files, queries_linkage, queries_sources, registry  # noqa: F401

from .conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def normal(df):
    def one(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
            return "null"
        return f"{v:.9g}" if isinstance(v, float) else str(v)

    return sorted(tuple(map(one, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    if name not in registry.SQL:
        assert len(got.columns) > 0
        return
    expected = duck.sql(registry.SQL[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert normal(got) == normal(expected)
