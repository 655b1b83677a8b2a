"""Registered core queries against DuckDB on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from contrail.plans import queries as plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def plain(x):
    if not isinstance(x, (list, tuple, dict)) and not hasattr(x, "__len__") and pd.isna(x):
        return None
    number = isinstance(x, (int, float)) and not isinstance(x, bool) or hasattr(x, "dtype") and x.dtype.kind in "iuf" and x.ndim == 0
    return round(float(x), 6) if number else str(x)


def rows(df):
    return sorted((tuple(map(plain, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query(spark, sf, con, name):
    assert rows(plans.QUERIES[name](spark, sf).toPandas()) == rows(con.sql(plans.SQL[name]).df())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
