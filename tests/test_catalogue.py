"""Every registered query against its DuckDB oracle on the smallest tables."""

import math
import os

import duckdb
import pytest

from rulewright.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLES = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    return ("nan" if math.isnan(v) else round(v, 6) + 0.0) if isinstance(v, float) else v


def test_every_query_has_an_oracle():
    assert sorted(set(QUERIES) - set(ORACLES)) == []


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows, columns = df.collect(), sorted(df.columns)
    want = duck.sql(ORACLES[name])
    assert sorted(want.columns) == columns
    place = [want.columns.index(c) for c in columns]
    assert sorted((tuple(plain(r[c]) for c in columns) for r in rows), key=str) == sorted((tuple(plain(r[i]) for i in place) for r in want.fetchall()), key=str)
