"""Every query against its DuckDB SQL on the smallest tables."""

import math

import duckdb
import pytest

from offerloom.plans import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return str(value.replace(tzinfo=None)) if hasattr(value, "tzinfo") else value


def ordered(columns, rows):
    names = sorted(columns)
    at = [columns.index(c) for c in names]
    return names, sorted((tuple(plain(r[i]) for i in at) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, FOLDER)
    got = ordered(df.columns, df.collect())
    if name in catalog.oracle_sql():
        want = duck.sql(catalog.oracle_sql()[name])
        assert got == ordered(want.columns, want.fetchall())
