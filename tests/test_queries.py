"""Each query of the catalogue against its SQL."""

import math
import os
from decimal import Decimal

import duckdb
import pytest

from attrweave.plans import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def database(sf):
    connection = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return connection


def plain(x):
    if isinstance(x, Decimal):
        x = float(x)
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 5)
    return x


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf, database, name):
    df = queries.QUERIES[name](spark, sf)
    rows = sorted(repr([plain(r[c]) for c in sorted(df.columns)]) for r in df.collect())
    if name in queries.ORACLE_SQL:
        result = database.execute(queries.ORACLE_SQL[name])
        names = [d[0] for d in result.description]
        assert sorted(names) == sorted(df.columns)
        want = sorted(repr([plain(r[names.index(c)]) for c in sorted(names)]) for r in result.fetchall())
        assert rows == want
    else:
        assert rows
