"""Every query beside its SQL, over the smallest tables."""

import datetime
import math

import duckdb
import pytest

from gridquarry.plans import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP", "array<string>": "VARCHAR[]", "array<double>": "DOUBLE[]"}


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    if isinstance(v, list):
        return tuple(map(plain, v))
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


def rows(found):
    return sorted((tuple(map(plain, r)) for r in found), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = rows(df.select(columns).collect())
    assert got or name == "f14_tracked_maximum"
    if name in SQL:
        found = con.sql(SQL[name])
        assert sorted(found.columns) == columns
        kinds = dict(zip(found.columns, map(str, found.types), strict=True))
        assert {c: KINDS[t] for c, t in df.dtypes} == kinds
        assert got == rows(con.sql(f"SELECT {', '.join(f'\"{c}\"' for c in columns)} FROM ({SQL[name]})").fetchall())
