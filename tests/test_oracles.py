"""Every registered query against its SQL on the smallest tables."""

import datetime
import decimal
import math

import duckdb
import pytest

from tallyloom.plans import registry
from tallyloom.session import TABLES

DIR = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([columns[i] for i in order]), sorted(([plain(r[i]) for i in order] for r in found), key=repr)


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_matches_sql(spark, duck, name):
    df = registry.queries()[name](spark, DIR)
    got = df.collect()
    if name in registry.oracle_sql():
        want = duck.execute(registry.oracle_sql()[name])
        columns = [d[0] for d in want.description]
        assert rows(df.columns, got) == rows(columns, want.fetchall())
        assert got or name.startswith("k"), "an empty result tests nothing"
    else:
        assert got
