"""Each query of the library against its SQL, value by value."""

import math
import os

import duckdb
import pytest

from memlake import registry

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return v


def rows(columns, values):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return [columns[k] for k in order], sorted([tuple(plain(v[k]) for k in order) for v in values], key=repr)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_matches_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, FOLDER)
    want = duck.execute(registry.SQL[name])
    columns = [c[0] for c in want.description]
    expected = rows(columns, want.fetchall())
    made = rows(got.columns, [tuple(r) for r in got.collect()])
    assert made[0] == expected[0]
    assert len(made[1]) == len(expected[1])
    assert made[1] == expected[1]


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, FOLDER).count() > 0
