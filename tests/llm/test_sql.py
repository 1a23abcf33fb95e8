"""The numbered queries against their SQL; those without SQL give a row for each of theirs."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from test_oracle import FOLDER, duck, rows  # noqa: E402, F401

from memlake.llm import queries  # noqa: E402


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_matches_sql(spark, duck, name):  # noqa: F811
    got = queries.QUERIES[name](spark, FOLDER)
    want = duck.execute(queries.SQL[name])
    columns = [c[0] for c in want.description]
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_covers_the_table(spark, duck, name):  # noqa: F811
    want = duck.execute("SELECT COUNT(*) FROM documents").fetchone()[0]
    assert queries.QUERIES[name](spark, FOLDER).select("doc_id").distinct().count() == want
