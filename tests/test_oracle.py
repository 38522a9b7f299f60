"""Every registered query against its DuckDB SQL (the driver's correctness gate)."""

from __future__ import annotations

import pytest
from conftest import SF_SMALL
from harness import compare, duck

import __spark_entry__ as entry

QUERIES = entry.queries()
ORACLE = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_every_query_is_registered_with_sql_or_documented():
    no_sql = set(QUERIES) - set(ORACLE)
    no_sql -= {*entry.LLM_QUERIES, *entry.PIPELINE_QUERIES}  # tested in tests/llm
    assert not no_sql


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, con, name):
    res = compare(spark, con, name, QUERIES[name], ORACLE[name], SF_SMALL)
    assert res["cols_match"], res
    assert res["spark_rows"] == res["oracle_rows"], res
    assert res["match"], res


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert df.columns == ["first_event_type", "returners_cnt", "users_cnt", "is_two_share"]
    assert len(rows) >= 1
