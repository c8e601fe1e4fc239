"""Every registered query against its SQL, at the smallest scale."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
from tests.check_oracle import difference, sql_rows

QUERIES, ORACLES = contract.queries(), contract.oracle_sql()


def test_every_sql_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(n for n in ORACLES if not n.startswith("op")))
def test_query_equals_sql(spark, small, name):
    rows = QUERIES[name](spark, small).toPandas()
    assert len(rows) > 0
    assert difference(rows, sql_rows(small, ORACLES[name])) is None


# tested in tests/llm, and the full search in test_model on few steps
ELSEWHERE = {n for n in QUERIES if n.startswith("op") or n == "pipeline"} | {"tuning_trials"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - ELSEWHERE))
def test_query_runs(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_stream_replies_equal_batch_replies(spark, small):
    order = ["request_id", "part"]
    streamed = QUERIES["stream_match"](spark, small).orderBy(order).collect()
    assert streamed == QUERIES["reply_by_model"](spark, small).orderBy(order).collect()


def test_entry_has_rows(spark):
    assert contract.entry(spark).count() > 0
