"""Operators that SQL can express, against DuckDB; all of them are registered."""

from __future__ import annotations

import pytest

from tessera.llm import queries
from tests.oracle import differences


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(spark, small, name):
    assert differences(queries.queries()[name](spark, small), small, queries.oracle_sql()[name]) == []


def test_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert {n.split("_")[0] for n in queries.queries()} == {f"op{i}" for i in range(1, 11)} and set(queries.queries()) <= names and "pipeline" in names
