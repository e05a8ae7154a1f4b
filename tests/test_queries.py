"""Every registered query of the engine against its oracle; those without one must run."""

from __future__ import annotations

import pytest

from tessera.plans import registry
from tests.oracle import differences

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tiny, name):
    df = QUERIES[name](spark, tiny)
    if name in ORACLES:
        assert differences(df, tiny, ORACLES[name]) == []
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
