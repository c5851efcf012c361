"""Every core query with SQL gives what DuckDB gives."""

import oracle
import pytest

from glintflow.queries import core


@pytest.mark.parametrize("name", sorted(core.SQL))
def test_same_as_sql(spark, tiny, name):
    assert oracle.difference(spark, tiny, core.QUERIES[name], core.SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - set(core.SQL)))
def test_runs(spark, tiny, name):
    assert core.QUERIES[name](spark, tiny).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
