import oracle
import pytest

from glintflow.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_as_sql(spark, tiny, name):
    assert oracle.difference(spark, tiny, queries.QUERIES[name], queries.SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_runs(spark, tiny, name):
    assert queries.QUERIES[name](spark, tiny).count() > 0


def test_nothing_else_imports_the_package():
    from pathlib import Path

    root = Path(queries.__file__).parents[1]
    users = [p for p in root.rglob("*.py") if "llm" not in p.relative_to(root).parts and "glintflow.llm" in p.read_text()]
    assert users == []
