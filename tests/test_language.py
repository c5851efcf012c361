import pytest

from glintflow.plans import language, planner
from glintflow.plans.engine import Engine
from glintflow.plans.language import QueryError, parse

VALID = [
    "SELECT * FROM diagnostics", "select count(*) from files", "SELECT path, message FROM diagnostics WHERE severity = error", "SELECT * FROM symbols WHERE severity = 'error' AND line > 10 ORDER BY line DESC LIMIT 10",
    "SELECT path, COUNT(*) AS n FROM diagnostics WHERE NOT (code IN ('a', 'b') OR line <> 3) GROUP BY path ORDER BY n DESC LIMIT 10", "SELECT file FROM history LAST 24 HOURS", "SELECT file FROM history WHERE errors IS NOT NULL AND since '2024-01-01'",
]
INVALID = ["", "   ", "SELECT", "SELECT * FROM", "SELECT * FROM nowhere", "* FROM diagnostics", "SELECT * FROM diagnostics WHERE", "SELECT * FROM diagnostics LIMIT x", "SELECT * FROM diagnostics LIMIT 5 extra", "SELECT * FROM diagnostics WHERE a ~ 1", "SELECT SUM(*) FROM files", "SELECT * FROM diagnostics ORDER file", "SELECT * FROM diagnostics WHERE (line > 1", "x" * 10_001]


@pytest.mark.parametrize("text", VALID)
def test_valid(text):
    assert parse(text).source in language.SOURCES


@pytest.mark.parametrize("text", INVALID)
def test_invalid(text):
    with pytest.raises(QueryError):
        parse(text)


def test_hint_of_a_misspelt_source():
    with pytest.raises(QueryError, match="diagnostics"):
        parse("SELECT * FROM diagnostcs")


def test_tree():
    q = parse("SELECT path, COUNT(*) FROM diagnostics WHERE a = 1 OR b = 2 AND NOT c = 3 GROUP BY path ORDER BY count DESC, path LIMIT 7")
    assert q.where.op == "or" and q.where.parts[1].op == "and" and q.where.parts[1].parts[1].op == "not"
    assert q.order == (("count", True), ("path", False)) and q.limit == 7 and q.items[1].output == "count"


@pytest.mark.parametrize(
    "text",
    ["SELECT * FROM diagnostics LIMIT 10001", "SELECT * FROM diagnostics LIMIT 0", "SELECT * FROM diagnostics GROUP BY file", "SELECT line, COUNT(*) FROM diagnostics GROUP BY file", "SELECT * FROM diagnostics WHERE nothing = 1", "SELECT * FROM diagnostics WHERE severity = fatal", "SELECT SUM(message) FROM diagnostics", "SELECT file FROM diagnostics ORDER BY nothing", "SELECT * FROM diagnostics WHERE line = 'x'", "SELECT file FROM history LAST 2 DAYS"],
)
def test_refused(spark, tiny, text):
    with pytest.raises(QueryError):
        Engine(spark, tiny).execute(text)


def test_strict(spark, tiny):
    e = Engine(spark, tiny)
    with pytest.raises(QueryError):
        e.execute("SELECT file, COUNT(*) FROM diagnostics GROUP BY file", strict=True)
    with pytest.raises(QueryError):
        e.execute("SELECT file FROM diagnostics WHERE severity = error AND severity = hint", strict=True)


def test_memo_cost_hints_and_explain(spark, tiny):
    e = Engine(spark, tiny)
    assert e.execute(VALID[0]) is e.execute(VALID[0]) and (e.memo.hits, e.memo.misses) == (1, 1)
    q = parse(VALID[4])
    assert planner.cost(q) == (10 + 5 * 2 + 20 + 25 + 30, "medium")
    assert planner.hints(parse("SELECT * FROM symbols"))
    assert planner.pattern_key(parse("SELECT file FROM diagnostics WHERE line > 1")) == planner.pattern_key(parse("SELECT file FROM diagnostics WHERE line > 2"))
    text = e.explain("SELECT file FROM diagnostics WHERE line > 600 LIMIT 3")
    assert "PushedFilters" in text and "GreaterThan(start_line,600)" in text and "ReadSchema: struct<file:string,start_line:int>" in text


def test_memo_forgets():
    m = planner.Memo(entries=2)
    qs = [parse(f"SELECT * FROM diagnostics LIMIT {i}") for i in (1, 2, 3)]
    for q in qs:
        m.get(q, "v", lambda q: q)
    m.get(qs[0], "v", lambda q: q)
    assert m.misses == 4 and len(m.kept) == 2


def test_another_source(spark, tiny):
    e = Engine(spark, tiny)
    e.register("files", lambda: spark.createDataFrame([("a", 1)], "file string, total bigint"))
    assert [tuple(r) for r in e.execute("SELECT file, total FROM files").collect()] == [("a", 1)]


def test_a_source_before_a_field(spark, tiny):
    from glintflow.plans.engine import Engine

    e = Engine(spark, tiny)
    one = e.execute("SELECT file, total FROM files WHERE errors > 0 ORDER BY file LIMIT 20").collect()
    two = e.execute("SELECT files.file, files.total FROM files WHERE files.errors > 0 ORDER BY files.file LIMIT 20").collect()
    assert [tuple(r) for r in one] == [tuple(r) for r in two] and one
