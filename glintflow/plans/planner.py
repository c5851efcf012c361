"""Query trees to DataFrames, their checks, hints, cost and a memo of results.

``compat=True`` gives what a narrower engine answers: OR counts as AND, conditions on other fields than severity and all times are ignored, so is
GROUP BY, and aggregates beside fields are null columns.
"""

from __future__ import annotations

import time
from collections import OrderedDict
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glintflow.plans.language import MAX_LIMIT, SOURCES, Compare, Item, Logic, Period, Query, QueryError, nearest, parse
from glintflow.schema import SEVERITY_ALIASES, SEVERITY_RANK, severity_rank

STAR = {
    "diagnostics": ("file", "line", "column", "severity", "category", "message"),
    "files": ("file", "errors", "warnings", "total"),
    "symbols": ("file", "symbol_type", "symbol_name", "line", "severity", "message"),
    "references": ("file", "reference_type", "reference_name", "line", "severity", "message"),
    "projects": ("project", "file_count", "diagnostic_count", "error_count"),
    "history": ("timestamp", "file", "errors"),
    "trends": ("metric", "value", "trend"),
}  # fixed values
TIMES = {"history": "timestamp"}
BASE_COST = {"diagnostics": 10, "files": 15, "symbols": 50, "references": 100, "projects": 20, "history": 25, "trends": 30}  # fixed values


def resolved(df: DataFrame, name: str) -> str | None:
    """The view's column for a name: any case, ``file`` and ``path`` are one, a source before it (``files.total``) is passed over."""
    known = {c.lower(): c for c in df.columns}
    low = name.lower()
    head, dot, tail = low.partition(".")
    if dot and low not in known and head in SOURCES:
        low = tail
    return known.get(low) or known.get({"file": "path", "path": "file"}.get(low, ""))


def condition(df: DataFrame, tree: object, source: str, now: str | None, compat: bool) -> Column | None:
    if isinstance(tree, Logic):
        parts = [c for c in (condition(df, p, source, now, compat) for p in tree.parts) if c is not None]
        if not parts:
            return None
        if tree.op == "not":
            return ~parts[0]
        out = parts[0]
        for p in parts[1:]:
            out = out | p if tree.op == "or" and not compat else out & p
        return out
    if isinstance(tree, Period):
        column = TIMES.get(source) or resolved(df, "timestamp")
        if compat or column is None or column not in df.columns:
            return None
        if tree.op == "last":
            if now is None:
                raise QueryError("LAST needs the time of the query")
            start = F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {tree.value} {tree.unit}")
            return F.timestamp_seconds(column) >= start
        at = F.lit(tree.value).cast("timestamp")
        return F.timestamp_seconds(column) < at if tree.op == "before" else F.timestamp_seconds(column) >= at if tree.op == "since" else F.timestamp_seconds(column) > at
    return comparison(df, tree, compat)


def comparison(df: DataFrame, c: Compare, compat: bool) -> Column | None:
    name = resolved(df, c.field)
    if name is None:
        if compat:
            return None
        near = nearest(c.field, tuple(df.columns))
        raise QueryError(f"unknown field {c.field!r}" + (f"; is {near!r} meant?" if near else ""))
    if compat and name != "severity":
        return None
    left: Column = F.col(name)
    if c.op == "null":
        return left.isNull()
    if c.op == "like" and not compat:
        return left.like(c.value)
    if name == "severity" and c.op != "in" or name == "severity" and compat:
        known = SEVERITY_ALIASES.get(str(c.value).lower())
        if known is None:
            raise QueryError(f"unknown severity {c.value!r}; one of {', '.join(SEVERITY_RANK)}")
        left, value = severity_rank(left), SEVERITY_RANK[known]
        op = "=" if c.op == "like" else c.op
    elif c.op == "in":
        values = [SEVERITY_ALIASES.get(str(v).lower(), v) for v in c.value] if name == "severity" else list(c.value)
        return left.isin(*values)
    else:
        value, op = c.value, c.op
        if isinstance(value, str) and dict(df.dtypes)[name] != "string":
            raise QueryError(f"{name} is compared with a text")
        if not isinstance(value, str) and value is not None and dict(df.dtypes)[name] == "string":
            value = str(value)
    return {"=": left == value, "!=": left != value, "<": left < value, "<=": left <= value, ">": left > value, ">=": left >= value}[op]


def aggregate(df: DataFrame, item: Item, compat: bool = False) -> Column:
    if item.name == "*":
        return F.count(F.lit(1)).alias(item.output)
    name = resolved(df, item.name)
    if name is None:
        raise QueryError(f"unknown field {item.name!r}")
    col = F.col(name)
    number = col.cast("double") if dict(df.dtypes)[name] in ("int", "bigint", "double", "float") else F.expr(f"try_cast(`{name}` AS double)")
    made = {
        "count": F.count(F.lit(1)) if compat else F.count(col),
        "sum": F.sum(number),
        "avg": F.avg(number),
        "min": F.min(col),
        "max": F.max(col),
    }[item.aggregate]
    return made.alias(item.output)


def planned(query: Query | str, views: dict[str, DataFrame], now: str | None = None, compat: bool = False) -> DataFrame:
    """The DataFrame of a query over the views of its sources."""
    q = parse(query) if isinstance(query, str) else query
    check(q, views, compat)
    df = views[q.source]
    if q.where is not None:
        c = condition(df, q.where, q.source, now, compat)
        df = df if c is None else df.where(c)
    aggregates = [i for i in q.items if i.aggregate]
    if q.items and len(aggregates) == len(q.items) and (not q.group or compat):
        out = df.agg(*(aggregate(df, i, compat) for i in aggregates))
    elif (q.group or aggregates) and not compat:
        keys = [(resolved(df, g), g) for g in q.group]
        grouped = df.groupBy(*(F.col(k) for k, _ in keys)).agg(*(aggregate(df, i) for i in aggregates or [Item("*", "count")]))
        names = {g.lower(): k for k, g in keys}
        picks = [i.output if i.aggregate else F.col(names.get(i.name.lower()) or resolved(grouped, i.name)).alias(i.output) for i in q.items] or grouped.columns
        out = grouped.select(*picks)
    else:
        picks = []
        for i in q.items or [Item(c) for c in STAR[q.source]]:
            name = None if i.aggregate else resolved(df, i.name)
            picks.append(F.col(name).alias(i.output) if name else F.lit(None).cast("string").alias(i.output))
        out = df.select(*picks)
    if q.order:
        keys = []
        for name, down in q.order:
            column = resolved(out, name)
            if column is None:
                raise QueryError(f"ORDER BY {name!r} is no column of the result")
            by = severity_rank(F.col(column)) if column == "severity" else F.col(column)
            keys.append(by.desc_nulls_last() if down else by.asc_nulls_first())
        out = out.orderBy(*keys)
    return out if q.limit is None else out.limit(q.limit)


def check(q: Query, views: dict[str, DataFrame], compat: bool = False) -> None:
    """Refuses queries that can't be meant: limits beyond 10000, unknown or ungrouped fields, sums of texts."""
    if q.source not in views:
        raise QueryError(f"no view for source {q.source!r}")
    if q.limit is not None and not 1 <= q.limit <= MAX_LIMIT:
        raise QueryError(f"LIMIT is 1 to {MAX_LIMIT}")
    df = views[q.source]
    if compat:
        return
    for name in q.group:
        if resolved(df, name) is None:
            near = nearest(name, tuple(df.columns))
            raise QueryError(f"unknown field {name!r}" + (f"; is {near!r} meant?" if near else ""))
    if q.group and not q.items:
        raise QueryError("* can't be selected with GROUP BY")
    if q.group or any(i.aggregate for i in q.items):
        for i in q.items:
            if not i.aggregate and i.name.lower() not in {g.lower() for g in q.group}:
                raise QueryError(f"{i.name!r} is neither grouped nor aggregated")
    for i in q.items:
        if i.aggregate in ("sum", "avg") and (n := resolved(df, i.name)) and dict(df.dtypes)[n] == "string":
            raise QueryError(f"{i.aggregate.upper()} of the text {i.name!r}")


def leaves(tree: object) -> list:
    if tree is None:
        return []
    return [x for p in tree.parts for x in leaves(p)] if isinstance(tree, Logic) else [tree]


def strict_check(q: Query) -> None:
    """What a public interface refuses in addition: several severity filters, GROUP BY without LIMIT."""
    if sum(isinstance(x, Compare) and x.field.lower() == "severity" for x in leaves(q.where)) > 1:
        raise QueryError("one severity filter at most")
    if q.group and q.limit is None:
        raise QueryError("GROUP BY needs LIMIT")


def hints(q: Query) -> list[str]:
    """What could make a query cheaper."""
    out = []
    if q.where is None:
        out.append("add a WHERE condition to read less")
    if q.limit is None:
        out.append("add a LIMIT")
    if not q.items and q.source != "projects":
        out.append("select the fields you need instead of *")
    if q.order and q.limit is None:
        out.append("ORDER BY without LIMIT sorts everything")
    if q.source in ("symbols", "references") and q.where is None:
        out.append(f"{q.source} are derived from every diagnostic")
    return out


def cost(q: Query) -> tuple[int, str]:
    """An additive estimate and its band."""
    n = BASE_COST[q.source] + 5 * len(leaves(q.where)) + 20 * sum(i.aggregate is not None for i in q.items) + 25 * bool(q.order) + 30 * bool(q.group)
    return n, "low" if n <= 49 else "medium" if n <= 149 else "high" if n <= 300 else "very high"


def pattern_key(q: Query) -> str:
    """A key that queries of one shape share, whatever their values."""
    where = ",".join(sorted(f"{x.field.lower()}{x.op}" if isinstance(x, Compare) else x.op for x in leaves(q.where)))
    return f"{q.source}|{','.join(i.output for i in q.items) or '*'}|{where}|{','.join(q.group)}|{','.join(f'{c}{int(d)}' for c, d in q.order)}|{q.limit is not None}"


def explained(q: Query | str, views: dict[str, DataFrame], now: str | None = None) -> str:
    """The tree, the hints, the estimate and Spark's physical plan."""
    q = parse(q) if isinstance(q, str) else q
    df = planned(q, views, now)
    plan = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return "\n".join([repr(replace(q, text="")), *hints(q), f"cost {cost(q)}", plan])


@dataclass
class Memo:
    """Planned queries by tree and version of the data; the oldest goes first, and none outlives its time."""

    seconds: float = 300
    entries: int = 1000

    def __post_init__(self) -> None:
        self.kept: OrderedDict = OrderedDict()
        self.hits = self.misses = 0

    def get(self, q: Query, version: str, make) -> DataFrame:
        key, now = (q, version), time.monotonic()
        held = self.kept.get(key)
        if held and now - held[0] < self.seconds:
            self.hits += 1
            return held[1]
        self.misses += 1
        made = make(q)
        self.kept[key] = (now, made)
        self.kept.move_to_end(key)
        while len(self.kept) > self.entries:
            self.kept.popitem(last=False)
        return made
