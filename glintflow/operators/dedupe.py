"""First and best rows of a key, and the grouping of related diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MESSAGE_KEY = 100  # fixed value: characters of a message that tell duplicates apart


def first_of(rows: DataFrame, keys: list, order: list) -> DataFrame:
    """The first row of each key by order, by an aggregation: no key is ever sorted in one task."""
    r = rows.withColumn("_k", F.struct(*(k.alias(f"k{i}") for i, k in enumerate(keys))))
    return r.groupBy("_k").agg(F.min_by(F.struct(*(F.col(f"`{c}`") for c in rows.columns)), F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)))).alias("_r")).select("_r.*")


def deduplicated(diagnostics: DataFrame, length: int | None = MESSAGE_KEY) -> DataFrame:
    """The first diagnostic of each file, position, severity and first ``length`` characters of the message; None takes whole messages."""
    text = F.col("message") if length is None else F.substring(F.col("message"), 1, length)
    keys = [F.col("file"), F.col("line"), F.col("column"), F.col("severity"), text]
    return first_of(diagnostics, keys, [F.col("id")])


def worst_per_file(diagnostics: DataFrame, n: int) -> DataFrame:
    """The ``n`` worst diagnostics of each file, by arrival within a severity."""
    w = Window.partitionBy("file").orderBy("severity_rank", "id")
    return diagnostics.withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= n).drop("_i")  # Spark limits each group before the shuffle


# name, confidence: fixed values
CONFIDENCE = {"same_symbol": 0.8, "cascading_type_errors": 0.7, "import_errors": 0.9, "undefined_variable_errors": 0.95, "same_line_range": 0.6, "initialization_errors": 0.85, "borrow_checker_cascade": 0.75}
GROUP_SCHEMA = "file string, primary_id string, severity string, line bigint, related array<string>, confidence double"


class _Facts:
    """What the matchers ask of a diagnostic, worked out once."""

    __slots__ = ("id", "line", "column", "severity", "rank", "symbols", "says", "rust")

    def __init__(self, row) -> None:
        import re

        message = row.message or ""
        self.id, self.line, self.column, self.severity, self.rank = row.id, row.line, row.column, row.severity, row.severity_rank
        self.symbols = set(re.findall(r"'([a-zA-Z_][a-zA-Z0-9_]*)'", message)) | set(re.findall(r"`([a-zA-Z_][a-zA-Z0-9_]*)`", message))
        # fixed values: the cue words of the rules
        self.says = {w for w in ("type", "Type", "import", "module", "Cannot find", "undefined", "undeclared", "Cannot find value", "initialized", "assigned", "used", "initializer", "before", "borrow", "moved", "lifetime") if w in message}
        self.rust = "rust" in (row.source or "")


def _match(a: _Facts, b: _Facts) -> str | None:
    """The first rule by which b belongs to a; the order matters and some rules are not symmetric."""
    common = not a.symbols.isdisjoint(b.symbols)
    both = lambda w: w in a.says and w in b.says
    unknown = {"undefined", "undeclared", "Cannot find value"}
    if common:
        return "same_symbol"
    if a.severity == b.severity == "Error" and a.says & {"type", "Type"} and b.says & {"type", "Type"}:
        return "cascading_type_errors"
    if both("import") or both("module") or both("Cannot find") and common:
        return "import_errors"
    if a.says & unknown and b.says & unknown and common:
        return "undefined_variable_errors"
    if a.line == b.line and abs(a.column - b.column) < 10:
        return "same_line_range"
    if ("initialized" in a.says and "assigned" in b.says) or ("assigned" in a.says and "used" in b.says) or ("initializer" in a.says and "before" in b.says):
        return "initialization_errors"
    if a.rust and (both("borrow") or both("moved") or both("lifetime")):
        return "borrow_checker_cascade"
    return None


# cue of a primary: cues of those that belong to it
_LEADS = {"import": ("import",), "module": ("module",), "initialized": ("assigned",), "assigned": ("used",), "initializer": ("before",), "borrow": ("borrow",), "moved": ("moved",), "lifetime": ("lifetime",)}


def _keys(f: _Facts) -> set:
    """What others find a diagnostic by: its symbols, cues, line, and whether it is an error about types."""
    return {("symbol", s) for s in f.symbols} | {("cue", c) for c in f.says} | {("line", f.line)} | ({("types",)} if f.severity == "Error" and f.says & {"type", "Type"} else set())


def _fold(rows: list) -> list[tuple]:
    """The groups of one file's rows, which come in order of line, severity and arrival.

    Whatever a primary can match has a symbol, a line or a cue that it asks for, so it looks only at those that are still free under
    these keys. Nearly all of them match and are taken, so each is looked at a few times and the fold is about linear in the file.
    """
    facts = [_Facts(r) for r in rows]
    found_by: dict = {}
    for j, f in enumerate(facts):
        for k in _keys(f):
            found_by.setdefault(k, {})[j] = None
    taken: set[str] = set()

    def take(j: int) -> None:
        taken.add(facts[j].id)
        for k in _keys(facts[j]):
            found_by[k].pop(j, None)

    out = []
    for i, a in enumerate(facts):
        if a.id in taken:
            found_by_i = _keys(a)
            for k in found_by_i:
                found_by[k].pop(i, None)
            continue
        take(i)
        asked = {k for k in _keys(a) if k[0] != "cue"} | {("cue", c) for lead, cues in _LEADS.items() if lead in a.says for c in cues}
        related, sure = [], 1.0
        for j in sorted({j for k in asked for j in found_by.get(k, ())}):
            b = facts[j]
            if b.id in taken or (rule := _match(a, b)) is None:
                continue
            related.append(b.id)
            take(j)
            sure = min(sure, CONFIDENCE[rule])
        out.append((rows[0].file, a.id, a.severity, a.line, related, sure))
    return out


def grouped(diagnostics: DataFrame) -> DataFrame:
    """Groups of related diagnostics: greedy in order of line, severity and arrival, one file at a time.

    The rule is a sequential fold and all rules ask for the same file. Rows are spread by file and sorted, and each partition is read as a
    stream in which the files follow one another: a call a batch instead of one a file. One file's diagnostics must fit a task (some 500 bytes
    each in Python, so a million of them half a GB), since which of them are still free depends on all groups before.
    """
    from collections.abc import Iterator

    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list = []
        columns = ["file", "primary_id", "severity", "line", "related", "confidence"]
        for pdf in batches:
            out: list[tuple] = []
            for r in pdf.itertuples(index=False):
                if held and held[0].file != r.file:
                    out += _fold(held)
                    held = []
                held.append(r)
            yield pd.DataFrame(out, columns=columns)
        if held:
            yield pd.DataFrame(_fold(held), columns=columns)

    rows = diagnostics.where("file IS NOT NULL AND id IS NOT NULL").select("id", "file", "line", "column", "severity", "severity_rank", "message", "source")
    return rows.repartition("file").sortWithinPartitions("file", "line", "severity_rank", "id").mapInPandas(run, GROUP_SCHEMA)


def group_summary(groups: DataFrame) -> DataFrame:
    """Groups, diagnostics, primary errors, cascading diagnostics and mean size."""
    size = F.size("related")
    out = groups.agg(F.count(F.lit(1)).alias("total_groups"), F.coalesce(F.sum(size + 1), F.lit(0)).alias("total_diagnostics"), F.count_if(F.col("severity") == "Error").alias("primary_errors"), F.coalesce(F.sum(size), F.lit(0)).alias("cascading_errors"))
    return out.withColumn("average_group_size", F.coalesce(F.try_divide(F.col("total_diagnostics"), F.col("total_groups")), F.lit(0.0)))
