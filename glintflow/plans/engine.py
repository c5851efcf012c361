"""The engine: views over the tables, queries in the language, results in several formats."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glintflow.functions.text import is_reference, is_symbol, project_of, quoted_name, reference_type, symbol_type
from glintflow.plans.language import parse
from glintflow.plans.planner import Memo, explained, planned, strict_check
from glintflow.schema import diagnostics_of
from glintflow.sources.tables import table


def files_view(diagnostics: DataFrame) -> DataFrame:
    """Counts by severity for each file."""
    n = lambda s: F.count_if(F.col("severity") == s)
    return diagnostics.groupBy("file").agg(n("Error").alias("errors"), n("Warning").alias("warnings"), n("Information").alias("infos"), n("Hint").alias("hints"), F.count(F.lit(1)).alias("total"))


def symbols_view(diagnostics: DataFrame) -> DataFrame:
    m, c = F.col("message"), F.col("code")
    return diagnostics.where(is_symbol(m, c)).select("file", symbol_type(m, c).alias("symbol_type"), quoted_name(m, F.coalesce(c, F.lit("unknown"))).alias("symbol_name"), "line", "severity", "message")


def references_view(diagnostics: DataFrame) -> DataFrame:
    m = F.col("message")
    return diagnostics.where(is_reference(m)).select("file", reference_type(m).alias("reference_type"), quoted_name(m, F.lit("unknown")).alias("reference_name"), "line", "severity", "message")


def projects_view(diagnostics: DataFrame) -> DataFrame:
    """Per project: files, diagnostics and errors. Per file first, so that the count of files needs no distinct set."""
    files = diagnostics.groupBy(project_of(F.col("file")).alias("project"), "file").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("severity") == "Error").alias("e"))
    return files.groupBy("project").agg(F.count("file").alias("file_count"), F.sum("n").alias("diagnostic_count"), F.sum("e").alias("error_count"))


def history_view(snapshots: DataFrame) -> DataFrame:
    return snapshots.select("timestamp", F.col("file_path").alias("file"), F.col("error_count").alias("errors"), F.col("warning_count").alias("warnings"), "info_count", "hint_count", "file_hash")


class Engine:
    """Answers queries over a folder of tables."""

    def __init__(self, spark: SparkSession, folder: str, now: str | None = None, compat: bool = False) -> None:
        self.now, self.compat, self.memo, self.version, self._spark = now, compat, Memo(), folder, spark
        self.diagnostics = diagnostics_of(table(spark, folder, "sample_diagnostics"))
        self._builders: dict[str, Callable[[], DataFrame]] = {
            "diagnostics": lambda: self.diagnostics,
            "files": lambda: files_view(self.diagnostics),
            "symbols": lambda: symbols_view(self.diagnostics),
            "references": lambda: references_view(self.diagnostics),
            "projects": lambda: projects_view(self.diagnostics),
            "history": lambda: history_view(table(spark, folder, "diagnostic_snapshots")),
            "trends": lambda: self._trends(table(spark, folder, "diagnostic_snapshots")),
        }

    @staticmethod
    def _trends(snapshots: DataFrame) -> DataFrame:
        from glintflow.operators.history import trend_metrics

        return trend_metrics(snapshots)

    def register(self, name: str, build: Callable[[], DataFrame]) -> None:
        """Another source for queries, or another builder of one."""
        self._builders[name] = build

    def view(self, name: str) -> DataFrame:
        return self._builders[name]()

    def refresh(self) -> None:
        """Reads the tables' files anew and forgets what was planned over the old ones."""
        self.__init__(self._spark, self.version, self.now, self.compat)

    def execute(self, text: str, strict: bool = False) -> DataFrame:
        q = parse(text)
        if strict:
            strict_check(q)
        return self.memo.get(q, f"{self.version}|{self.now}|{self.compat}", lambda q: planned(q, {q.source: self.view(q.source)}, self.now, self.compat))

    def explain(self, text: str) -> str:
        q = parse(text)
        return explained(q, {q.source: self.view(q.source)}, self.now)
