"""The diagnostic row and its severities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: 1 is worst
SEVERITY_RANK = {"Error": 1, "Warning": 2, "Information": 3, "Hint": 4}
SEVERITY_ALIASES = {"error": "Error", "warning": "Warning", "warn": "Warning", "information": "Information", "info": "Information", "hint": "Hint"}


def by_value(column: Column, values: dict, default=None) -> Column:
    """A lookup in a small fixed table, as one CASE."""
    out = None
    for k, v in values.items():
        out = F.when(column == k, F.lit(v)) if out is None else out.when(column == k, F.lit(v))
    return out.otherwise(F.lit(default))


def severity_rank(severity: Column) -> Column:
    """1 (worst) to 4; null for unknown names."""
    return by_value(severity, SEVERITY_RANK)


def diagnostics_of(rows: DataFrame) -> DataFrame:
    """The diagnostics view over flattened rows: positions as bigint, the rank, ``path`` beside ``file``."""
    return rows.select(
        "id", "file", F.col("file").alias("path"), F.col("start_line").cast("bigint").alias("line"), F.col("start_character").cast("bigint").alias("column"),
        F.col("end_line").cast("bigint").alias("end_line"), F.col("end_character").cast("bigint").alias("end_column"),
        "severity", severity_rank(F.col("severity")).alias("severity_rank"), F.coalesce("code", F.lit("")).alias("category"), "message", "code", "source", "tags", "data",
    )
