"""All queries of the core, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glintflow.queries import analysis, language, quality, reports

QUERIES = {**quality.QUERIES, **language.QUERIES, **analysis.QUERIES, **reports.QUERIES}
SQL = {**quality.SQL, **language.SQL, **analysis.SQL, **reports.SQL}


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Errors and warnings by severity and source, through the language."""
    from glintflow.plans.engine import Engine

    return Engine(spark, d, language.NOW).execute("SELECT severity, source, COUNT(*) AS n FROM diagnostics WHERE severity <= warning GROUP BY severity, source ORDER BY n DESC, source LIMIT 100")
