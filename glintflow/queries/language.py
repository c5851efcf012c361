"""Queries in the language, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glintflow.plans.engine import Engine

NOW = "2024-09-01 00:00:00"

VIEWS = r"""
WITH diagnostics AS (
  SELECT id, file, file AS path, CAST(start_line AS BIGINT) AS line, CAST(start_character AS BIGINT) AS "column", severity,
    CASE severity WHEN 'Error' THEN 1 WHEN 'Warning' THEN 2 WHEN 'Information' THEN 3 WHEN 'Hint' THEN 4 END AS severity_rank,
    coalesce(code, '') AS category, message, code, source FROM sample_diagnostics
), files AS (
  SELECT file, count(*) FILTER (severity = 'Error') AS errors, count(*) FILTER (severity = 'Warning') AS warnings, count(*) FILTER (severity = 'Information') AS infos,
    count(*) FILTER (severity = 'Hint') AS hints, count(*) AS total FROM diagnostics GROUP BY file
), symbols AS (
  SELECT file, CASE WHEN contains(message, 'function') OR contains(code, 'function') THEN 'function' WHEN contains(message, 'class') OR contains(code, 'class') THEN 'class'
      WHEN contains(message, 'struct') OR contains(code, 'struct') THEN 'struct' WHEN contains(message, 'trait') OR contains(code, 'trait') THEN 'trait'
      WHEN contains(message, 'enum') OR contains(code, 'enum') THEN 'enum' WHEN contains(message, 'method') THEN 'method' WHEN contains(message, 'variable') THEN 'variable' ELSE 'unknown' END AS symbol_type,
    CASE WHEN regexp_matches(message, '`[^`]*`') THEN regexp_extract(message, '`([^`]*)`', 1) WHEN regexp_matches(message, '''[^'']*''') THEN regexp_extract(message, '''([^'']*)''', 1) ELSE coalesce(code, 'unknown') END AS symbol_name,
    line, severity, message
  FROM diagnostics WHERE code IS NOT NULL AND (regexp_matches(code, 'function|class|struct|trait|enum|type') OR regexp_matches(message, 'method|variable'))
), refs AS (
  SELECT file, CASE WHEN contains(message, 'import') THEN 'import' WHEN contains(message, 'module') THEN 'module' WHEN contains(message, 'type') THEN 'type' WHEN contains(message, 'function') THEN 'function'
      WHEN contains(message, 'variable') THEN 'variable' ELSE 'undefined' END AS reference_type,
    CASE WHEN regexp_matches(message, '`[^`]*`') THEN regexp_extract(message, '`([^`]*)`', 1) WHEN regexp_matches(message, '''[^'']*''') THEN regexp_extract(message, '''([^'']*)''', 1) ELSE 'unknown' END AS reference_name,
    line, severity, message
  FROM diagnostics WHERE regexp_matches(message, 'undefined|not found|cannot find|unresolved|import|reference')
), projects AS (
  SELECT CASE WHEN regexp_matches(file, 'src/[^/]*/') THEN regexp_extract(file, 'src/([^/]*)/', 1) WHEN regexp_matches(file, '[^/]+/[^/]*$') THEN regexp_extract(file, '([^/]+)/[^/]*$', 1) ELSE 'root' END AS project,
    count(DISTINCT file) AS file_count, count(*) AS diagnostic_count, count(*) FILTER (severity = 'Error') AS error_count FROM diagnostics GROUP BY 1
), history AS (SELECT timestamp, file_path AS file, error_count AS errors, warning_count AS warnings FROM diagnostic_snapshots)
"""

# name: (text, SQL after the views)
TEXTS = {
    "ql_select_all": ("SELECT * FROM diagnostics", 'SELECT file, line, "column", severity, category, message FROM diagnostics'),
    "ql_fields": ("SELECT path, source, line, nothing FROM diagnostics", "SELECT path, source, line, CAST(NULL AS VARCHAR) AS nothing FROM diagnostics"),
    "ql_count": ("SELECT COUNT(*) FROM diagnostics", "SELECT count(*) AS count FROM diagnostics"),
    "ql_count_where_none": ("SELECT COUNT(*) FROM diagnostics WHERE line < 0", "SELECT count(*) AS count FROM diagnostics WHERE line < 0"),
    "ql_severity_worse": ("SELECT file, severity FROM diagnostics WHERE severity <= 'warning'", "SELECT file, severity FROM diagnostics WHERE severity_rank <= 2"),
    "ql_severity_greater": ("SELECT file, severity FROM diagnostics WHERE severity > 'warning'", "SELECT file, severity FROM diagnostics WHERE severity_rank > 2"),
    "ql_and_or_not": (
        "SELECT file, line, category FROM diagnostics WHERE (severity = error OR category = 'TS2304') AND NOT line BETWEEN 100 AND 600 AND code IS NOT NULL",
        "SELECT file, line, category FROM diagnostics WHERE (severity = 'Error' OR category = 'TS2304') AND NOT (line BETWEEN 100 AND 600) AND code IS NOT NULL",
    ),
    "ql_like_in": (
        "SELECT file, message FROM diagnostics WHERE file LIKE '%.rs' AND source IN ('rustc', 'clippy') AND message NOT LIKE '%moved%'",
        "SELECT file, message FROM diagnostics WHERE file LIKE '%.rs' AND source IN ('rustc', 'clippy') AND message NOT LIKE '%moved%'",
    ),
    "ql_group": (
        "SELECT severity, source, COUNT(*) AS n, AVG(line), MIN(line), MAX(line), SUM(column) FROM diagnostics GROUP BY severity, source",
        'SELECT severity, source, count(*) AS n, avg(line) AS avg_line, min(line) AS min_line, max(line) AS max_line, CAST(sum("column") AS DOUBLE) AS sum_column FROM diagnostics GROUP BY ALL',
    ),
    "ql_count_field": ("SELECT COUNT(code), COUNT(source) FROM diagnostics", "SELECT count(code) AS count_code, count(source) AS count_source FROM diagnostics"),
    "ql_order_limit": (
        "SELECT file, line, column FROM diagnostics WHERE severity = error ORDER BY line DESC, file, column LIMIT 25",
        "SELECT file, line, \"column\" FROM diagnostics WHERE severity = 'Error' ORDER BY line DESC NULLS LAST, file NULLS FIRST, \"column\" NULLS FIRST LIMIT 25",
    ),
    "ql_order_nulls": (
        "SELECT source, COUNT(*) AS n FROM diagnostics GROUP BY source ORDER BY source LIMIT 5",
        "SELECT source, count(*) AS n FROM diagnostics GROUP BY source ORDER BY source NULLS FIRST LIMIT 5",
    ),
    "ql_files": ("SELECT * FROM files WHERE errors > 0 AND file LIKE '%src/%'", "SELECT file, errors, warnings, total FROM files WHERE errors > 0 AND file LIKE '%src/%'"),
    "ql_files_having": ("SELECT path, total FROM files WHERE total >= 2 ORDER BY total DESC, path LIMIT 40", "SELECT file AS path, total FROM files WHERE total >= 2 ORDER BY total DESC, path LIMIT 40"),
    "ql_symbols": ("SELECT * FROM symbols", "SELECT file, symbol_type, symbol_name, line, severity, message FROM symbols"),
    "ql_symbols_count": ("SELECT symbol_type, COUNT(*) FROM symbols GROUP BY symbol_type", "SELECT symbol_type, count(*) AS count FROM symbols GROUP BY 1"),
    "ql_references": ("SELECT * FROM references", "SELECT file, reference_type, reference_name, line, severity, message FROM refs"),
    "ql_references_count": ("SELECT reference_type, COUNT(*) FROM references WHERE severity = error GROUP BY reference_type", "SELECT reference_type, count(*) AS count FROM refs WHERE severity = 'Error' GROUP BY 1"),
    "ql_projects": ("SELECT * FROM projects", "SELECT project, file_count, diagnostic_count, error_count FROM projects"),
    "ql_projects_sum": (
        "SELECT COUNT(*), SUM(diagnostic_count), SUM(error_count), SUM(file_count) FROM projects",
        "SELECT count(*) AS count, CAST(sum(diagnostic_count) AS DOUBLE) AS sum_diagnostic_count, CAST(sum(error_count) AS DOUBLE) AS sum_error_count, CAST(sum(file_count) AS DOUBLE) AS sum_file_count FROM projects",
    ),
    "ql_history": ("SELECT * FROM history WHERE errors > 2", "SELECT timestamp, file, errors FROM history WHERE errors > 2"),
    "ql_history_last": (
        "SELECT timestamp, file, errors, warnings FROM history LAST 30 DAYS",
        f"SELECT timestamp, file, errors, warnings FROM history WHERE timestamp >= epoch(TIMESTAMP '{NOW}') - 30 * 86400",
    ),
    "ql_history_between": (
        "SELECT file, COUNT(*), SUM(errors) FROM history WHERE since '2024-06-01 00:00:00' AND before '2024-09-01 00:00:00' GROUP BY file",
        "SELECT file, count(*) AS count, CAST(sum(errors) AS DOUBLE) AS sum_errors FROM history WHERE timestamp >= epoch(TIMESTAMP '2024-06-01') AND timestamp < epoch(TIMESTAMP '2024-09-01') GROUP BY 1",
    ),
    "ql_trends": (
        "SELECT * FROM trends",
        """, b AS (SELECT timestamp // 86400 * 86400 AS bucket, sum(error_count) AS e, sum(error_count) / count(*) AS a FROM diagnostic_snapshots WHERE timestamp IS NOT NULL GROUP BY 1),
        x AS (SELECT *, row_number() OVER (ORDER BY bucket) - 1 AS i FROM b),
        o AS (SELECT regr_slope(e, i) AS slope, stddev_pop(e) / (avg(e) + 1) AS volatility, arg_max(a, bucket) AS latest_errors, CAST(sum(e) AS DOUBLE) AS total_errors FROM x),
        w AS (SELECT *, CASE WHEN slope < -0.5 THEN 'Improving' WHEN slope > 0.5 THEN 'Degrading' ELSE 'Stable' END AS trend FROM o)
        SELECT 'slope' AS metric, slope AS value, trend FROM w UNION ALL SELECT 'volatility', volatility, trend FROM w UNION ALL SELECT 'latest_errors', latest_errors, trend FROM w UNION ALL SELECT 'total_errors', total_errors, trend FROM w""",
    ),
}
COMPAT = {
    "ql_compat_or": ("SELECT file, severity FROM diagnostics WHERE severity = error OR line < 10 GROUP BY file", "SELECT file, severity FROM diagnostics WHERE severity = 'Error'"),
    "ql_compat_mixed": ("SELECT severity, COUNT(*) FROM diagnostics", "SELECT severity, CAST(NULL AS VARCHAR) AS count FROM diagnostics"),
    "ql_compat_count": ("SELECT COUNT(code) FROM diagnostics", "SELECT count(*) AS count_code FROM diagnostics"),
}


def _query(text: str, compat: bool):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return Engine(spark, d, NOW, compat).execute(text)

    return run


QUERIES = {k: _query(t, False) for k, (t, _) in TEXTS.items()} | {k: _query(t, True) for k, (t, _) in COMPAT.items()}
SQL = {k: VIEWS + s for k, (_, s) in (TEXTS | COMPAT).items()}
