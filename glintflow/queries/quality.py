"""Queries of the general data quality problems, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glintflow.operators.changefeed import current_state
from glintflow.operators.orphans import diagnostics_orphans, orphan_counts
from glintflow.operators.snapshots import changed_rows
from glintflow.sources.tables import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return diagnostics_orphans(*(table(spark, d, t) for t in ("diagnostic_assignments", "assignment_history", "repositories", "team_members", "deleted_keys")))


def p2_counts(spark: SparkSession, d: str) -> DataFrame:
    return orphan_counts(p2_found(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return current_state(table(spark, d, "assignment_history"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return changed_rows(table(spark, d, "diagnostic_snapshots"))


QUERIES = {"p2_found": p2_found, "p2_counts": p2_counts, "p3_found": p3_found, "p6_found": p6_found}

_KEY = r"lower(regexp_replace({0}, '^[\s ]+|[\s ]+$', '', 'g'))"
_P2 = f"""
WITH refs AS (
  SELECT 'diagnostic_assignments' AS table_name, 'repository_id' AS field_name, id AS record_id, 'repositories' AS parent, {_KEY.format("repository_id")} AS k, assigned_at AS at FROM diagnostic_assignments
  UNION ALL SELECT 'diagnostic_assignments', 'assignee_id', id, 'team_members', {_KEY.format("assignee_id")}, assigned_at FROM diagnostic_assignments
  UNION ALL SELECT 'diagnostic_assignments', 'assigned_by', id, 'team_members', {_KEY.format("assigned_by")}, assigned_at FROM diagnostic_assignments
  UNION ALL SELECT 'assignment_history', 'member_id', CAST(id AS VARCHAR), 'team_members', {_KEY.format("member_id")},
    CASE WHEN abs(timestamp) >= 100000000000 THEN timestamp // 1000 ELSE timestamp END FROM assignment_history
), parents AS (
  SELECT parent, k, min(since) AS since FROM (
    SELECT 'repositories' AS parent, {_KEY.format("id")} AS k, created_at AS since FROM repositories
    UNION ALL SELECT 'team_members', {_KEY.format("id")}, created_at FROM team_members) GROUP BY 1, 2
), gone AS (SELECT DISTINCT lower(trim(table_name)) AS parent, {_KEY.format("key_id")} AS k FROM deleted_keys),
found AS (
  SELECT DISTINCT r.table_name, r.field_name, r.record_id,
    CASE WHEN p.k IS NOT NULL THEN 'late' WHEN g.k IS NOT NULL THEN 'deleted' ELSE 'missing' END AS reason,
    coalesce(strftime(make_timestamp(r.at * 1000000), '%Y-%m'), 'unknown') AS period
  FROM refs r LEFT JOIN parents p ON r.parent = p.parent AND r.k = p.k LEFT JOIN gone g ON r.parent = g.parent AND r.k = g.k
  WHERE r.k IS NOT NULL AND r.k NOT IN ('', 'unassigned', 'none', 'n/a') AND (p.k IS NULL OR p.since > r.at)
)
"""

SQL = {
    "p2_found": _P2 + "SELECT * FROM found",
    "p2_counts": _P2 + "SELECT table_name, field_name, reason, period, count(*) AS n_references FROM found GROUP BY ALL",
    "p3_found": r"""
WITH feed AS (
  SELECT assignment_id, lower(regexp_replace(action, '[\s_-]+', '', 'g')) AS a, new_value AS v,
    CASE WHEN abs(timestamp) >= 100000000000 THEN timestamp // 1000 ELSE timestamp END AS tm, seq
  FROM assignment_history WHERE timestamp IS NOT NULL
), kept AS (SELECT *, lower(regexp_replace(v, '[\s_-]+', '', 'g')) AS w FROM feed WHERE a = 'deleted' OR v IS NOT NULL),
resets AS (
  SELECT assignment_id, arg_max(a, {'t': tm, 'q': seq}) AS fate, max({'t': tm, 'q': seq}) AS pos
  FROM kept WHERE a IN ('created', 'deleted') GROUP BY 1 HAVING fate = 'created'
), live AS (SELECT k.* FROM kept k JOIN resets r ON k.assignment_id = r.assignment_id AND {'t': k.tm, 'q': k.seq} >= r.pos),
sets AS (
  SELECT assignment_id, tm, seq,
    CASE WHEN a = 'statuschanged' THEN CASE w WHEN 'inprogress' THEN 'in_progress' ELSE w END
         WHEN a = 'created' THEN CASE WHEN v LIKE '{%' THEN json_extract_string(CASE WHEN v LIKE '{%' THEN v END, '$.status') ELSE 'open' END END AS status,
    CASE WHEN a = 'reassigned' OR a = 'created' AND v NOT LIKE '{%' THEN trim(regexp_replace(v, '^\s*assigned to ', '', 'i'))
         WHEN a = 'created' THEN json_extract_string(CASE WHEN v LIKE '{%' THEN v END, '$.assignee_id') END AS assignee_id,
    CASE WHEN a = 'prioritychanged' THEN w
         WHEN a = 'created' THEN CASE WHEN v LIKE '{%' THEN json_extract_string(CASE WHEN v LIKE '{%' THEN v END, '$.priority') ELSE 'medium' END END AS priority
  FROM live
)
SELECT assignment_id, arg_max(status, {'t': tm, 'q': seq}) AS status, arg_max(assignee_id, {'t': tm, 'q': seq}) AS assignee_id,
  arg_max(priority, {'t': tm, 'q': seq}) AS priority
FROM sets GROUP BY 1
""",
    "p6_found": r"""
WITH valid AS (
  SELECT regexp_replace(replace(file_path, '\', '/'), '^(\./+)+', '') AS f, timestamp AS ts, id, CAST(diagnostics_json AS JSON) AS j
  FROM diagnostic_snapshots WHERE json_valid(diagnostics_json) AND json_type(CASE WHEN json_valid(diagnostics_json) THEN diagnostics_json END) = 'ARRAY'
), held AS (SELECT f, ts, arg_max(j, id) AS j FROM valid GROUP BY 1, 2),
steps AS (SELECT f, ts, j, lag(ts) OVER w AS prev, lead(ts) OVER w AS next FROM held WINDOW w AS (PARTITION BY f ORDER BY ts)),
items AS (
  SELECT f, ts, prev, next, json_extract_string(e, '$.id') AS d,
    concat_ws('|', coalesce(json_extract_string(e, '$.severity'), '~'), coalesce(json_extract_string(e, '$.message'), '~'), coalesce(json_extract_string(e, '$.code'), '~'),
      coalesce(json_extract_string(e, '$.source'), '~'), coalesce(json_extract_string(e, '$.range.start.line'), '~'), coalesce(json_extract_string(e, '$.range.start.character'), '~'),
      coalesce(json_extract_string(e, '$.range.end.line'), '~'), coalesce(json_extract_string(e, '$.range.end.character'), '~')) AS v
  FROM (SELECT f, ts, prev, next, unnest(json_extract(j, '$[*]')) AS e FROM steps)
), n AS (SELECT f, ts, d, v FROM items WHERE prev IS NOT NULL), o AS (SELECT f, next AS ts, d, v FROM items WHERE next IS NOT NULL)
SELECT coalesce(n.f, o.f) AS file_path, coalesce(n.ts, o.ts) AS snapshot_ts, coalesce(n.d, o.d) AS diagnostic_id,
  CASE WHEN o.d IS NULL THEN 'added' WHEN n.d IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM n FULL JOIN o ON n.f = o.f AND n.ts = o.ts AND n.d = o.d WHERE n.d IS NULL OR o.d IS NULL OR n.v <> o.v
""",
}
