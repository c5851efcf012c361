"""Queries of workspaces, limits, reports, charts, teams and statistics, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from glintflow.functions import text as X
from glintflow.operators import health, incremental, multirepo, privacy, scoring, summary, team, training
from glintflow.queries import analysis
from glintflow.queries.language import VIEWS
from glintflow.sinks import export
from glintflow.sources import readers
from glintflow.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: bool = False):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = (VIEWS if views else "") + sql
        return f

    return add


# ---- workspaces and privacy


_IGNORED = r"""NOT coalesce(regexp_matches(file, '^(.*/)?(\.git|\.svn|\.hg|node_modules|vendor|target|\.cargo|dist|build|out|_build|\.idea|\.vscode|tmp|temp|\.cache|__pycache__|\.pytest_cache|coverage|htmlcov|secrets|credentials)/.*$')
 OR regexp_matches(file, '^(.*/)?(Thumbs\.db|\.DS_Store|[^/]*\.(tmp|temp|swp|swo)|~[^/]*|\.coverage|\.env[^/]*)$'), false)"""


@query("f_workspace", "SELECT id FROM (SELECT id, file_path AS file FROM diagnostic_snapshots) WHERE " + _IGNORED + r" AND NOT coalesce(regexp_matches(file, '^(.*/)?packet[^/]*$') OR regexp_matches(file, '^(.*/)?[^/]*\.py$'), false) AND file IN (SELECT file_path FROM diagnostic_snapshots WHERE created_at >= 1712000000)")
def _(spark, d):
    s = analysis.snaps(spark, d).withColumnRenamed("file_path", "file")
    return privacy.workspace(s, ["# generated", "packet*", "*.py"], files=s.where("created_at >= 1712000000").select("file")).select("id")


@query("f_workspace_open", "SELECT id FROM diagnostics WHERE " + _IGNORED + " AND NOT coalesce(contains(file, 'queue'), false)", True)
def _(spark, d):
    return privacy.workspace(analysis.diags(spark, d), more=("**queue**",)).select("id")


_MASKED = """regexp_replace(regexp_replace(regexp_replace({0}, '"[^"]*"', '"[STRING]"', 'g'), '''[^'']*''', '''[STRING]''', 'g'), '`[^`]*`', '`[STRING]`', 'g')"""
_HIDDEN = "CASE WHEN {0} = '' THEN {0} ELSE '[DIR_' || substr(sha256(CASE WHEN contains({0}, '/') THEN regexp_extract({0}, '^(.*)/[^/]*$', 1) ELSE '' END), 1, 6) || ']/' || regexp_extract({0}, '([^/]*)$', 1) END"


@query("d_related", f"SELECT id AS record, {_MASKED.format('message')} AS message, {_HIDDEN.format('coalesce(file, chr(0)[1:0])')} AS related_file, start_line AS related_line, {_MASKED.format('message')} AS related_message FROM sample_diagnostics")
def _(spark, d):
    span = F.struct(F.col("file").alias("file_name"), (F.col("start_line") + 1).alias("line_start"), (F.col("end_line") + 1).alias("line_end"), F.lit(1).alias("column_start"), F.lit(1).alias("column_end"), F.col("message").alias("label"))
    one = F.struct(F.array(span, span).alias("spans"), F.lit("error").alias("level"), F.col("message"))
    rows = readers.rust(analysis._raw(spark, d, F.to_json(F.array(one))))
    rows = rows.withColumns({"id": F.col("record"), "severity_rank": F.lit(1)})
    out = privacy.sanitised(rows, privacy.Policy(exclude=(), per_file=1 << 30, anonymous_paths=True))
    return out.select("record", "message", F.col("related")[0]["file"].alias("related_file"), F.col("related")[0]["line"].alias("related_line"), F.col("related")[0]["message"].alias("related_message"))


@query("d_permissive", ", m AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY severity_rank, id) AS i FROM diagnostics WHERE NOT coalesce(regexp_matches(file, '^(.*/)?(\\.git|node_modules)/.*$'), false)) SELECT id, file, message FROM m WHERE i <= 100", True)
def _(spark, d):
    return privacy.sanitised(analysis.diags(spark, d), privacy.Policy.permissive()).select("id", "file", "message")


# ---- limits and measurements


@query("a_global_limit", """WITH RECURSIVE e AS (SELECT event_id AS id, CAST(floor(epoch(ts) / 21600) AS BIGINT) AS t FROM events), c AS (SELECT t, count(*) AS n, row_number() OVER (ORDER BY t) AS i FROM e GROUP BY 1),
 s(i, let, held) AS (SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST([] AS STRUCT(t BIGINT, k BIGINT)[]) UNION ALL
  SELECT c.i, least(c.n, 200 - coalesce(list_sum(list_transform(list_filter(s.held, lambda x: x.t > c.t - 4), lambda x: x.k)), 0))::BIGINT, list_append(list_filter(s.held, lambda x: x.t > c.t - 4), {'t': c.t, 'k': least(c.n, 200 - coalesce(list_sum(list_transform(list_filter(s.held, lambda x: x.t > c.t - 4), lambda x: x.k)), 0))::BIGINT}) FROM s JOIN c ON c.i = s.i + 1)
 SELECT id, row_number() OVER (PARTITION BY e.t ORDER BY id) <= s.let AS allowed FROM e JOIN c USING (t) JOIN s ON s.i = c.i""")
def _(spark, d):
    r = table(spark, d, "events").select(F.col("event_id").alias("id"), F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 21600).cast("bigint").alias("ts"))
    return summary.globally_limited(r, 200, 4).select("id", "allowed")


@query("a_pressure", "SELECT event_type AS component, round(least(max(value) * 10000000 / 1073741824.0, 1.0), 9) AS pressure FROM events GROUP BY 1")
def _(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("component")).agg(F.max("value").alias("v")).select("component", F.round(summary.memory_pressure(F.col("v") * 10_000_000), 9).alias("pressure"))


@query("h_json", analysis._SCORES + """, i AS (SELECT s.*, list_filter([CASE WHEN hit_rate < 0.5 THEN 'low hit rate' END, CASE WHEN error_rate > 5 THEN 'high error rate' END, CASE WHEN breaker_open THEN 'breaker open' END], lambda x: x IS NOT NULL) AS l FROM s JOIN m USING (component))
 SELECT '{"component":' || to_json(component) || ',"score":' || printf('%.1f', score) || ',"status":"' || CASE WHEN score >= 90 THEN 'Online' WHEN score >= 70 THEN 'Degraded' ELSE 'Offline' END || '","issues":"' || array_to_string(l, ', ') || '"}' AS line FROM i""")
def _(spark, d):
    return health.json_report(health.component_scores(analysis._measured(spark, d)))


# ---- reports and charts


@query("k_summary", ", n AS (SELECT 'severity' AS section, severity AS key FROM diagnostics UNION ALL SELECT 'source', coalesce(source, 'unknown') FROM diagnostics UNION ALL SELECT 'project', CASE WHEN regexp_matches(file, 'src/[^/]*/') THEN regexp_extract(file, 'src/([^/]*)/', 1) WHEN regexp_matches(file, '[^/]+/[^/]*$') THEN regexp_extract(file, '([^/]+)/[^/]*$', 1) ELSE 'root' END FROM diagnostics) SELECT section, key, count(*) AS n FROM n GROUP BY 1, 2 UNION ALL SELECT 'files', 'files', count(DISTINCT file) FROM diagnostics", True)
def _(spark, d):
    return export.summary_lines(analysis.diags(spark, d))


@query("k_shares", "SELECT coalesce(source, 'unknown') AS name, count(*) AS value, round(count(*) / (SELECT count(*) FROM sample_diagnostics), 9) AS share, 'sources' AS title FROM sample_diagnostics GROUP BY 1")
def _(spark, d):
    return export.share_chart(analysis.diags(spark, d), "source", "sources")


@query("k_scatter", "SELECT CAST(error_count AS DOUBLE) AS x, CAST(warning_count AS DOUBLE) AS y, count(*) AS n FROM diagnostic_snapshots WHERE error_count IS NOT NULL AND warning_count IS NOT NULL GROUP BY 1, 2")
def _(spark, d):
    return export.scatter_chart(analysis.snaps(spark, d), "error_count", "warning_count")


@query("k_markdown_table", """SELECT '| ' || concat_ws(' | ', id, replace(coalesce(file, 'null'), '|', '\\|'), replace(message, '|', '\\|')) || ' |' AS line FROM sample_diagnostics""")
def _(spark, d):
    return export.to_format(analysis.diags(spark, d).select("id", "file", "message"), "markdown")


# ---- teams


_KEY = analysis._KEY


@query("t_metrics", f"""WITH a AS (SELECT DISTINCT ON (id) {_KEY.format('assignee_id')} AS m, {_KEY.format('repository_id')} AS r, completed_at - assigned_at AS s FROM diagnostic_assignments WHERE completed_at IS NOT NULL AND assigned_at IS NOT NULL)
 SELECT CASE WHEN m NOT IN ('', 'unassigned', 'none', 'n/a') THEN m END AS member_id, CASE WHEN r NOT IN ('', 'unassigned', 'none', 'n/a') THEN r END AS repository_id, count(*) AS resolved_count, round(avg(s), 3) AS avg_resolution_time FROM a GROUP BY 1, 2""")
def _(spark, d):
    a = table(spark, d, "diagnostic_assignments")
    early = F.pmod(F.xxhash64("id"), F.lit(2)) == 0  # two runs that are merged: each assignment is in one of them
    m = team.merged_metrics(team.metrics_of(a.where(early)), team.metrics_of(a.where(~early)))
    return m.withColumn("avg_resolution_time", F.round("avg_resolution_time", 3))


@query("t_with_status", r"""WITH e AS (SELECT DISTINCT assignment_id, seq, CASE WHEN abs(timestamp) >= 100000000000 THEN timestamp // 1000 ELSE timestamp END AS tm, lower(regexp_replace(trim(new_value), '[ -]', '_', 'g')) AS status FROM assignment_history WHERE timestamp IS NOT NULL AND new_value IS NOT NULL AND lower(regexp_replace(action, '[^A-Za-z]', '', 'g')) = 'statuschanged'),
 l AS (SELECT assignment_id, arg_max({'s': status, 't': tm}, {'t': tm, 'q': seq}) AS c FROM e GROUP BY 1) SELECT DISTINCT id, coalesce(c.s, status) AS status, CAST(CASE WHEN c.s = 'resolved' THEN c.t ELSE completed_at END AS BIGINT) AS completed_at FROM diagnostic_assignments LEFT JOIN l ON l.assignment_id = id""")
def _(spark, d):
    h = table(spark, d, "assignment_history").where("timestamp IS NOT NULL AND new_value IS NOT NULL").where(F.lower(F.regexp_replace("action", "[^A-Za-z]", "")) == "statuschanged")
    at = F.when(F.abs("timestamp") >= 100_000_000_000, F.floor(F.col("timestamp") / 1000)).otherwise(F.col("timestamp")).cast("bigint")
    changes = h.select("assignment_id", "seq", at.alias("at"), F.lower(F.regexp_replace(F.trim("new_value"), "[ -]", "_")).alias("status"))
    return team.with_status(table(spark, d, "diagnostic_assignments"), changes).select("id", "status", "completed_at").distinct()


@query("t_relations", "WITH h AS (SELECT monorepo_id, min(id) AS h FROM repositories WHERE monorepo_id IS NOT NULL GROUP BY 1), r AS (SELECT h AS source_id, id AS target_id, 'monorepo' AS relation_type FROM repositories JOIN h USING (monorepo_id) WHERE id <> h) SELECT * FROM r WHERE source_id = (SELECT min(source_id) FROM r) OR target_id = (SELECT min(source_id) FROM r)")
def _(spark, d):
    r = table(spark, d, "repositories").where("monorepo_id IS NOT NULL")
    heads = r.groupBy("monorepo_id").agg(F.min("id").alias("source_id"))
    relations = r.join(heads, "monorepo_id").where("id <> source_id").select("source_id", F.col("id").alias("target_id"), F.lit("monorepo").alias("relation_type"))
    first = relations.agg(F.min("source_id")).first()[0]
    return team.relations_of(relations, first or "")


# ---- statistics of training data


@query("m_context_size", analysis._PR + r""", z AS (SELECT coalesce(list_sum(list_transform(list_filter(regexp_extract_all(coalesce(prompt, ''), '(?s)```[\w+#.-]*[ \t]*\r?\n(.*?)(?:```|\z)', 1), lambda b: trim(b) <> ''), lambda b: length(b))), 0) AS s FROM pr) SELECT count(*) AS total_pairs, CAST(floor(sum(s) / count(*)) AS BIGINT) AS avg_context_size FROM z""")
def _(spark, d):
    return training.context_statistics(table(spark, d, "ml_training_examples"))


@query("m_custom", analysis._PR + """ SELECT example_id, '{' || concat_ws(',', '"key":' || CAST(example_id AS VARCHAR), '"lang":' || to_json(language), '"question":' || to_json(prompt), '"reply":' || to_json(answer)) || '}' AS line FROM pr WHERE prompt IS NOT NULL AND answer IS NOT NULL""")
def _(spark, d):
    return training.as_custom(table(spark, d, "ml_training_examples"), {"key": "example_id", "lang": "language", "question": "prompt", "reply": "answer"})


@query("m_sessions", """WITH e AS (SELECT json_extract_string(metadata, '$.language') AS language, CAST(json_extract_string(metadata, '$.confidence') AS DOUBLE) AS c, CAST(json_extract_string(metadata, '$.diagnostic_count') AS BIGINT) AS n, CAST(json_extract_string(metadata, '$.timestamp') AS BIGINT) AS t FROM ml_training_examples),
 a AS (SELECT coalesce(language, 'unknown') AS session, t, CASE WHEN n = 0 THEN 'Perfect' WHEN c > 0.9 THEN 'Good' WHEN c > 0.7 THEN 'Acceptable' WHEN c > 0.5 THEN 'Poor' ELSE 'Incorrect' END AS quality, c - 0.5 AS adjustment FROM e WHERE c IS NOT NULL),
 w AS (SELECT session, count(*) AS total_reviewed, round(avg(adjustment), 6) AS avg_confidence_adjustment, round((max(t) - min(t)) / count(*), 6) AS seconds_per_annotation FROM a GROUP BY 1) SELECT session, total_reviewed, quality, n, avg_confidence_adjustment, seconds_per_annotation FROM (SELECT session, quality, count(*) AS n FROM a GROUP BY 1, 2) JOIN w USING (session)""")
def _(spark, d):
    e = training.with_metadata(table(spark, d, "ml_training_examples")).where("confidence IS NOT NULL")
    a = e.select(F.coalesce("language", F.lit("unknown")).alias("language"), "ts", scoring.fix_quality(F.col("diagnostic_count"), F.col("confidence")).alias("quality"), (F.col("confidence") - 0.5).alias("adjustment"))
    return training.session_statistics(a, "language")


# ---- runs, dialects and words


@query("i_changed_since", "SELECT id FROM diagnostic_snapshots WHERE file_path IN (SELECT file_path FROM diagnostic_snapshots WHERE timestamp IS NOT NULL GROUP BY 1 HAVING max(timestamp) >= 1715000000)")
def _(spark, d):
    s = analysis.snaps(spark, d).withColumnRenamed("file_path", "file")
    files = s.where("timestamp IS NOT NULL").groupBy("file").agg(F.max("timestamp").alias("mtime"))
    return incremental.of_files(s, incremental.changed_since(files, 1_715_000_000)).select("id")


@query("r_normalised", """SELECT id AS record, coalesce(file, '') AS file, start_line, CASE WHEN severity IN ('Error', 'Warning') THEN severity WHEN severity = 'Hint' THEN 'Hint' ELSE 'Warning' END AS severity, message, code,
 CASE severity WHEN 'Error' THEN 'typescript' WHEN 'Warning' THEN 'rust-analyzer' WHEN 'Hint' THEN 'lsp' ELSE 'eslint' END AS source FROM sample_diagnostics""")
def _(spark, d):
    """Each record in the dialect of its severity, told by the shape of its JSON alone."""
    point = analysis._POINT
    code = F.coalesce("code", F.lit("none"))
    ts = F.to_json(F.struct(F.array(F.struct(F.col("file").alias("fileName"), point("start_line", "start_character").alias("start"), F.lit(1).alias("category"), F.col("message").alias("messageText"), code.alias("code"))).alias("diagnostics")))
    span = F.struct(F.coalesce("file", F.lit("")).alias("file_name"), (F.col("start_line") + 1).alias("line_start"))
    rust = F.to_json(F.struct(F.array(F.struct(F.array(span).alias("spans"), F.lit("warning").alias("level"), F.col("message"), F.struct(code.alias("code")).alias("code"))).alias("diagnostics")))
    eslint = F.to_json(F.struct(F.array(F.struct(F.col("file").alias("filePath"), F.array(F.struct((F.col("start_line") + 1).alias("line"), F.lit(1).alias("severity"), F.col("message"), code.alias("ruleId"))).alias("messages"))).alias("results")))
    lsp = F.to_json(F.struct(F.array(F.struct(F.coalesce("file", F.lit("")).alias("uri"), F.struct(point("start_line", "start_character").alias("start"), point("end_line", "end_character").alias("end")).alias("range"), F.lit(4).alias("severity"), F.col("message"), code.alias("code"))).alias("diagnostics")))
    s = F.col("severity")
    data = F.when(s == "Error", ts).when(s == "Warning", rust).when(s == "Hint", lsp).otherwise(eslint)
    raw = table(spark, d, "sample_diagnostics").select(F.col("id").alias("record"), F.lit(None).cast("string").alias("source"), data.alias("data"))
    return readers.normalised(raw).select("record", "file", "start_line", "severity", "message", F.nullif("code", F.lit("none")).alias("code"), "source")


@query("x_shared_words", r"""WITH w AS (SELECT id, list_distinct(list_filter(string_split_regex(message, '\s+'), lambda x: x <> '')) AS a, list_distinct(list_filter(string_split_regex(coalesce(source, '') || ' expected found type is not', '\s+'), lambda x: x <> '')) AS b FROM sample_diagnostics)
 SELECT id, CASE WHEN greatest(len(a), len(b)) > 0 THEN round(len(list_intersect(a, b)) / greatest(len(a), len(b)), 9) END AS share FROM w""")
def _(spark, d):
    told = F.concat(F.coalesce("source", F.lit("")), F.lit(" expected found type is not"))
    return analysis.diags(spark, d).select("id", F.round(X.shared_words(F.col("message"), told), 9).alias("share"))


@query("j_name_parts", "SELECT id AS repository_id, name, n FROM (SELECT id, unnest(string_split(name, '-')) AS name FROM repositories WHERE name IS NOT NULL) JOIN (SELECT name, count(*) AS n FROM (SELECT unnest(string_split(name, '-')) AS name FROM repositories WHERE name IS NOT NULL) GROUP BY 1) USING (name) WHERE n > 1")
def _(spark, d):
    r = table(spark, d, "repositories").where("name IS NOT NULL").select(F.col("id").alias("repository_id"), F.explode(F.split("name", "-")).alias("name"))
    shared = multirepo.shared_counts(r, "name")
    return r.join(shared, "name").select("repository_id", "name", "n")
