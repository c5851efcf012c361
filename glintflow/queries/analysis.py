"""Queries of the other operators, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from glintflow.functions import text as X
from glintflow.functions.patterns import checked_regex, glob_regex, wildcard_condition
from glintflow.operators import dedupe, health, history, incremental, multirepo, privacy, scoring, summary, team, training
from glintflow.plans.engine import files_view
from glintflow.queries.language import VIEWS
from glintflow.schema import diagnostics_of
from glintflow.sinks import export
from glintflow.sources import readers
from glintflow.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


RECURSIVE = VIEWS.replace("WITH", "WITH RECURSIVE", 1)


def query(name: str, sql: str | None = None, views: bool | str = False):
    """Registers a query; views: whether its SQL goes on after the views, or after views that may recur (``RECURSIVE``)."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = (VIEWS if views is True else views or "") + sql
        return f

    return add


def diags(spark, d):
    return diagnostics_of(table(spark, d, "sample_diagnostics"))


def snaps(spark, d):
    return table(spark, d, "diagnostic_snapshots")


# ---- filters


@query("f_path_contains", "SELECT id FROM diagnostics WHERE contains(file, 'src/token')", True)
def _(spark, d):
    return diags(spark, d).where(F.col("file").contains("src/token")).select("id")


@query("f_path_regex", "SELECT id FROM diagnostics WHERE regexp_matches(file, '/(token|queue)_[0-9]+\\.(rs|go)$')", True)
def _(spark, d):
    return diags(spark, d).where(F.col("file").rlike(checked_regex(r"/(token|queue)_[0-9]+\.(rs|go)$"))).select("id")


@query("f_category_any", "SELECT id FROM diagnostics WHERE coalesce(contains(code, 'TS2') OR contains(code, 'E03'), false)", True)
def _(spark, d):
    return diags(spark, d).where(F.coalesce(X.any_contains(F.col("code"), ("TS2", "E03")), F.lit(False))).select("id")


@query("f_message", "SELECT id FROM diagnostics WHERE contains(message, 'expected') AND regexp_matches(message, 'found `[A-Za-z0-9<>]+`')", True)
def _(spark, d):
    m = F.col("message")
    return diags(spark, d).where(m.contains("expected") & m.rlike("found `[A-Za-z0-9<>]+`")).select("id")


@query("f_files_counts", "SELECT file FROM files WHERE errors >= 1 AND total > 1", True)
def _(spark, d):
    return files_view(diags(spark, d)).where("errors >= 1 AND total > 1").select("file")


@query("f_globs", "SELECT id FROM diagnostics WHERE severity IN ('Error', 'Hint') AND source IN ('rustc', 'gopls') AND regexp_matches(file, '^src/[^/]*/[^/]*\\.(rs|go)$') AND NOT regexp_matches(file, '^(.*/)?queue[^/]*$')", True)
def _(spark, d):
    return privacy.selected(diags(spark, d), ["Error", "Hint"], ["rustc", "gopls"], ["src/*/*.rs", "src/*/*.go"], ["**/queue*"]).select("id")


@query("f_gitignore", "SELECT id FROM diagnostics WHERE NOT coalesce(regexp_matches(file, '^(.*/)?token/.*$') OR regexp_matches(file, '^(.*/)?[^/]*\\.py$'), false)", True)
def _(spark, d):
    return privacy.ignored(diags(spark, d), ["# generated", "token/", "*.py"]).select("id")


@query("f_wildcards", "SELECT id FROM diagnostics WHERE ends_with(file, '.rs') AND starts_with(file, 'src/') AND NOT contains(file, 'queue')", True)
def _(spark, d):
    f = F.col("file")
    return diags(spark, d).where(wildcard_condition(f, "*.rs") & wildcard_condition(f, "src/*") & ~wildcard_condition(f, "queue")).select("id")


@query("f_categories", """SELECT id, CASE WHEN contains(message, 'unexpected token') OR (contains(message, 'expected') AND (contains(message, ''';''') OR contains(message, '''}''') OR contains(message, ''')'''))) OR contains(message, 'unterminated') THEN 'SyntaxError'
 WHEN (contains(message, 'expected') AND contains(message, 'found')) OR contains(message, 'type mismatch') OR contains(message, 'cannot be assigned to') THEN 'TypeMismatch'
 WHEN regexp_matches(message, 'cannot find|not found|unresolved import|module not found') THEN 'MissingImport' ELSE 'UndefinedVariable' END AS category FROM diagnostics""", True)
def _(spark, d):
    return diags(spark, d).select("id", scoring.message_category(F.col("message")).alias("category"))


# ---- derived columns


@query("x_identifiers", """SELECT id, list_sort(list_distinct(list_concat(regexp_extract_all(message, '''([a-zA-Z_][a-zA-Z0-9_]*)''', 1), regexp_extract_all(message, '`([a-zA-Z_][a-zA-Z0-9_]*)`', 1)))) AS names FROM diagnostics""", True)
def _(spark, d):
    return diags(spark, d).select("id", F.array_sort(X.identifiers(F.col("message"))).alias("names"))


@query("x_types_numbers", """SELECT id, list_concat(list_concat(list_concat(regexp_extract_all(message, 'expected `([^`]+)`', 1), regexp_extract_all(message, 'found `([^`]+)`', 1)), regexp_extract_all(message, 'type `([^`]+)`', 1)), regexp_extract_all(message, ': ([A-Z][a-zA-Z0-9_]*)', 1)) AS types FROM diagnostics""", True)
def _(spark, d):
    return diags(spark, d).select("id", X.message_types(F.col("message")).alias("types"))


@query("x_language", "SELECT id, CASE regexp_extract(file, '\\.([A-Za-z0-9]+)$', 1) WHEN 'ts' THEN 'typescript' WHEN 'tsx' THEN 'typescript' WHEN 'js' THEN 'javascript' WHEN 'jsx' THEN 'javascript' WHEN 'rs' THEN 'rust' WHEN 'py' THEN 'python' WHEN 'go' THEN 'go' ELSE 'unknown' END AS language FROM diagnostics", True)
def _(spark, d):
    return diags(spark, d).select("id", X.language_of(F.col("file")).alias("language"))


@query("x_normal_message", """SELECT id, CASE WHEN contains(message, '  ') THEN trim(regexp_replace(message, '[\\s\\p{Z}]+', ' ', 'g')) WHEN ends_with(message, '.') THEN regexp_replace(message, '\\.+$', '')
 WHEN regexp_matches(message, '^[a-z]') THEN upper(message[1]) || message[2:] ELSE message END AS message FROM diagnostics""", True)
def _(spark, d):
    return diags(spark, d).select("id", X.normal_message(F.col("message")).alias("message"))


@query("x_mask_strings", """SELECT id, regexp_replace(regexp_replace(regexp_replace(message[1:8192], '"[^"]*"', '"[STRING]"', 'g'), '''[^'']*''', '''[STRING]''', 'g'), '`[^`]*`', '`[STRING]`', 'g') AS message FROM diagnostics""", True)
def _(spark, d):
    return diags(spark, d).select("id", X.mask_strings(F.col("message"), compat=True).alias("message"))


@query("x_mask_comments", r"""SELECT id, regexp_replace(regexp_replace(regexp_replace(message[1:8192], '//[^\n]*\z', '// [COMMENT]'), '/\*(?s:.*?)\*/', '/* [COMMENT] */', 'g'), '#[^\n]*\z', '# [COMMENT]') AS message FROM diagnostics""", True)
def _(spark, d):
    return diags(spark, d).select("id", X.mask_comments(F.col("message"), compat=True).alias("message"))


@query("x_anonymous_path", "SELECT id, '[DIR_' || substr(sha256(CASE WHEN contains(file, '/') THEN regexp_extract(file, '^(.*)/[^/]*$', 1) ELSE '' END), 1, 6) || ']/' || regexp_extract(file, '([^/]*)$', 1) AS file FROM diagnostics", True)
def _(spark, d):
    return diags(spark, d).select("id", X.anonymous_path(F.col("file")).alias("file"))


@query("x_name_similarity", """, n AS (SELECT id, message, regexp_extract(file, '([a-z]+)_[0-9]+\\.[a-z]+$', 1) AS name FROM diagnostics)
SELECT id, CASE WHEN contains(message, name) THEN 1.0 WHEN contains(lower(message), lower(name)) THEN 0.9
 WHEN len(list_filter(string_split_regex(message, '\\s+'), lambda w: w <> '' AND (contains(w, name) OR contains(name, w)))) > 0 THEN 0.7
 WHEN length(name) > 3 AND contains(lower(message), lower(name)) THEN 0.5 ELSE 0.0 END AS score FROM n""", True)
def _(spark, d):
    r = diags(spark, d).select("id", "message", F.regexp_extract("file", r"([a-z]+)_[0-9]+\.[a-z]+$", 1).alias("name"))
    return r.select("id", X.name_similarity(F.col("name"), F.col("message")).alias("score"))


@query("x_nearest_name", """, k(name) AS (VALUES ('rustc'), ('clippy'), ('eslint'), ('gopls'), ('clangd'), ('pyright'), ('typescript')), w AS (SELECT DISTINCT lower(source) AS word FROM diagnostics WHERE source IS NOT NULL),
 t AS (SELECT word, name, levenshtein(word, name) AS dist FROM w, k), b AS (SELECT word, arg_min(name, {'d': dist, 'n': name}) AS name, min(dist) AS dist FROM t GROUP BY 1) SELECT word, CASE WHEN dist <= 2 THEN name END AS nearest FROM b""", True)
def _(spark, d):
    words = diags(spark, d).where("source IS NOT NULL").select(F.lower("source").alias("word")).distinct()
    known = spark.createDataFrame([(n,) for n in ("rustc", "clippy", "eslint", "gopls", "clangd", "pyright", "typescript")], "name string")
    return scoring.nearest_name(words, known, 2)


# ---- summaries


@query("a_summary", """, s AS (SELECT coalesce(source, 'unknown') AS k, count(*) AS n FROM diagnostics GROUP BY 1)
SELECT count(*) AS total, count(*) FILTER (severity = 'Error') AS errors, count(*) FILTER (severity = 'Warning') AS warnings, count(*) FILTER (severity = 'Information') AS infos, count(*) FILTER (severity = 'Hint') AS hints, count(DISTINCT file) AS files,
 (SELECT count(*) FROM s) AS sources, (SELECT max(n) FROM s) AS largest_source FROM diagnostics""", True)
def _(spark, d):
    s = summary.summary(diags(spark, d))
    return s.select("total", "errors", "warnings", "infos", "hints", "files", F.size("by_source").cast("bigint").alias("sources"), F.array_max(F.map_values("by_source")).alias("largest_source"))


@query("a_main_language", """, l AS (SELECT CASE WHEN regexp_matches(file, 'src/[^/]*/') THEN regexp_extract(file, 'src/([^/]*)/', 1) ELSE 'root' END AS project, CASE regexp_extract(file, '\\.([A-Za-z0-9]+)$', 1) WHEN 'ts' THEN 'typescript' WHEN 'rs' THEN 'rust' WHEN 'py' THEN 'python' WHEN 'go' THEN 'go' ELSE 'unknown' END AS language FROM (SELECT DISTINCT file FROM diagnostics)),
 n AS (SELECT project, language, count(*) AS n FROM l WHERE language <> 'unknown' GROUP BY 1, 2) SELECT project, arg_min(language, {'n': -n, 'l': language}) AS main_language, max(n) AS files FROM n GROUP BY 1""", True)
def _(spark, d):
    files = diags(spark, d).select("file").distinct().select(X.project_of(F.col("file")).alias("project"), X.language_of(F.col("file")).alias("language"))
    return summary.main_language(files, "project")


@query("a_percentiles", """, r AS (SELECT source, line, row_number() OVER (PARTITION BY source ORDER BY line DESC) AS i, count(*) OVER (PARTITION BY source) AS n FROM diagnostics WHERE source IS NOT NULL)
SELECT source, max(line) FILTER (i = floor((n - 1) * 0.95) + 1) AS at_95, max(line) FILTER (i = floor((n - 1) * 0.8) + 1) AS at_80, max(line) FILTER (i = floor((n - 1) * 0.5) + 1) AS at_50 FROM r GROUP BY 1""", True)
def _(spark, d):
    return summary.positional_percentile(diags(spark, d).where("source IS NOT NULL"), "line", "source", (0.95, 0.8, 0.5))


@query("a_rate_limit", """SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN 3599 PRECEDING AND CURRENT ROW) <= 3 AS allowed FROM (SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events)""")
def _(spark, d):
    r = table(spark, d, "events").select("event_id", F.col("user_id").alias("client"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("ts"))
    return summary.rate_limited(r, 3, 3600).select("event_id", "allowed")


@query("a_moving_rate", """, o AS (SELECT source, id, severity <> 'Error' AS s, row_number() OVER (PARTITION BY source ORDER BY id DESC) - 1 AS a FROM diagnostics WHERE source IS NOT NULL)
SELECT source, round(sum(s::INT * 0.1 * pow(0.9, a)) + 0.5 * pow(0.9, count(*)), 9) AS rate FROM o GROUP BY 1""", True)
def _(spark, d):
    o = diags(spark, d).where("source IS NOT NULL").select("source", F.col("id").alias("seq"), (F.col("severity") != "Error").alias("success"))
    return summary.moving_rate(o, "source").select("source", F.round("rate", 9).alias("rate"))


_RECORDS = "(SELECT CAST(floor(epoch(ts)) AS BIGINT) AS ts, event_id % 7 AS hits, event_id % 3 AS misses, value AS millis, 1 AS files, user_id % 4 + 1 AS tasks, event_type = 'error' AS failed FROM events)"


def _records(spark, d):
    e = table(spark, d, "events")
    return e.select(F.unix_seconds(F.col("ts").cast("timestamp")).alias("ts"), (F.col("event_id") % 7).alias("hits"), (F.col("event_id") % 3).alias("misses"), F.col("value").alias("millis"), F.lit(1).alias("files"), (F.col("user_id") % 4 + 1).alias("tasks"), (F.col("event_type") == "error").alias("failed"))


_T0, _T1 = 1706486400, 86_400 * 20  # 2024-01-29, over twenty days


@query("a_processing", f"""WITH r AS (SELECT * FROM {_RECORDS} WHERE ts >= {_T0 - _T1} AND ts <= {_T0}), a AS (SELECT count(*) AS records, sum(hits) AS h, sum(misses) AS m, avg(millis) AS ms, sum(files) AS f, max(ts) - min(ts) AS s, avg(tasks) AS t, count(*) FILTER (failed) AS x FROM r)
SELECT records, round(h / (h + m), 6) AS hit_rate, round(ms, 6) AS avg_millis, round(f / s, 9) AS throughput, round(CASE WHEN t > 1 THEN f / s / t ELSE 1.0 END, 9) AS efficiency, round(x * 3600.0 / {_T1}, 9) AS errors_per_hour FROM a""")
def _(spark, d):
    m = summary.processing_metrics(_records(spark, d), _T0, _T1)
    return m.select("records", F.round("hit_rate", 6).alias("hit_rate"), F.round("avg_millis", 6).alias("avg_millis"), F.round("throughput", 9).alias("throughput"), F.round("efficiency", 9).alias("efficiency"), F.round("errors_per_hour", 9).alias("errors_per_hour"))


@query("a_batches", f"SELECT count(*) FILTER (NOT failed) AS succeeded, count(*) FILTER (failed) AS failed, round(avg(millis), 6) AS avg_millis FROM {_RECORDS}")
def _(spark, d):
    b = summary.batch_stats(_records(spark, d))
    return b.select("succeeded", "failed", F.round("avg_millis", 6).alias("avg_millis"))


@query("a_error_rate", f"SELECT count(*) FILTER (ts > {_T0} - 86400 AND ts <= {_T0}) / 86400.0 AS errors_per_second FROM {_RECORDS} WHERE failed")
def _(spark, d):
    return summary.error_rate(_records(spark, d).where("failed"), _T0, 86_400)


@query("a_memory", f"SELECT sum(hits * 100) AS total_bytes, CAST(floor(avg(hits * 100)) AS BIGINT) AS avg_bytes, round(avg(millis), 6) AS avg_millis, arg_max(hits * 100, {{'t': ts, 'b': hits}}) AS last_bytes FROM {_RECORDS}")
def _(spark, d):
    m = summary.memory_stats(_records(spark, d).select("ts", (F.col("hits") * 100).alias("bytes"), "millis"))
    return m.select("total_bytes", "avg_bytes", F.round("avg_millis", 6).alias("avg_millis"), "last_bytes")


# ---- history


@query("w_time_series", "SELECT timestamp // 86400 * 86400 AS bucket, count(*) AS snapshots, sum(error_count) AS total_errors, sum(warning_count) AS total_warnings, sum(error_count) / count(*) AS avg_errors, sum(warning_count) / count(*) AS avg_warnings, count(DISTINCT file_path) AS unique_files FROM diagnostic_snapshots WHERE timestamp BETWEEN 1706745600 AND 1730419200 GROUP BY 1")
def _(spark, d):
    return history.time_series(snaps(spark, d), 86_400, 1706745600, 1730419200)


@query("w_velocity", "SELECT coalesce(sum(error_count), 0) / 24.0 AS error_velocity, coalesce(sum(warning_count), 0) / 24.0 AS warning_velocity FROM diagnostic_snapshots WHERE timestamp BETWEEN 1719792000 AND 1719878400")
def _(spark, d):
    return history.velocity(history.time_series(snaps(spark, d), 3600, 1719792000, 1719878400), 86_400)


@query("w_trend", "WITH b AS (SELECT timestamp // 86400 AS k, sum(error_count) AS e FROM diagnostic_snapshots WHERE timestamp IS NOT NULL GROUP BY 1), x AS (SELECT e, row_number() OVER (ORDER BY k) - 1 AS i FROM b) SELECT round(regr_slope(e, i), 9) AS slope, CASE WHEN regr_slope(e, i) < -0.5 THEN 'Improving' WHEN regr_slope(e, i) > 0.5 THEN 'Degrading' ELSE 'Stable' END AS direction FROM x")
def _(spark, d):
    t = history.trend(history.time_series(snaps(spark, d), 86_400))
    return t.select(F.round("slope", 9).alias("slope"), "direction")


@query("w_health", "WITH b AS (SELECT timestamp // 86400 AS k, avg(error_count) AS e, avg(warning_count) AS w FROM diagnostic_snapshots WHERE timestamp IS NOT NULL GROUP BY 1), l AS (SELECT arg_max(e, k) AS e, arg_max(w, k) AS w FROM b) SELECT round(0.5 / (1 + e / 10) + 0.3 / (1 + w / 20) + 0.2 / (1 + 0.3), 9) AS health_score FROM l")
def _(spark, d):
    h = history.health(history.time_series(snaps(spark, d), 86_400), 3)
    return h.select(F.round("health_score", 9).alias("health_score"))


@query("w_volatility", "SELECT file_path, round(CASE WHEN count(*) < 2 THEN 0 ELSE stddev_pop(error_count) / (avg(error_count) + 1) END, 9) AS volatility FROM diagnostic_snapshots GROUP BY 1")
def _(spark, d):
    v = history.volatility(snaps(spark, d))
    return v.select("file_path", F.round("volatility", 9).alias("volatility"))


def _file_trend_sql(order: str) -> str:
    return f"""WITH r AS (SELECT file_path, error_count AS e, warning_count AS w, row_number() OVER (PARTITION BY file_path ORDER BY timestamp {order}, id {order}) <= count(*) OVER (PARTITION BY file_path) // 2 AS early, count(*) OVER (PARTITION BY file_path) AS n FROM diagnostic_snapshots),
 c AS (SELECT file_path, any_value(n) AS n, (avg(e) FILTER (NOT early) - avg(e) FILTER (early)) * 2 + avg(w) FILTER (NOT early) - avg(w) FILTER (early) AS c FROM r GROUP BY 1)
 SELECT file_path, round(CASE WHEN n < 2 THEN 0 ELSE c END, 9) + 0.0 AS change, CASE WHEN n < 2 THEN 'Stable' WHEN round(c, 9) < -1 THEN 'Improving' WHEN round(c, 9) > 1 THEN 'Degrading' ELSE 'Stable' END AS trend FROM c"""


def _rounded_trend(t):
    c = F.round("change", 9) + 0.0  # no negative zero
    return t.select("file_path", c.alias("change"), history.direction(c, -1.0, 1.0).alias("trend"))


@query("w_file_trend", _file_trend_sql("ASC"))
def _(spark, d):
    return _rounded_trend(history.file_trends(snaps(spark, d)))


@query("w_file_trend_compat", _file_trend_sql("DESC"))
def _(spark, d):
    return _rounded_trend(history.file_trends(snaps(spark, d), compat=True))


@query("w_predictions", """WITH r AS (SELECT file_path, error_count AS e, warning_count AS w, row_number() OVER (PARTITION BY file_path ORDER BY timestamp DESC, id DESC) AS i, count(*) OVER (PARTITION BY file_path) AS n FROM diagnostic_snapshots),
 p AS (SELECT file_path, any_value(n) AS n, CAST(floor(avg(e) FILTER (i <= 5)) AS BIGINT) AS e, CAST(floor(avg(w) FILTER (i <= 5)) AS BIGINT) AS w, stddev_pop(e) / (avg(e) + 1) AS v FROM r GROUP BY 1)
 SELECT file_path, CASE WHEN n >= 3 THEN e ELSE 0 END AS next_errors, CASE WHEN n >= 3 THEN w ELSE 0 END AS next_warnings, round(CASE WHEN n >= 3 THEN 1 / (1 + v) ELSE 0 END, 9) AS confidence FROM p""")
def _(spark, d):
    p = history.predictions(snaps(spark, d))
    return p.select("file_path", "next_errors", "next_warnings", F.round("confidence", 9).alias("confidence"))


@query("w_hot_spots", "WITH f AS (SELECT file_path, avg(error_count) AS e, avg(warning_count) AS w FROM diagnostic_snapshots GROUP BY 1) SELECT file_path, e AS avg_errors, w AS avg_warnings, round(e * 2 + w, 9) AS score, CASE WHEN e > 5 THEN 'needs attention now' ELSE 'watch for changes' END AS recommendation FROM f ORDER BY score DESC, file_path LIMIT 20")
def _(spark, d):
    return history.hot_spots(snaps(spark, d), 20)


@query("w_recurring", "SELECT pattern_hash, error_message, occurrence_count, round(occurrence_count / greatest((last_seen - first_seen) / 86400, 1.0), 9) AS occurrence_rate, CASE WHEN occurrence_count > 100 THEN 'write a lint rule or an automatic fix' WHEN files_affected > 10 THEN 'refactor across the code base' WHEN error_code = 'TS2304' THEN 'check imports and type definitions' ELSE 'watch its frequency' END AS action FROM error_patterns WHERE occurrence_count >= 5")
def _(spark, d):
    r = history.recurring(table(spark, d, "error_patterns"), 5)
    return r.withColumn("occurrence_rate", F.round("occurrence_rate", 9))


@query("w_patterns_of", "SELECT substr(sha256(concat_ws(chr(31), coalesce(message, ''), coalesce(code, ''), coalesce(source, ''))), 1, 20) AS pattern_hash, count(*) AS occurrence_count, count(DISTINCT file) AS files_affected, min(message) AS error_message, min(code) AS error_code, min(source) AS source FROM sample_diagnostics GROUP BY 1")
def _(spark, d):
    return history.patterns_of(table(spark, d, "sample_diagnostics"))


@query("w_lifetimes", "SELECT file_path, min(timestamp) AS first_seen, max(timestamp) AS last_seen, count(*) AS total_snapshots, sum(error_count) AS total_errors, sum(warning_count) AS total_warnings, avg(error_count) AS avg_errors, avg(warning_count) AS avg_warnings, max(error_count) AS max_errors, max(warning_count) AS max_warnings FROM diagnostic_snapshots GROUP BY 1")
def _(spark, d):
    return history.lifetimes(snaps(spark, d))


@query("w_fix_minutes", "SELECT category, minutes FROM (VALUES ('SyntaxErrors', 5), ('TypeErrors', 15), ('Linting', 10), ('Build', 20), ('Runtime', 30), ('Other', 15)) t(category, minutes)")
def _(spark, d):
    return history.fix_minutes(spark.createDataFrame([(k,) for k in history.FIX_MINUTES], "category string"))


_FILE = "(SELECT arg_max(file_path, {'n': n, 'f': file_path}) FROM (SELECT file_path, count(*) AS n FROM diagnostic_snapshots GROUP BY 1))"


@query("w_scan", f"SELECT id, timestamp, error_count FROM diagnostic_snapshots WHERE file_path = {_FILE} AND timestamp >= 1700000000 ORDER BY timestamp DESC, id DESC LIMIT 10")
def _(spark, d):
    n = snaps(spark, d).groupBy("file_path").agg(F.count(F.lit(1)).alias("n"))
    name = n.agg(F.max_by("file_path", F.struct("n", "file_path")).alias("file_path"))
    return history.scan(snaps(spark, d), name, 1700000000, 10).select("id", "timestamp", "error_count")


@query("w_retention", "SELECT id FROM diagnostic_snapshots WHERE created_at >= 1720000000")
def _(spark, d):
    return history.retained(snaps(spark, d), 1720000000).select("id")


@query("w_orphan_files", "SELECT DISTINCT file_path FROM diagnostic_snapshots WHERE file_path NOT IN (SELECT file_path FROM diagnostic_snapshots WHERE created_at >= 1720000000)")
def _(spark, d):
    s = snaps(spark, d)
    return history.orphan_files(s.select("file_path").distinct(), history.retained(s, 1720000000))


@query("w_learning_points", "WITH f AS (SELECT file_path, avg(error_count) AS e, avg(warning_count) AS w, count(*) / 100 AS c FROM diagnostic_snapshots GROUP BY 1) SELECT s.timestamp, s.file_path, s.error_count, s.warning_count, f.e AS avg_errors, f.w AS avg_warnings, f.c AS complexity FROM diagnostic_snapshots s JOIN f USING (file_path)")
def _(spark, d):
    return history.learning_points(snaps(spark, d))


# ---- dedupe, privacy, groups


@query("d_first", ", r AS (SELECT id, row_number() OVER (PARTITION BY file, line, \"column\", severity, message[1:100] ORDER BY id) AS i FROM diagnostics) SELECT id FROM r WHERE i = 1", True)
def _(spark, d):
    return dedupe.deduplicated(diags(spark, d)).select("id")


@query("d_worst_per_file", ", r AS (SELECT id, row_number() OVER (PARTITION BY file ORDER BY severity_rank, id) AS i FROM diagnostics) SELECT id FROM r WHERE i <= 1", True)
def _(spark, d):
    return dedupe.worst_per_file(diags(spark, d), 1).select("id")


@query("d_privacy", """, m AS (SELECT id, file, severity_rank, regexp_replace(regexp_replace(regexp_replace(message[1:8192], '"[^"]*"', '"[STRING]"', 'g'), '''[^'']*''', '''[STRING]''', 'g'), '`[^`]*`', '`[STRING]`', 'g') AS message FROM diagnostics
 WHERE NOT coalesce(regexp_matches(file, '^(.*/)?(\\.env[^/]*|secrets/.*|\\.git/.*|node_modules/.*|[^/]*\\.log|dist/.*|build/.*)$'), false)), r AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY severity_rank, id) AS i FROM m) SELECT id, file, message FROM r WHERE i <= 50""", True)
def _(spark, d):
    return privacy.sanitised(diags(spark, d), privacy.Policy(compat=True)).select("id", "file", "message")


@query("d_capture", r""", m AS (SELECT id, CASE WHEN file = '' THEN file ELSE '[DIR_' || substr(sha256(CASE WHEN contains(file, '/') THEN regexp_extract(file, '^(.*)/[^/]*$', 1) ELSE '' END), 1, 6) || ']/' || regexp_extract(file, '([^/]*)$', 1) END AS file, line, "column", severity, severity_rank,
  regexp_replace(regexp_replace(regexp_replace(message, '"[^"]*"', '"[STRING]"', 'g'), '''[^'']*''', '''[STRING]''', 'g'), '`[^`]*`', '`[STRING]`', 'g') AS t FROM diagnostics
  WHERE severity = 'Error' AND NOT coalesce(regexp_matches(file, '^(.*/)?(\.env[^/]*|secrets/.*|\.git/.*|node_modules/.*|[^/]*\.log|dist/.*|build/.*|config/.*|\.ssh/.*|credentials/.*)$'), false)),
 c AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(t, '//[^\n]*\z', '// [COMMENT]'), '/\*(?s:.*?)\*/', '/* [COMMENT] */', 'g'), '#[^\n]*\z', '# [COMMENT]') AS message, row_number() OVER (PARTITION BY file ORDER BY severity_rank, id) AS i FROM m),
 r AS (SELECT *, row_number() OVER (PARTITION BY file, line, "column", severity, message[1:100] ORDER BY id) AS k FROM c WHERE i <= 20) SELECT id, file, message FROM r WHERE k = 1""", True)
def _(spark, d):
    return privacy.captured(diags(spark, d), privacy.Policy.strict()).select("id", "file", "message")


_GROUPS = r""", gf AS (SELECT id, file, line, "column", severity, row_number() OVER (PARTITION BY file ORDER BY line NULLS FIRST, severity_rank NULLS FIRST, id) AS i, list_distinct(list_concat(regexp_extract_all(coalesce(message, ''), '''([a-zA-Z_][a-zA-Z0-9_]*)''', 1), regexp_extract_all(coalesce(message, ''), '`([a-zA-Z_][a-zA-Z0-9_]*)`', 1))) AS sy,
  regexp_matches(coalesce(message, ''), 'type|Type') AS ty, contains(coalesce(message, ''), 'import') AS im, contains(coalesce(message, ''), 'module') AS mo, contains(coalesce(message, ''), 'initialized') AS ini, contains(coalesce(message, ''), 'assigned') AS asg, contains(coalesce(message, ''), 'used') AS usd,
  contains(coalesce(message, ''), 'initializer') AS inr, contains(coalesce(message, ''), 'before') AS bef, contains(coalesce(message, ''), 'borrow') AS bor, contains(coalesce(message, ''), 'moved') AS mov, contains(coalesce(message, ''), 'lifetime') AS lif, contains(coalesce(source, ''), 'rust') AS ru FROM diagnostics WHERE file IS NOT NULL AND id IS NOT NULL),
 gp AS (SELECT a.file, a.i, b.i AS j, CASE WHEN len(list_intersect(a.sy, b.sy)) > 0 THEN 0.8 WHEN a.severity = 'Error' AND b.severity = 'Error' AND a.ty AND b.ty THEN 0.7 WHEN (a.im AND b.im) OR (a.mo AND b.mo) THEN 0.9 WHEN a.line = b.line AND abs(a."column" - b."column") < 10 THEN 0.6
  WHEN (a.ini AND b.asg) OR (a.asg AND b.usd) OR (a.inr AND b.bef) THEN 0.85 WHEN a.ru AND ((a.bor AND b.bor) OR (a.mov AND b.mov) OR (a.lif AND b.lif)) THEN 0.75 END AS c FROM gf a JOIN gf b ON a.file = b.file AND a.i <> b.i),
 gm AS (SELECT file, i, list({'j': j, 'c': CAST(c AS DOUBLE)} ORDER BY j) AS js FROM gp WHERE c IS NOT NULL GROUP BY 1, 2), gn AS (SELECT file, max(i) AS n FROM gf GROUP BY 1),
 gs(file, i, taken, rel) AS (SELECT file, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST(NULL AS STRUCT(j BIGINT, c DOUBLE)[]) FROM gn UNION ALL
  SELECT s.file, s.i + 1, CASE WHEN list_contains(s.taken, s.i + 1) THEN s.taken ELSE list_concat(list_append(s.taken, s.i + 1), list_transform(list_filter(coalesce(m.js, []), lambda x: NOT list_contains(s.taken, x.j)), lambda x: x.j)) END,
   CASE WHEN list_contains(s.taken, s.i + 1) THEN NULL ELSE list_filter(coalesce(m.js, []), lambda x: NOT list_contains(s.taken, x.j)) END FROM gs s JOIN gn ON s.file = gn.file LEFT JOIN gm m ON m.file = s.file AND m.i = s.i + 1 WHERE s.i < gn.n),
 gg AS (SELECT f.file, f.id AS primary_id, f.severity, f.line, CAST(len(rel) AS INT) AS related, coalesce(list_min(list_transform(rel, lambda x: x.c)), 1.0) AS confidence FROM gs JOIN gf f ON f.file = gs.file AND f.i = gs.i WHERE rel IS NOT NULL)"""


@query("d_groups", _GROUPS + " SELECT file, primary_id, severity, line, related, confidence FROM gg", RECURSIVE)
def _(spark, d):
    return dedupe.grouped(diags(spark, d)).select("file", "primary_id", "severity", "line", F.size("related").alias("related"), "confidence")


@query("d_group_summary", _GROUPS + " SELECT count(*) AS total_groups, CAST(coalesce(sum(related + 1), 0) AS BIGINT) AS total_diagnostics, count(*) FILTER (severity = 'Error') AS primary_errors, CAST(coalesce(sum(related), 0) AS BIGINT) AS cascading_errors, sum(related + 1) / count(*) AS average_group_size FROM gg", RECURSIVE)
def _(spark, d):
    return dedupe.group_summary(dedupe.grouped(diags(spark, d)))


# ---- scores


_ANALYSED = r""", a AS (SELECT id, file, line, severity, message, code, CASE WHEN regexp_matches(lower(coalesce(source, '')), 'typescript|eslint') THEN 'typescript' WHEN contains(lower(coalesce(source, '')), 'rust') THEN 'rust' END AS language FROM diagnostics),
 k AS (SELECT *, CASE WHEN language = 'rust' THEN CASE lpad(regexp_replace(coalesce(code, ''), '^E', ''), 4, '0') WHEN '0499' THEN 'borrow' WHEN '0502' THEN 'borrow' WHEN '0503' THEN 'borrow' WHEN '0504' THEN 'borrow' WHEN '0505' THEN 'borrow' WHEN '0106' THEN 'lifetime' WHEN '0621' THEN 'lifetime' WHEN '0623' THEN 'lifetime' WHEN '0495' THEN 'lifetime'
   WHEN '0382' THEN 'move' WHEN '0507' THEN 'move' WHEN '0508' THEN 'move' WHEN '0509' THEN 'move' WHEN '0308' THEN 'type' WHEN '0277' THEN 'trait' ELSE
   CASE WHEN contains(message, 'borrow') THEN 'borrow' WHEN regexp_matches(message, 'lifetime|does not live long enough') THEN 'lifetime' WHEN contains(message, 'move') THEN 'move' WHEN contains(message, 'expected') AND contains(message, 'found') THEN 'type' WHEN contains(message, 'trait') AND contains(message, 'not implemented') THEN 'trait' ELSE 'unknown' END END
  WHEN language = 'typescript' THEN CASE code WHEN '2339' THEN 'property' WHEN '2551' THEN 'property' WHEN '2322' THEN 'type' WHEN '2345' THEN 'type' WHEN '2304' THEN 'import' WHEN '2552' THEN 'import' WHEN '2314' THEN 'generic' ELSE
   CASE WHEN contains(message, 'Property') AND contains(message, 'does not exist') THEN 'property' WHEN contains(message, 'Type') AND contains(message, 'is not assignable') THEN 'type' WHEN contains(message, 'Cannot find') THEN 'import' ELSE 'unknown' END END ELSE 'unknown' END AS kind FROM a),
 z AS (SELECT *, CASE language || kind WHEN 'rustborrow' THEN CASE WHEN contains(message, 'does not live long enough') THEN 'LifetimeError' ELSE 'BorrowChecker' END WHEN 'rustlifetime' THEN 'LifetimeError' WHEN 'rustmove' THEN 'BorrowChecker' WHEN 'rusttype' THEN 'TypeMismatch' WHEN 'rusttrait' THEN 'TypeMismatch'
   WHEN 'typescriptproperty' THEN 'MissingProperty' WHEN 'typescripttype' THEN 'TypeMismatch' WHEN 'typescriptimport' THEN 'MissingImport' WHEN 'typescriptgeneric' THEN 'TypeMismatch' ELSE 'Unknown' END AS category,
   CASE language || kind WHEN 'rustborrow' THEN CASE WHEN contains(message, 'cannot borrow') AND contains(message, 'as mutable more than once') THEN 4 ELSE 3 END WHEN 'rustlifetime' THEN 4 WHEN 'rustmove' THEN 2 WHEN 'rusttype' THEN 2 WHEN 'rusttrait' THEN 3 WHEN 'typescriptproperty' THEN 2 WHEN 'typescripttype' THEN 3 WHEN 'typescriptimport' THEN 2 WHEN 'typescriptgeneric' THEN 2 ELSE 3 END AS fix_complexity,
   language = 'rust' AND kind = 'borrow' AS cascading FROM k)"""


@query("x_analysed", _ANALYSED + " SELECT id, language, kind, category, fix_complexity, coalesce(cascading, false) AS cascading FROM z", True)
def _(spark, d):
    return scoring.analysed(diags(spark, d)).select("id", "language", "kind", "category", "fix_complexity", "cascading")


_PRIORITY = _GROUPS + _ANALYSED + """, g AS (SELECT z.*, gg.related AS related_count FROM z JOIN gg ON gg.primary_id = z.id), s AS (SELECT *, CASE severity WHEN 'Error' THEN 100 WHEN 'Warning' THEN 60 WHEN 'Information' THEN 30 ELSE 10 END AS sev, CASE WHEN line < 50 THEN 90 WHEN line < 200 THEN 70 WHEN line < 500 THEN 50 ELSE 30 END AS loc,
 CASE WHEN related_count = 0 THEN 20 WHEN related_count <= 2 THEN 40 WHEN related_count <= 5 THEN 60 WHEN related_count <= 10 THEN 80 ELSE 100 END AS base, CASE fix_complexity WHEN 1 THEN 100 WHEN 2 THEN 80 WHEN 3 THEN 60 WHEN 4 THEN 40 WHEN 5 THEN 20 ELSE 30 END AS cpl,
 CASE category WHEN 'MissingImport' THEN 90 WHEN 'TypeMismatch' THEN 70 WHEN 'MissingProperty' THEN 65 WHEN 'BorrowChecker' THEN 60 WHEN 'LifetimeError' THEN 55 ELSE 50 END AS cat FROM g),
 p AS (SELECT *, round(sev * 0.35 + loc * 0.15 + CASE WHEN coalesce(cascading, false) THEN least(base * 1.5, 100) ELSE base END * 0.25 + cpl * 0.15 + cat * 0.1, 6) AS priority, related_count + CASE WHEN coalesce(cascading, false) THEN 5 ELSE 0 END AS impact_radius FROM s)"""


def _prioritised(spark, d):
    d_ = diags(spark, d)
    groups = dedupe.grouped(d_).select(F.col("primary_id").alias("id"), F.size("related").alias("related_count"))
    return scoring.prioritised(scoring.analysed(d_).join(groups, "id"))


@query("x_priority", _PRIORITY + " SELECT id, priority, impact_radius FROM p", RECURSIVE)
def _(spark, d):
    return _prioritised(spark, d).select("id", "priority", "impact_radius")


@query("x_priority_summary", _PRIORITY + " SELECT count(*) AS groups, count(*) FILTER (priority >= 70) AS high_priority, count(*) FILTER (fix_complexity <= 2) AS quick_fixes, count(*) FILTER (impact_radius > 5) AS cascading, round(avg(priority), 6) AS average_priority FROM p", RECURSIVE)
def _(spark, d):
    return scoring.priority_summary(_prioritised(spark, d))


@query("x_fix_order", _PRIORITY + " SELECT id, priority, row_number() OVER (ORDER BY priority DESC, id) AS rank FROM p ORDER BY priority DESC, id LIMIT 30", RECURSIVE)
def _(spark, d):
    return scoring.fix_order(_prioritised(spark, d), 30).select("id", "priority", "rank")


_CONFIDENCE = """round((CASE WHEN code IS NULL THEN 0.3 ELSE CASE code WHEN 'TS2322' THEN 0.85 WHEN 'TS2339' THEN 0.75 WHEN 'TS2345' THEN 0.8 WHEN 'TS1005' THEN 0.95 WHEN 'E0308' THEN 0.8 WHEN 'E0384' THEN 0.9 WHEN 'E0382' THEN 0.7 WHEN 'E0596' THEN 0.85 ELSE 0.5 END END) * 0.45
 + CASE WHEN length(message) <= 20 THEN 0.9 WHEN length(message) <= 50 THEN 0.8 WHEN length(message) <= 100 THEN 0.6 WHEN length(message) <= 200 THEN 0.4 ELSE 0.2 END * 0.15 + CASE severity WHEN 'Error' THEN 0.7 WHEN 'Warning' THEN 0.8 WHEN 'Information' THEN 0.9 WHEN 'Hint' THEN 0.95 ELSE 0.7 END * 0.15
 + CASE regexp_extract(file, '\\.([A-Za-z0-9]+)$', 1) WHEN 'ts' THEN 0.9 WHEN 'rs' THEN 0.95 WHEN 'py' THEN 0.8 WHEN 'go' THEN 0.85 ELSE 0.5 END * 0.1 + CASE WHEN json_extract_string(data, '$.auto') = 'true' THEN 0.95 ELSE 0.5 END * 0.15, 6)"""


@query("x_fix_confidence", f"SELECT id, {_CONFIDENCE} AS confidence FROM diagnostics JOIN (SELECT id, data FROM sample_diagnostics) USING (id)", True)
def _(spark, d):
    return scoring.fix_confidence(diags(spark, d), F.col("message"), F.coalesce(F.get_json_object("data", "$.auto") == "true", F.lit(False))).select("id", "confidence")


@query("x_routed", f", c AS (SELECT id, {_CONFIDENCE} AS c FROM diagnostics JOIN (SELECT id, data FROM sample_diagnostics) USING (id)) SELECT CASE WHEN c >= 0.8 THEN 'apply' WHEN c >= 0.8 * 0.7 THEN 'confirm' ELSE 'reject' END AS route, CASE WHEN c >= 0.9 THEN 'Certain' WHEN c >= 0.7 THEN 'Probable' WHEN c >= 0.5 THEN 'Possible' ELSE 'Uncertain' END AS bucket, count(*) AS n FROM c GROUP BY 1, 2", True)
def _(spark, d):
    c = scoring.fix_confidence(diags(spark, d), F.col("message"), F.coalesce(F.get_json_object("data", "$.auto") == "true", F.lit(False)))
    return c.groupBy(scoring.routed(F.col("confidence"), 0.8).alias("route"), scoring.confidence_bucket(F.col("confidence")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("x_verify_complexity", """SELECT id, least(1.0, round(CASE WHEN regexp_matches(lower(message), 'type|interface') THEN 0.3 ELSE 0 END + CASE WHEN regexp_matches(lower(message), 'async|await') THEN 0.2 ELSE 0 END + CASE WHEN regexp_matches(lower(message), 'generic|template') THEN 0.4 ELSE 0 END
 + CASE WHEN regexp_matches(lower(message), 'undefined|not found') THEN 0.1 ELSE 0 END + CASE WHEN regexp_matches(lower(message), 'semicolon|syntax') THEN 0.05 ELSE 0 END + CASE regexp_extract(file, '\\.([A-Za-z0-9]+)$', 1) WHEN 'ts' THEN 0.1 WHEN 'tsx' THEN 0.1 WHEN 'rs' THEN 0.15 WHEN 'cpp' THEN 0.2 ELSE 0 END, 6)) AS complexity FROM diagnostics""", True)
def _(spark, d):
    return diags(spark, d).select("id", scoring.verify_complexity(F.col("message"), F.col("file")).alias("complexity"))


_SYNTAX = "(contains(message, 'unexpected token') OR (contains(message, 'expected') AND (contains(message, ''';''') OR contains(message, '''}''') OR contains(message, ''')'''))) OR contains(message, 'unterminated'))"
_MISMATCH = "((contains(message, 'expected') AND contains(message, 'found')) OR contains(message, 'type mismatch') OR contains(message, 'cannot be assigned to'))"


@query("x_message_scores", f""", c AS (SELECT id, message, lower(message) AS m, code, CASE WHEN {_SYNTAX} THEN 'S' WHEN {_MISMATCH} THEN 'T' WHEN regexp_matches(message, 'cannot find|not found|unresolved import|module not found') THEN 'I' ELSE 'U' END AS k, {_SYNTAX} OR {_MISMATCH} AS plain FROM diagnostics)
 SELECT id, CASE k WHEN 'S' THEN CASE WHEN regexp_matches(message, 'missing|expected') THEN 1 ELSE 2 END WHEN 'I' THEN 2 WHEN 'T' THEN CASE WHEN contains(message, 'cannot be assigned') THEN 3 ELSE 4 END ELSE 6 END AS complexity,
  least(1.0, 0.7 + CASE WHEN length(message) > 50 THEN 0.1 ELSE 0 END + CASE WHEN code IS NOT NULL THEN 0.1 ELSE 0 END + CASE WHEN plain THEN 0.1 ELSE 0 END)::DOUBLE AS confidence,
  CASE WHEN regexp_matches(m, 'type|cannot assign|incompatible') THEN 1.0 ELSE 0.5 END AS type_error, CASE WHEN regexp_matches(m, 'cannot find|import|module') THEN 1.0 ELSE 0.3 END AS import_error, CASE WHEN regexp_matches(m, 'undefined|not defined|variable') THEN 1.0 ELSE 0.4 END AS variable_error,
  CASE WHEN regexp_matches(m, 'function|method|call') THEN 1.0 ELSE 0.5 END AS function_error, CASE WHEN regexp_matches(m, 'class|struct|interface') THEN 1.0 ELSE 0.4 END AS class_error FROM c""", True)
def _(spark, d):
    m = F.col("message")
    c = scoring.message_category(m)
    return diags(spark, d).select("id", scoring.message_complexity(c, m).alias("complexity"), F.round(scoring.message_confidence(m, F.col("code").isNotNull()), 6).alias("confidence"), *(v.alias(k) for k, v in scoring.type_relevance(m).items()))


@query("x_proximity", """SELECT id, CASE WHEN abs(line - 300) <= 100 THEN 1.0 - abs(line - 300) / 100.0 * 0.5 ELSE 0.5 END AS linear, CASE WHEN abs(line - 300) <= 3 THEN 1.0 WHEN abs(line - 300) <= 10 THEN 0.8 WHEN abs(line - 300) <= 30 THEN 0.6 WHEN abs(line - 300) <= 50 THEN 0.4 ELSE 0.2 END AS stepped, CASE WHEN line < 300 THEN 1.1 WHEN line = 300 THEN 1.0 ELSE 0.9 END AS factor FROM diagnostics""", True)
def _(spark, d):
    line, at = F.col("line"), F.lit(300)
    return diags(spark, d).select("id", scoring.linear_proximity(line, at, 100).alias("linear"), scoring.stepped_proximity(line, at).alias("stepped"), scoring.direction_factor(line, at).alias("factor"))


# ---- repositories and teams


@query("j_cross_repo", """, r AS (SELECT id, severity, code, regexp_extract(file, '([^/]*)$', 1) AS name, CASE WHEN regexp_matches(file, 'src/[^/]*/') THEN regexp_extract(file, 'src/([^/]*)/', 1) ELSE 'root' END AS repo, regexp_matches(message, 'type|Type|interface|Interface|struct|Struct') AND regexp_matches(message, 'mismatch|incompatible|expected|found') AS t, regexp_matches(message, 'api|API|endpoint|route|contract|schema') AS a FROM diagnostics),
 g AS (SELECT code, name, repo, t, a, count(*) AS n FROM r GROUP BY ALL),
 x AS (SELECT a.code, a.name, a.repo, a.t, a.a, b.n, CASE WHEN a.code = b.code THEN 1 WHEN a.t AND b.t THEN 2 WHEN a.a OR b.a THEN 3 WHEN a.name = b.name THEN 4 END AS k FROM g a JOIN g b ON a.repo <> b.repo),
 c AS (SELECT code, name, repo, t, a, coalesce(sum(n) FILTER (k = 1), 0) AS k1, coalesce(sum(n) FILTER (k = 2), 0) AS k2, coalesce(sum(n) FILTER (k = 3), 0) AS k3, coalesce(sum(n) FILTER (k = 4), 0) AS k4 FROM x GROUP BY ALL)
 SELECT r.id, r.severity, r.repo, CAST(k1 AS BIGINT) AS same_pattern, CAST(k2 AS BIGINT) AS type_mismatch, CAST(k3 AS BIGINT) AS api_violation, CAST(k4 AS BIGINT) AS similar_code FROM r JOIN c ON r.code IS NOT DISTINCT FROM c.code AND r.name IS NOT DISTINCT FROM c.name AND r.repo = c.repo AND r.t = c.t AND r.a = c.a""", True)
def _(spark, d):
    return multirepo.cross_repo_relations(diags(spark, d).withColumn("repository", X.project_of(F.col("file"))), "repository")


@query("j_cross_repo_impact", SQL["j_cross_repo"].replace(" SELECT r.id, r.severity, r.repo,", ", o AS (SELECT r.id, r.severity, r.repo,").removeprefix(VIEWS) + """) SELECT id, repo, same_pattern + type_mismatch + api_violation + similar_code AS related,
 round(least(1.0, CASE severity WHEN 'Error' THEN 0.5 WHEN 'Warning' THEN 0.3 WHEN 'Information' THEN 0.1 ELSE 0.05 END + least((same_pattern + type_mismatch + api_violation + similar_code) * 0.1, 0.3) + same_pattern * 0.02 + type_mismatch * 0.1 + api_violation * 0.15 + similar_code * 0.02), 6) AS impact FROM o""", True)
def _(spark, d):
    return multirepo.cross_repo_impact(multirepo.cross_repo_relations(diags(spark, d).withColumn("repository", X.project_of(F.col("file"))), "repository"))


_TAGS = "t AS (SELECT DISTINCT id AS repository_id, unnest(json_extract_string(tags, '$[*]')) AS item FROM repositories)"


@query("j_shared_items", f"WITH {_TAGS}, s AS (SELECT item, count(*) AS repositories, round(least(sqrt(count(*)) / 10, 1.0), 9) AS impact FROM t GROUP BY 1) SELECT * FROM s WHERE repositories > 1 AND impact >= 0.1")
def _(spark, d):
    return multirepo.shared_items(multirepo.tags_of(table(spark, d, "repositories")))


@query("j_related", """WITH m AS (SELECT monorepo_id, count(*) AS m FROM repositories WHERE monorepo_id IS NOT NULL GROUP BY 1), l AS (SELECT primary_language, count(*) AS l FROM repositories WHERE primary_language IS NOT NULL GROUP BY 1)
 SELECT id AS repository_id, 'monorepo_sibling' AS kind, monorepo_id AS group_id, m - 1 AS links, 0.8 AS strength FROM repositories JOIN m USING (monorepo_id) WHERE m > 1
 UNION ALL SELECT a.id, 'language_similarity', a.primary_language, count(*), 0.09 FROM repositories a JOIN repositories b ON a.primary_language = b.primary_language AND a.id <> b.id AND (a.monorepo_id IS NULL OR b.monorepo_id IS NULL OR a.monorepo_id <> b.monorepo_id) GROUP BY 1, 2, 3""")
def _(spark, d):
    return multirepo.related_repositories(table(spark, d, "repositories"))


@query("j_repository_impact", f"""WITH {_TAGS}, w AS (SELECT DISTINCT id AS repository_id, unnest(string_split(name, '-')) AS item FROM repositories WHERE name IS NOT NULL), rel AS ({SQL["j_related"]}), ri AS (SELECT repository_id, least(sum(links * strength), 1.0) AS r FROM rel GROUP BY 1),
 sd AS (SELECT item, round(least(sqrt(count(*)) / 10, 1.0), 9) AS impact FROM t GROUP BY 1 HAVING count(*) > 1), st AS (SELECT item, round(least(sqrt(count(*)) / 5, 1.0), 9) AS impact FROM w GROUP BY 1 HAVING count(*) > 1),
 di AS (SELECT repository_id, least(sum(impact), 1.0) AS d FROM t JOIN sd USING (item) WHERE impact >= 0.1 GROUP BY 1), ti AS (SELECT repository_id, least(sum(impact), 1.0) AS t FROM w JOIN st USING (item) WHERE impact >= 0.1 GROUP BY 1)
 SELECT id AS repository_id, round(coalesce(r, 0), 6) AS relation_impact, round(coalesce(d, 0), 6) AS dependency_impact, round(coalesce(t, 0), 6) AS type_impact, round(round(coalesce(r, 0), 6) * 0.3 + round(coalesce(d, 0), 6) * 0.4 + round(coalesce(t, 0), 6) * 0.3, 6) AS overall_impact
 FROM repositories LEFT JOIN ri ON ri.repository_id = id LEFT JOIN di ON di.repository_id = id LEFT JOIN ti ON ti.repository_id = id""")
def _(spark, d):
    r = table(spark, d, "repositories")
    words = r.where("name IS NOT NULL").select(F.col("id").alias("repository_id"), F.explode(F.split("name", "-")).alias("item"))
    return multirepo.repository_impact(r, multirepo.related_repositories(r), multirepo.tags_of(r), words)


@query("j_foreign_uses", f"WITH {_TAGS}, w AS (SELECT id AS repository_id, unnest(string_split(name, '-')) AS type_name FROM repositories WHERE name IS NOT NULL), u AS (SELECT type_name, repository_id, count(*) AS n FROM w GROUP BY 1, 2), s AS (SELECT type_name, sum(n) AS a FROM u GROUP BY 1) SELECT t.repository_id, t.item AS type_name, CAST(s.a - coalesce(u.n, 0) AS BIGINT) AS uses_elsewhere FROM t JOIN s ON t.item = s.type_name LEFT JOIN u ON u.type_name = t.item AND u.repository_id = t.repository_id WHERE s.a - coalesce(u.n, 0) > 0")
def _(spark, d):
    r = table(spark, d, "repositories")
    uses = r.where("name IS NOT NULL").select(F.col("id").alias("repository_id"), F.explode(F.split("name", "-")).alias("type_name"))
    return multirepo.foreign_uses(multirepo.tags_of(r).withColumnRenamed("item", "type_name"), uses)


@query("j_lines_naming", "WITH k AS (SELECT DISTINCT unnest(json_extract_string(tags, '$[*]')) AS name FROM repositories), w AS (SELECT DISTINCT id AS line_id, unnest(regexp_extract_all(message, '([A-Za-z_]\\w*)', 1)) AS name FROM sample_diagnostics) SELECT line_id, name FROM w JOIN k USING (name)")
def _(spark, d):
    lines = table(spark, d, "sample_diagnostics").select(F.col("id").alias("line_id"), F.col("message").alias("text"))
    return multirepo.lines_naming(lines, multirepo.tags_of(table(spark, d, "repositories")).select(F.col("item").alias("name"))).select("line_id", "name")


@query("j_imports", f"""WITH {_TAGS}, m AS (SELECT r.id AS repository_id, r.monorepo_id AS workspace, unnest(string_split(name, '-')) AS module FROM repositories r WHERE name IS NOT NULL), i AS (SELECT t.repository_id, r.monorepo_id AS workspace, t.item AS module FROM t JOIN repositories r ON r.id = t.repository_id),
 l AS (SELECT DISTINCT repository_id, module FROM m), s AS (SELECT workspace, module, min(repository_id) AS s FROM m GROUP BY 1, 2), o AS (SELECT module, min(repository_id) AS o FROM m GROUP BY 1)
 SELECT i.repository_id, i.module, CASE WHEN l.module IS NOT NULL THEN 'local' WHEN s.s IS NOT NULL THEN 'workspace' WHEN o.o IS NOT NULL THEN 'external' ELSE 'unresolved' END AS kind, CASE WHEN l.module IS NOT NULL THEN i.repository_id ELSE coalesce(s.s, o.o) END AS target
 FROM i LEFT JOIN l ON i.repository_id = l.repository_id AND i.module = l.module LEFT JOIN s ON i.workspace = s.workspace AND i.module = s.module LEFT JOIN o ON i.module = o.module""")
def _(spark, d):
    r = table(spark, d, "repositories")
    modules = r.where("name IS NOT NULL").select(F.col("id").alias("repository_id"), F.col("monorepo_id").alias("workspace"), F.explode(F.split("name", "-")).alias("module"))
    imports = multirepo.tags_of(r).join(r.select(F.col("id").alias("repository_id"), F.col("monorepo_id").alias("workspace")), "repository_id").withColumnRenamed("item", "module")
    return multirepo.resolved_imports(imports, modules)


@query("j_neighbours", """, s AS (SELECT id, file, list_distinct(list_concat(regexp_extract_all(message, '''([a-zA-Z_][a-zA-Z0-9_]*)''', 1), regexp_extract_all(message, '`([a-zA-Z_][a-zA-Z0-9_]*)`', 1))) AS sy FROM diagnostics), u AS (SELECT DISTINCT file, unnest(sy) AS name FROM s), f AS (SELECT name, min(file) AS dependency FROM u GROUP BY 1),
 e AS (SELECT file, dependency, list(DISTINCT name) AS names FROM u JOIN f USING (name) WHERE file <> dependency GROUP BY 1, 2)
 SELECT s.id, 'imports' AS direction, e.dependency AS neighbour FROM s JOIN e ON s.file = e.file WHERE len(list_intersect(s.sy, e.names)) > 0 UNION ALL SELECT s.id, 'imported_by', e.file FROM s JOIN e ON s.file = e.dependency WHERE len(list_intersect(s.sy, e.names)) > 0""", True)
def _(spark, d):
    s = diags(spark, d).select("id", "file", X.identifiers(F.col("message")).alias("symbols"))
    defs = s.select(F.explode("symbols").alias("name"), "file").groupBy("name").agg(F.min("file").alias("dependency"))
    edges = s.select("file", F.explode("symbols").alias("name")).join(defs, "name").where("file <> dependency").groupBy("file", "dependency").agg(F.collect_set("name").alias("symbols"))
    return multirepo.dependency_neighbours(s, edges)


@query("t_active", "SELECT id, name FROM team_members WHERE active")
def _(spark, d):
    return team.active_by_name(table(spark, d, "team_members")).select("id", "name")


@query("t_tagged", "SELECT id FROM repositories WHERE active AND list_contains(json_extract_string(tags, '$[*]'), 'token')")
def _(spark, d):
    return team.tagged(table(spark, d, "repositories"), "token").select("id")


@query("t_assignments", r"SELECT DISTINCT id, priority, assigned_at FROM diagnostic_assignments WHERE lower(regexp_replace(assignee_id, '^[\s ]+|[\s ]+$', '', 'g')) = 'mem-0081' AND status = 'open'")
def _(spark, d):
    return team.assignments_of(table(spark, d, "diagnostic_assignments"), "mem-0081", "open").select("id", "priority", "assigned_at").distinct()


@query("t_latest", "SELECT assignment_id, max(seq) AS seq FROM assignment_history GROUP BY 1")
def _(spark, d):
    return team.latest_by(table(spark, d, "assignment_history"), ["assignment_id"], ["seq", "id"]).select("assignment_id", "seq")


_KEY = r"lower(regexp_replace({0}, '^[\s ]+|[\s ]+$', '', 'g'))"


@query("t_workload", f"""WITH a AS (SELECT DISTINCT ON (id) * FROM diagnostic_assignments), p AS (SELECT {_KEY.format("assignee_id")} AS m, count(*) AS assigned, count(completed_at) AS resolved, round(avg(completed_at - assigned_at), 3) AS s FROM a GROUP BY 1)
 SELECT t.id, t.name, coalesce(p.assigned, 0) AS assigned, coalesce(p.resolved, 0) AS resolved, p.s AS avg_seconds FROM team_members t LEFT JOIN p ON p.m = {_KEY.format("t.id")}""")
def _(spark, d):
    return team.workload(table(spark, d, "team_members"), table(spark, d, "diagnostic_assignments"))


@query("t_unknown_assignees", f"SELECT DISTINCT id FROM diagnostic_assignments WHERE {_KEY.format('assignee_id')} NOT IN ('', 'unassigned', 'none', 'n/a') AND {_KEY.format('assignee_id')} NOT IN (SELECT {_KEY.format('id')} FROM team_members WHERE active)")
def _(spark, d):
    return team.unknown_assignees(table(spark, d, "diagnostic_assignments"), table(spark, d, "team_members")).select("id").distinct()


@query("t_status_events", r"""WITH e AS (SELECT DISTINCT seq, CASE WHEN abs(timestamp) >= 100000000000 THEN timestamp // 1000 ELSE timestamp END AS tm, lower(regexp_replace(trim(new_value), '[ -]', '_', 'g')) AS status FROM assignment_history WHERE timestamp IS NOT NULL AND new_value IS NOT NULL AND lower(regexp_replace(action, '[^A-Za-z]', '', 'g')) = 'statuschanged')
 SELECT strftime(make_timestamp(tm * 1000000), '%Y-%m-%d') AS day, status, count(*) AS changes FROM e GROUP BY 1, 2""")
def _(spark, d):
    return team.status_events(table(spark, d, "assignment_history"))


# ---- training sets


def _examples(spark, d):
    return table(spark, d, "ml_training_examples")


_META = "WITH e AS (SELECT *, json_extract_string(metadata, '$.language') AS language, CAST(json_extract_string(metadata, '$.confidence') AS DOUBLE) AS c, CAST(json_extract_string(metadata, '$.diagnostic_count') AS BIGINT) AS n FROM ml_training_examples)"


@query("m_statistics", _META + """ SELECT 'language' AS statistic, coalesce(language, 'unknown') AS key, count(*) AS n FROM e GROUP BY 2 UNION ALL SELECT 'confidence', CASE WHEN c IS NULL THEN 'unknown' WHEN c >= 0.9 THEN 'Certain' WHEN c >= 0.7 THEN 'Probable' WHEN c >= 0.5 THEN 'Possible' ELSE 'Uncertain' END, count(*) FROM e GROUP BY 2 UNION ALL SELECT 'format', format, count(*) FROM e GROUP BY 2""")
def _(spark, d):
    return training.dataset_statistics(_examples(spark, d))


@query("m_filtered", _META + " SELECT example_id FROM e WHERE c >= 0.7 AND language = 'rust'")
def _(spark, d):
    return training.filtered(_examples(spark, d), 0.7, "rust").select("example_id")


@query("m_annotations", _META + " SELECT CASE WHEN n = 0 THEN 'Perfect' WHEN c > 0.9 THEN 'Good' WHEN c > 0.7 THEN 'Acceptable' WHEN c > 0.5 THEN 'Poor' ELSE 'Incorrect' END AS quality, count(*) AS n, round(avg(c), 6) AS avg_confidence FROM e WHERE c IS NOT NULL GROUP BY 1")
def _(spark, d):
    return training.annotation_report(_examples(spark, d))


_PR = _META + """, ch AS (SELECT *, coalesce(len(messages) > 0, false) AND prompt IS NULL AND completion IS NULL AS chat FROM e WHERE example_id IS NOT NULL),
 pr AS (SELECT example_id, language, CASE WHEN chat THEN list_filter(messages, lambda m: lower(trim(m.role)) = 'user')[-1].content ELSE prompt END AS prompt, CASE WHEN chat THEN list_filter(messages, lambda m: lower(trim(m.role)) = 'assistant')[-1].content ELSE completion END AS answer FROM ch)"""
_BL = _PR + r""", bl AS (SELECT example_id AS code_id, language, prompt, list_filter(regexp_extract_all(answer, '(?s)```[\w+#.-]*[ \t]*\r?\n(.*?)(?:```|\z)', 1), lambda b: trim(b) <> '') AS blocks FROM pr),
 cd AS (SELECT code_id, language, prompt, array_to_string(blocks, chr(10)) AS code FROM bl WHERE len(blocks) > 0), ln AS (SELECT code_id, language, prompt, len(string_split(code, chr(10))) AS lines, unnest(string_split(code, chr(10))) AS line, CAST(generate_subscripts(string_split(code, chr(10)), 1) - 1 AS INT) AS line_no FROM cd)"""


@query("m_lines", _PR + """ SELECT example_id, '{"prompt":' || to_json(prompt) || ',"completion":' || to_json(answer) || '}' AS line FROM pr WHERE prompt IS NOT NULL AND answer IS NOT NULL""")
def _(spark, d):
    return training.as_lines(_examples(spark, d))


@query("m_chat", _PR + """ SELECT example_id, '{"messages":[{"role":"system","content":"You fix code problems."},{"role":"user","content":' || to_json(prompt) || '},{"role":"assistant","content":' || to_json(answer) || '}]}' AS line FROM pr WHERE prompt IS NOT NULL AND answer IS NOT NULL""")
def _(spark, d):
    return training.as_chat(_examples(spark, d), "You fix code problems.")


@query("m_labelled", _PR + " SELECT example_id, prompt AS text, answer AS label FROM pr WHERE prompt IS NOT NULL AND answer IS NOT NULL")
def _(spark, d):
    return training.as_labelled(_examples(spark, d))


@query("m_prompts", _PR + r""" SELECT example_id, 'Fix the following ' || coalesce(language, 'unknown') || ' code that has these diagnostics:' || chr(10) || chr(10) || 'Diagnostics:' || chr(10) || '- Line 7: Error - broken' || chr(10) || chr(10) || 'Code:' || chr(10) || '```' || coalesce(language, 'unknown') || chr(10) || answer || chr(10) || '```' || chr(10) AS prompt_text,
 'Fix: mended' || chr(10) || chr(10) || '```' || coalesce(language, 'unknown') || chr(10) || answer || chr(10) || '```' AS completion_text FROM pr WHERE answer IS NOT NULL""")
def _(spark, d):
    e = training.pairs(training.with_metadata(_examples(spark, d)), "language").where("answer IS NOT NULL")
    lang = F.coalesce("language", F.lit("unknown"))
    one = F.array(F.struct(F.lit(7).alias("line"), F.lit("Error").alias("severity"), F.lit("broken").alias("message")))
    return e.select("example_id", training.prompt_text(lang, one, F.col("answer"), F.lit("")).alias("prompt_text"), training.completion_text(lang, F.lit("mended"), F.col("answer")).alias("completion_text"))


def _blocks(spark, d):
    """The code blocks of every answer, of either format."""
    e = training.pairs(training.with_metadata(_examples(spark, d)), "language")
    return e.select(F.col("example_id").alias("code_id"), "language", "prompt", training.code_blocks(F.col("answer")).alias("blocks"))


def _code(spark, d):
    """All code of each answer: its blocks, one after the other."""
    return _blocks(spark, d).where("size(blocks) > 0").select("code_id", "language", "prompt", F.array_join("blocks", "\n").alias("code"))


_ERRORS = ", ".join(f"({i}, '{n}', '{lv}', '{lg}', '{a.replace(chr(39), chr(39) * 2)}', '{b.replace(chr(39), chr(39) * 2)}', '{m.replace(chr(39), chr(39) * 2)}')" for i, (n, lv, lg, a, b, m) in enumerate([*training.PATTERNS, *training.ERRORS]))


@query("m_injected", _BL + f""", er AS (SELECT * FROM (VALUES {_ERRORS}) t(k, error, difficulty, lang, old, new, message)), c AS (SELECT DISTINCT code_id, language, unnest(blocks) AS code FROM bl),
 tr AS (SELECT code_id, code, list({{'error': error, 'difficulty': difficulty, 'old': old, 'new': new, 'message': message}} ORDER BY k) AS t FROM c JOIN er ON language = lang AND contains(code, old) GROUP BY 1, 2),
 pk AS (SELECT code_id, code, t[1 + (16 * (strpos('0123456789abcdef', md5(CAST(code_id AS VARCHAR))[1]) - 1) + strpos('0123456789abcdef', md5(CAST(code_id AS VARCHAR))[2]) - 1) % len(t)] AS x FROM tr)
 SELECT code_id, x.error AS error, x.difficulty AS difficulty, CAST(len(string_split(substr(code, 1, strpos(code, x.old) - 1), chr(10))) AS INT) AS line, x.message AS message, replace(code, x.old, x.new) AS broken FROM pk""")
def _(spark, d):
    return training.injected(_blocks(spark, d).select("code_id", "language", F.explode("blocks").alias("code")).distinct())


@query("m_types", _BL + r""" SELECT code_id, line_no, unnest(regexp_extract_all(line, '\b(?:class|struct|enum|trait|interface|type)\s+([A-Z]\w*)', 1)) AS type_name FROM ln""")
def _(spark, d):
    return multirepo.types_of(_code(spark, d))


_IM = r"""CASE WHEN language IN ('typescript', 'javascript') THEN regexp_extract(line, '(?:import\s+[^''"]*|import\(|require\(|from\s+)[''"]([^''"]+)[''"]', 1) WHEN language = 'python' THEN regexp_extract(line, '^\s*from\s+([\w.]+)\s+import', 1) || regexp_extract(line, '^\s*import\s+([\w.]+)', 1)
  WHEN language = 'rust' THEN regexp_extract(line, '^\s*use\s+([\w:]+)', 1) WHEN language = 'go' THEN regexp_extract(line, '^\s*(?:import\s+)?"([^"]+)"', 1) END"""


@query("m_imports", _BL + f" SELECT code_id, line_no, {_IM} AS module FROM ln WHERE {_IM} <> ''")
def _(spark, d):
    return multirepo.imports_of(_code(spark, d))  # lines are counted over all blocks


_EL = _BL + r""", df AS (SELECT code_id, prompt, lines, line_no, CASE language WHEN 'typescript' THEN regexp_extract(line, '\b(function|class|interface)\s+([A-Za-z_$][\w$]*)', ['w', 'n']) WHEN 'python' THEN regexp_extract(line, '^\s*(def|class)\s+([A-Za-z_]\w*)', ['w', 'n'])
   WHEN 'rust' THEN regexp_extract(line, '\b(fn|struct|enum|trait|impl)\s+([A-Za-z_]\w*)', ['w', 'n']) WHEN 'go' THEN regexp_extract(line, '\b(func|type)\s+(?:\([^)]*\)\s*)?([A-Za-z_]\w*)', ['w', 'n']) END AS m FROM ln),
 ve AS (SELECT DISTINCT code_id, prompt, lines, line_no, unnest(CASE language WHEN 'typescript' THEN regexp_extract_all(line, '\b(?:const|let|var)\s+([A-Za-z_$][\w$]*)', 1) WHEN 'python' THEN regexp_extract_all(line, '^\s*([A-Za-z_][\w.]*)\s*=[^=]', 1) WHEN 'rust' THEN regexp_extract_all(line, '\blet\s+(?:mut\s+)?([a-z_]\w*)', 1) WHEN 'go' THEN regexp_extract_all(line, '([A-Za-z_]\w*)\s*:=', 1) END) AS name FROM ln),
 ca AS (SELECT DISTINCT code_id, prompt, lines, line_no, unnest(CASE WHEN language IN ('typescript', 'python', 'rust', 'go') THEN regexp_extract_all(line, '([A-Za-z_]\w*)\(', 1) END) AS name FROM ln),
 el AS (SELECT code_id, prompt, lines, line_no, CASE WHEN m.w IN ('function', 'def', 'fn', 'func') THEN 'function' WHEN m.w IN ('class', 'struct', 'impl') THEN 'class' ELSE 'type' END AS kind, m.n AS name FROM df WHERE m.n <> ''
  UNION ALL SELECT code_id, prompt, lines, line_no, 'variable', name FROM ve UNION ALL SELECT code_id, prompt, lines, line_no, 'call', name FROM ca WHERE name NOT IN ('if', 'for', 'while', 'switch', 'match', 'return', 'catch', 'func', 'fn', 'def', 'function')
   AND NOT EXISTS (SELECT 1 FROM df WHERE df.code_id = ca.code_id AND df.line_no = ca.line_no AND df.m.n = ca.name)
  UNION ALL SELECT code_id, prompt, lines, line_no, 'import', """ + _IM + " FROM ln WHERE " + _IM + r""" <> ''),
 rl AS (SELECT code_id, kind, name, line_no, lines, contains(prompt, name) AS nm, prompt, line_no = min(line_no) OVER (PARTITION BY code_id) AS inside, line_no - min(line_no) OVER (PARTITION BY code_id) <= 3 AS near FROM el WHERE prompt IS NOT NULL),
 re AS (SELECT code_id, kind, name, line_no, round(least(1.0, round(CASE kind WHEN 'function' THEN 1.0 * CASE WHEN nm THEN 1.5 ELSE 1.0 END * CASE WHEN inside THEN 1.3 ELSE 1.0 END WHEN 'class' THEN 0.8 * CASE WHEN nm THEN 1.4 ELSE 1.0 END * CASE WHEN regexp_matches(prompt, 'type|interface|struct') THEN 1.2 ELSE 1.0 END
   WHEN 'type' THEN 0.7 * CASE WHEN nm THEN 1.8 WHEN contains(prompt, 'type') THEN 1.3 ELSE 1.0 END WHEN 'import' THEN 0.6 * CASE WHEN nm THEN 1.3 ELSE 1.0 END WHEN 'variable' THEN 0.5 * CASE WHEN nm THEN 1.4 WHEN near THEN 1.2 ELSE 1.0 END ELSE 0.4 * CASE WHEN nm THEN 1.3 ELSE 1.0 END END, 6)), 6)::DOUBLE AS priority,
  CAST(CASE kind WHEN 'function' THEN 50 WHEN 'class' THEN 30 WHEN 'type' THEN 25 WHEN 'call' THEN 15 WHEN 'import' THEN 10 ELSE 5 END + CASE WHEN kind IN ('function', 'class') THEN floor(lines * 4.0) WHEN kind = 'type' THEN floor(lines * 2.0) ELSE 0 END AS BIGINT) AS tokens FROM rl)"""


def _elements(spark, d):
    """The elements of each answer's code, ranked for the diagnostics in its prompt."""
    from pyspark.sql import Window

    from glintflow.functions.code import elements

    code = _code(spark, d).where("prompt IS NOT NULL")
    first = F.min("line_no").over(Window.partitionBy("code_id"))  # the elements of one answer
    e = elements(code).withColumn("first", first).join(code.select("code_id", "prompt", F.size(F.split("code", "\n")).alias("lines")), "code_id")
    rel = scoring.element_relevance(F.col("kind"), F.col("name"), F.col("prompt"), F.col("line_no") == F.col("first"), F.col("line_no") - F.col("first") <= 3)
    return e.select("code_id", "kind", "name", "line_no", F.round(rel, 6).alias("priority"), scoring.element_tokens(F.col("kind"), F.col("lines")).alias("tokens"))


@query("x_elements", _EL + " SELECT code_id, kind, name, line_no FROM el")
def _(spark, d):
    from glintflow.functions.code import elements

    return elements(_code(spark, d))


@query("x_context_elements", _EL + " SELECT code_id, kind, name, line_no, priority, tokens FROM re")
def _(spark, d):
    return _elements(spark, d)


@query("x_thresholds", _EL + " SELECT code_id, kind, name, line_no FROM re WHERE priority >= 0.8 AND tokens <= 60")
def _(spark, d):
    return scoring.within_thresholds(_elements(spark, d), 0.8, 60).select("code_id", "kind", "name", "line_no")


_EID = "kind || ':' || name || ':' || CAST(line_no AS VARCHAR)"


@query("x_token_budget", _EL.replace("WITH", "WITH RECURSIVE", 1) + f""", od AS (SELECT code_id, {_EID} AS id, priority, tokens, CASE WHEN priority >= 0.8 THEN 0 WHEN priority >= 0.4 THEN 1 ELSE 2 END AS tier, row_number() OVER (PARTITION BY code_id ORDER BY CASE WHEN priority >= 0.8 THEN 0 WHEN priority >= 0.4 THEN 1 ELSE 2 END, -priority, {_EID}, tokens) AS i FROM re),
 bu(code_id, i, used, took) AS (SELECT DISTINCT code_id, CAST(0 AS BIGINT), CAST(0 AS BIGINT), false FROM od UNION ALL SELECT b.code_id, b.i + 1, CASE WHEN b.used + o.tokens <= 120 THEN b.used + o.tokens ELSE b.used END, b.used + o.tokens <= 120 FROM bu b JOIN od o ON o.code_id = b.code_id AND o.i = b.i + 1)
 SELECT o.code_id, o.id, CASE WHEN NOT b.took THEN 'excluded' WHEN o.tier = 0 THEN 'essential' ELSE 'supplementary' END AS state, max(b.used) OVER (PARTITION BY o.code_id) AS tokens_used FROM od o JOIN bu b ON o.code_id = b.code_id AND o.i = b.i""")
def _(spark, d):
    e = _elements(spark, d)
    return scoring.budgeted(e.select("code_id", F.concat_ws(":", "kind", "name", F.col("line_no").cast("string")).alias("id"), "priority", "tokens"), "code_id", 120)


@query("x_context_relevance", _EL + " SELECT code_id, round(least(1.0, max(CASE WHEN kind = 'function' THEN 0.3 ELSE 0 END) + max(CASE WHEN kind = 'class' THEN 0.2 ELSE 0 END) + max(CASE WHEN kind = 'import' THEN 0.1 ELSE 0 END) + max(CASE WHEN kind = 'type' THEN 0.15 ELSE 0 END) + max(CASE WHEN kind = 'variable' THEN 0.15 ELSE 0 END) + max(CASE WHEN kind = 'call' THEN 0.1 ELSE 0 END)), 6)::DOUBLE AS relevance FROM el GROUP BY 1")
def _(spark, d):
    from glintflow.functions.code import elements

    has = {"function": "function", "class": "class", "imports": "import", "types": "type", "variables": "variable", "calls": "call"}
    e = elements(_code(spark, d)).groupBy("code_id").agg(*(F.bool_or(F.col("kind") == k).alias(p) for p, k in has.items()))
    return e.select("code_id", scoring.context_relevance({p: F.col(p) for p in has}).alias("relevance"))


@query("m_adjustment", _META + " SELECT example_id, round(greatest(0.0, least(1.0, 0.5 + CASE WHEN n % 2 = 0 THEN 0.3 ELSE 0 END + CASE WHEN c > 0.5 THEN 0.2 ELSE 0 END - least(n * 0.05, 0.2) - least(n * 0.1, 0.2))), 6) AS adjustment FROM e WHERE c IS NOT NULL")
def _(spark, d):
    e = training.with_metadata(_examples(spark, d)).where("confidence IS NOT NULL")
    n = F.col("diagnostic_count")
    return e.select("example_id", scoring.verification_adjustment(n % 2 == 0, F.col("confidence") > 0.5, n, n).alias("adjustment"))


# ---- health


def _measured_sql(name: str, where: str = "true") -> str:
    return f"{name} AS (SELECT event_type AS component, avg(value) / 100 AS hit_rate, avg(value) / 10 AS error_rate, count(*) % 2 = 0 AS breaker_open, true AS available, max(value) AS cpu, avg(value) AS memory, avg(value) * 30 AS response_ms FROM events WHERE {where} GROUP BY 1)"


_MEASURED = _measured_sql("m")


def _alerts_sql(measured: str) -> str:
    each = " UNION ALL ".join(f"SELECT component, '{k}' AS metric, {k} AS v, {w} AS w, {c} AS c FROM {measured}" for k, w, c in (("cpu", 70, 90), ("memory", 75, 90), ("error_rate", 5, 10), ("response_ms", 1000, 5000)))
    return f"(SELECT metric || '-' || CASE WHEN v > c THEN 'critical' ELSE 'warning' END || '-' || component AS id, metric FROM ({each}) WHERE v > w)"


def _measured(spark, d, where: str = "true"):
    return table(spark, d, "events").where(where).groupBy(F.col("event_type").alias("component")).agg(
        (F.avg("value") / 100).alias("hit_rate"), (F.avg("value") / 10).alias("error_rate"), (F.count(F.lit(1)) % 2 == 0).alias("breaker_open"), F.lit(True).alias("available"), F.max("value").alias("cpu"), F.avg("value").alias("memory"), (F.avg("value") * 30).alias("response_ms")
    )


_SCORES = f"WITH {_MEASURED}, s AS (SELECT component, 100.0 - CASE WHEN hit_rate < 0.5 THEN 20 ELSE 0 END - CASE WHEN error_rate > 5 THEN 30 ELSE 0 END - CASE WHEN breaker_open THEN 50 ELSE 0 END AS score FROM m)"


@query("h_components", _SCORES + " SELECT component, score, CASE WHEN score >= 90 THEN 'Online' WHEN score >= 70 THEN 'Degraded' ELSE 'Offline' END AS status FROM s")
def _(spark, d):
    return health.component_scores(_measured(spark, d)).select("component", "score", "status")


@query("h_overall", _SCORES + " SELECT (avg(score) + min(score)) / 2 AS overall, CASE WHEN (avg(score) + min(score)) / 2 >= 90 THEN 'Healthy' WHEN (avg(score) + min(score)) / 2 >= 70 THEN 'Warning' WHEN (avg(score) + min(score)) / 2 >= 50 THEN 'Degraded' ELSE 'Critical' END AS health FROM s")
def _(spark, d):
    return health.overall(health.component_scores(_measured(spark, d)))


@query("h_alerts", f"""WITH {_MEASURED}, a AS (SELECT component, 'cpu' AS metric, cpu AS v, 70 AS w, 90 AS c FROM m UNION ALL SELECT component, 'memory', memory, 75, 90 FROM m UNION ALL SELECT component, 'error_rate', error_rate, 5, 10 FROM m UNION ALL SELECT component, 'response_ms', response_ms, 1000, 5000 FROM m)
 SELECT metric || '-' || CASE WHEN v > c THEN 'critical' ELSE 'warning' END || '-' || component AS id, component, metric, CASE WHEN v > c THEN 'critical' ELSE 'warning' END AS severity, round(v, 6) AS value FROM a WHERE v > w""")
def _(spark, d):
    return health.alerts(_measured(spark, d)).withColumn("value", F.round("value", 6))


_HALF = "TIMESTAMP '2024-01-16 00:00:00'"  # alerts of the first half of the month are old


@query("h_merged_alerts", f"WITH {_measured_sql('m1', 'ts < ' + _HALF)}, {_measured_sql('m2', 'ts >= ' + _HALF)}, o AS (SELECT id, 1 AS ts, metric = 'response_ms' AS resolved FROM {_alerts_sql('m1')}), n AS (SELECT id FROM {_alerts_sql('m2')}) SELECT id, CAST(ts AS BIGINT) AS ts, resolved FROM o UNION ALL SELECT id, 2, false FROM n WHERE id NOT IN (SELECT id FROM o WHERE NOT resolved)")
def _(spark, d):
    at = _HALF.replace("TIMESTAMP", "TIMESTAMP_NTZ")
    new = health.alerts(_measured(spark, d, f"ts >= {at}")).select("id", F.lit(2).cast("bigint").alias("ts"))
    old = health.alerts(_measured(spark, d, f"ts < {at}")).select("id", F.lit(1).cast("bigint").alias("ts"), (F.col("metric") == "response_ms").alias("resolved"))
    return health.merged_alerts(old, new)


def _figures(spark, d):
    return _measured(spark, d).select("component", "hit_rate", "error_rate", (F.col("memory") * 30).alias("memory_mb"), (F.col("memory") * 20).alias("avg_millis"))


@query("h_advice", f"""WITH {_MEASURED}, f AS (SELECT hit_rate, error_rate, memory * 30 AS memory_mb, memory * 20 AS avg_millis FROM m) SELECT 'cache' AS component, CASE WHEN hit_rate < 0.5 THEN 'Critical' ELSE 'High' END AS impact, 'Low' AS effort FROM f WHERE hit_rate < 0.7
 UNION ALL SELECT 'processor', CASE WHEN error_rate > 5 THEN 'Critical' ELSE 'High' END, 'Medium' FROM f WHERE error_rate > 2 UNION ALL SELECT 'system', 'Medium', 'High' FROM f WHERE memory_mb > 1024 UNION ALL SELECT 'processing', 'High', 'High' FROM f WHERE avg_millis > 1000""")
def _(spark, d):
    return health.advice(_figures(spark, d))


@query("h_summary", f"WITH {_MEASURED} SELECT round(greatest(0, 100 - CASE WHEN hit_rate < 0.7 THEN (0.7 - hit_rate) * 30 ELSE 0 END - CASE WHEN error_rate > 1 THEN least(error_rate, 10) * 3 ELSE 0 END - CASE WHEN memory * 30 > 512 THEN least((memory * 30 - 512) / 512 * 10, 20) ELSE 0 END), 6) AS score FROM m")
def _(spark, d):
    return health.health_summary(_figures(spark, d))


@query("h_prometheus", _SCORES + """ SELECT 'glintflow_component_health_score{component="' || component || '"} ' || printf('%.1f', score) AS line FROM s""")
def _(spark, d):
    return health.prometheus(health.component_scores(_measured(spark, d)))


# ---- incremental


def _versions(spark, d):
    """Two runs: the files that the later one saw, and those of the earlier one; their spans overlap."""
    s = snaps(spark, d).where("timestamp IS NOT NULL")
    pick = lambda span: s.where(span).groupBy(F.col("file_path").alias("file")).agg(F.max("timestamp").alias("mtime"), F.max_by(F.coalesce("file_hash", F.lit("")), F.struct("timestamp", "id")).alias("hash"))
    return pick("timestamp >= 1710000000"), pick("timestamp < 1716000000")


_STATES = """WITH s AS (SELECT * FROM diagnostic_snapshots WHERE timestamp IS NOT NULL), c AS (SELECT file_path AS file, max(timestamp) AS m, arg_max(coalesce(file_hash, ''), {'t': timestamp, 'i': id}) AS h FROM s WHERE timestamp >= 1710000000 GROUP BY 1),
 p AS (SELECT file_path AS file, max(timestamp) AS m, arg_max(coalesce(file_hash, ''), {'t': timestamp, 'i': id}) AS h FROM s WHERE timestamp < 1716000000 GROUP BY 1),
 x AS (SELECT coalesce(c.file, p.file) AS file, CASE WHEN p.file IS NULL THEN 'added' WHEN c.file IS NULL THEN 'removed' WHEN c.m = p.m THEN 'unchanged' WHEN c.h = p.h THEN 'touched' ELSE 'changed' END AS state FROM c FULL JOIN p ON c.file = p.file)"""


@query("i_changed_files", _STATES + " SELECT file, state FROM x")
def _(spark, d):
    return incremental.changed_files(*_versions(spark, d))


@query("i_statistics", _STATES + " SELECT count(*) AS files, count(*) FILTER (state IN ('unchanged', 'touched')) AS reused, round(count(*) FILTER (state IN ('unchanged', 'touched')) / count(*), 9) AS hit_rate FROM x")
def _(spark, d):
    s = incremental.run_statistics(incremental.changed_files(*_versions(spark, d)))
    return s.withColumn("hit_rate", F.round("hit_rate", 9))


@query("i_merged", _STATES + ", o AS (SELECT id, file_path AS file FROM s) SELECT id, file FROM o WHERE file NOT IN (SELECT file FROM x WHERE state IN ('added', 'changed', 'removed')) UNION ALL SELECT -1, file FROM x WHERE state IN ('added', 'changed')")
def _(spark, d):
    states = incremental.changed_files(*_versions(spark, d))
    old = snaps(spark, d).where("timestamp IS NOT NULL").select("id", F.col("file_path").alias("file"))
    return incremental.merged(states.where("state IN ('added', 'changed')").select(F.lit(-1).cast("bigint").alias("id"), "file"), old, states)


@query("i_cache", "SELECT id FROM diagnostic_snapshots WHERE timestamp > 1725000000 - 2592000 ORDER BY timestamp DESC, id DESC LIMIT 1000")
def _(spark, d):
    return incremental.cached_snapshots(snaps(spark, d), 1_725_000_000, 2_592_000, 1000).select("id")


# ---- readers: the tables' rows put into each dialect and read back


def _raw(spark, d, make):
    s = table(spark, d, "sample_diagnostics")
    return s.select(F.col("id").alias("record"), F.lit("x").alias("source"), make.alias("data"))


_POINT = lambda a, b: F.struct(F.col(a).alias("line"), F.col(b).alias("character"))


@query("r_typescript", "SELECT id AS record, coalesce(file, '') AS file, start_line, end_line, CASE severity WHEN 'Error' THEN 'Error' WHEN 'Warning' THEN 'Warning' WHEN 'Hint' THEN 'Hint' ELSE 'Information' END AS severity, message, code FROM sample_diagnostics")
def _(spark, d):
    cat = F.when(F.col("severity") == "Warning", 0).when(F.col("severity") == "Error", 1).when(F.col("severity") == "Hint", 2).otherwise(3)
    one = F.struct(F.concat(F.lit("file://"), F.col("file")).alias("fileName"), _POINT("start_line", "start_character").alias("start"), _POINT("end_line", "end_character").alias("end"), cat.alias("category"), F.col("message").alias("messageText"), F.col("code"))
    return readers.typescript(_raw(spark, d, F.to_json(F.struct(F.array(one).alias("diagnostics"))))).select("record", "file", "start_line", "end_line", "severity", "message", "code")


@query("r_rust", "SELECT id AS record, coalesce(file, '') AS file, start_line, start_character, CASE severity WHEN 'Error' THEN 'Error' WHEN 'Warning' THEN 'Warning' WHEN 'Hint' THEN 'Hint' ELSE 'Information' END AS severity, message, code, 1 AS related FROM sample_diagnostics")
def _(spark, d):
    level = F.when(F.col("severity") == "Warning", "warning").when(F.col("severity") == "Error", "error").when(F.col("severity") == "Hint", "help").otherwise("note")
    span = F.struct(F.col("file").alias("file_name"), (F.col("start_line") + 1).alias("line_start"), (F.col("end_line") + 1).alias("line_end"), (F.col("start_character") + 1).alias("column_start"), (F.col("end_character") + 1).alias("column_end"), F.lit("here").alias("label"))
    one = F.struct(F.array(span, span).alias("spans"), level.alias("level"), F.col("message"), F.struct(F.col("code")).alias("code"))
    return readers.rust(_raw(spark, d, F.to_json(F.array(one)))).select("record", "file", "start_line", "start_character", "severity", "message", "code", F.size("related").alias("related"))


@query("r_eslint", "SELECT id AS record, coalesce(file, '') AS file, start_line, end_character, CASE severity WHEN 'Error' THEN 'Error' ELSE 'Warning' END AS severity, message, code FROM sample_diagnostics")
def _(spark, d):
    m = F.struct((F.col("start_line") + 1).alias("line"), (F.col("start_character") + 1).alias("column"), (F.col("end_line") + 1).alias("endLine"), (F.col("end_character") + 1).alias("endColumn"), F.when(F.col("severity") == "Error", 2).otherwise(1).alias("severity"), F.col("message"), F.col("code").alias("ruleId"))
    one = F.struct(F.col("file").alias("filePath"), F.array(m).alias("messages"))
    return readers.eslint(_raw(spark, d, F.to_json(F.struct(F.array(one).alias("results"))))).select("record", "file", "start_line", "end_character", "severity", "message", "code")


@query("r_generic", """WITH v AS (SELECT id, CASE WHEN json_valid(diagnostics_json) THEN CAST(diagnostics_json AS JSON) END AS j FROM diagnostic_snapshots), e AS (SELECT id AS record, unnest(json_extract(j, '$[*]')) AS e FROM v WHERE json_type(j) = 'ARRAY')
 SELECT record, json_extract_string(e, '$.source') AS file, CAST(json_extract_string(e, '$.range.start.line') AS INT) AS start_line, json_extract_string(e, '$.severity') AS severity, json_extract_string(e, '$.message') AS message, json_extract_string(e, '$.code') AS code FROM e""")
def _(spark, d):
    raw = snaps(spark, d).select(F.col("id").alias("record"), F.when(F.try_parse_json("diagnostics_json").isNotNull(), F.col("diagnostics_json")).alias("data"))
    return readers.generic(raw).select("record", "file", "start_line", "severity", "message", "code")


@query("r_broken", "SELECT id AS record FROM diagnostic_snapshots WHERE NOT coalesce(json_valid(diagnostics_json), false)")
def _(spark, d):
    return readers.broken(snaps(spark, d).select(F.col("id").alias("record"), F.col("diagnostics_json").alias("data"))).select("record")


@query("r_detected", """SELECT source, CASE WHEN contains(lower(coalesce(source, '')), 'typescript') THEN 'typescript' WHEN regexp_matches(lower(coalesce(source, '')), 'rust|analyzer') THEN 'rust' WHEN contains(lower(coalesce(source, '')), 'eslint') THEN 'eslint' ELSE 'generic' END AS dialect, count(*) AS n FROM sample_diagnostics GROUP BY 1, 2""")
def _(spark, d):
    s = table(spark, d, "sample_diagnostics")
    return s.groupBy("source", readers.detected(F.col("source"), F.lit("{}")).alias("dialect")).agg(F.count(F.lit(1)).alias("n"))


# ---- exports


@query("k_json", """SELECT '{' || concat_ws(',', '"id":' || to_json(id), '"file":' || to_json(file), '"line":' || CAST(line AS VARCHAR), '"severity":' || to_json(severity), '"message":' || to_json(message)) || '}' AS line FROM diagnostics""", True)
def _(spark, d):
    return export.json_lines(diags(spark, d).select("id", "file", "line", "severity", "message"))


@query("k_csv", """SELECT concat_ws(',', id, coalesce(file, 'null'), CAST(line AS VARCHAR), CASE WHEN regexp_matches(message, '[,"\\n]') THEN '"' || replace(message, '"', '""') || '"' ELSE message END, coalesce(code, 'null')) AS line FROM diagnostics""", True)
def _(spark, d):
    return export.csv_lines(diags(spark, d).select("id", "file", "line", "message", F.regexp_replace("code", '[,"]', "").alias("code")))


@query("k_markdown", """SELECT severity, file, id, '### ' || concat_ws(':', file, CAST(line + 1 AS VARCHAR), CAST("column" + 1 AS VARCHAR)) || chr(10) || '**' || coalesce(source, '') || CASE WHEN code IS NULL THEN '' ELSE ' (' || code || ')' END || '**: ' || message AS entry FROM diagnostics""", True)
def _(spark, d):
    return export.markdown(diags(spark, d))


@query("k_prompt", """SELECT severity, file, id, '### ' || concat_ws(':', file, CAST(line + 1 AS VARCHAR), CAST("column" + 1 AS VARCHAR)) || chr(10) || '**' || coalesce(source, '') || CASE WHEN code IS NULL THEN '' ELSE ' (' || code || ')' END || '**: ' || message AS entry FROM diagnostics WHERE severity_rank <= 2""", True)
def _(spark, d):
    return export.markdown(diags(spark, d), important_only=True)


@query("k_table", "SELECT " + " || ' | ' || ".join(f"rpad(CASE WHEN length(coalesce({c}, 'null')) > 50 THEN {c}[1:47] || '...' ELSE coalesce({c}, 'null') END, 50, ' ')" for c in ("file", "severity", "message")) + " AS line FROM diagnostics", True)
def _(spark, d):
    return export.table_lines(diags(spark, d).select("file", "severity", "message"))


@query("k_sorted", 'SELECT id, row_number() OVER (ORDER BY severity_rank, file NULLS FIRST, line, id) AS place FROM diagnostics ORDER BY severity_rank, file NULLS FIRST, line, id LIMIT 50', True)
def _(spark, d):
    from pyspark.sql import Window

    top = export.ordered(diags(spark, d), "severity").limit(50)
    return top.select("id", F.row_number().over(Window.orderBy("severity_rank", "file", "line", "id")).alias("place"))


@query("k_chart", "WITH b AS (SELECT timestamp // 86400 * 86400 AS x, sum(error_count) AS e, sum(warning_count) AS w FROM diagnostic_snapshots WHERE timestamp IS NOT NULL GROUP BY 1) SELECT 'total_errors' AS name, 'diagnostics' AS title, CAST(x AS DOUBLE) AS x, CAST(e AS DOUBLE) AS y FROM b UNION ALL SELECT 'total_warnings', 'diagnostics', CAST(x AS DOUBLE), CAST(w AS DOUBLE) FROM b")
def _(spark, d):
    chart = export.series_chart(history.time_series(snaps(spark, d), 86_400), "bucket", ["total_errors", "total_warnings"], "diagnostics")
    return chart.select("name", "title", F.inline("points"))


# ---- code


@query("x_applied_edit", _BL + r""", sp AS (SELECT code_id, code, string_split(code, chr(10)) AS l FROM cd) SELECT code_id, CASE WHEN len(l) >= 2 AND length(l[1]) >= 2 AND length(l[2]) >= 1 THEN l[1][1:2] || '<>' || l[2][2:] || CASE WHEN len(l) > 2 THEN chr(10) || array_to_string(l[3:], chr(10)) ELSE '' END ELSE code END AS code FROM sp""")
def _(spark, d):
    from glintflow.functions.code import applied_edit

    zero, one, two = F.lit(0), F.lit(1), F.lit(2)
    return _code(spark, d).select("code_id", applied_edit(F.col("code"), zero, two, one, one, F.lit("<>")).alias("code"))


@query("m_definitions", _EL + " SELECT code_id, line_no, CASE WHEN kind = 'function' THEN 'function' ELSE 'type' END AS kind, name FROM el WHERE kind IN ('function', 'class', 'type')")
def _(spark, d):
    from glintflow.functions.code import definitions

    return definitions(_code(spark, d))
