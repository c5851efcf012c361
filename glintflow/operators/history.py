"""Time series, trends and hot spots over the history of snapshots (file_path, timestamp in seconds, counts)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOUR, DAY = 3600, 86_400
# fixed values: minutes
FIX_MINUTES = {"SyntaxErrors": 5, "TypeErrors": 15, "Linting": 10, "Build": 20, "Runtime": 30, "Other": 15}


def scan(snapshots: DataFrame, file: str | DataFrame, since: int | None = None, limit: int | None = None) -> DataFrame:
    """A file's snapshots, newest first; the file by its path, or by a row that holds it (file_path)."""
    out = snapshots.where(F.col("file_path") == file) if isinstance(file, str) else snapshots.join(file.select("file_path"), "file_path", "left_semi")
    if since is not None:
        out = out.where(F.col("timestamp") >= since)
    out = out.orderBy(F.desc("timestamp"), F.desc("id"))
    return out if limit is None else out.limit(limit)


def time_series(snapshots: DataFrame, width: int = HOUR, start: int | None = None, end: int | None = None) -> DataFrame:
    """Tumbling buckets: snapshots, sums, means and distinct files; both bounds belong."""
    rows = snapshots
    if start is not None:
        rows = rows.where(F.col("timestamp") >= start)
    if end is not None:
        rows = rows.where(F.col("timestamp") <= end)
    bucket = F.expr(f"(timestamp div {width}) * {width}")
    # per file first: the count of distinct files needs no set of them
    files = rows.where("timestamp IS NOT NULL").groupBy(bucket.alias("bucket"), "file_path").agg(F.count(F.lit(1)).alias("n"), F.sum("error_count").alias("e"), F.sum("warning_count").alias("w"))
    out = files.groupBy("bucket").agg(F.sum("n").alias("snapshots"), F.sum("e").alias("total_errors"), F.sum("w").alias("total_warnings"), F.count("file_path").alias("unique_files"))
    return out.select("bucket", "snapshots", "total_errors", "total_warnings", (F.col("total_errors") / F.col("snapshots")).alias("avg_errors"), (F.col("total_warnings") / F.col("snapshots")).alias("avg_warnings"), "unique_files")


def lifetimes(snapshots: DataFrame) -> DataFrame:
    """First and last time, totals, means and maxima of each file."""
    return snapshots.groupBy("file_path").agg(
        F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"), F.count(F.lit(1)).alias("total_snapshots"), F.sum("error_count").alias("total_errors"),
        F.sum("warning_count").alias("total_warnings"), F.avg("error_count").alias("avg_errors"), F.avg("warning_count").alias("avg_warnings"), F.max("error_count").alias("max_errors"), F.max("warning_count").alias("max_warnings"),
    )


def velocity(series: DataFrame, seconds: float) -> DataFrame:
    """Errors and warnings an hour over a window."""
    hours = seconds / HOUR
    return series.agg((F.coalesce(F.sum("total_errors"), F.lit(0)) / hours).alias("error_velocity"), (F.coalesce(F.sum("total_warnings"), F.lit(0)) / hours).alias("warning_velocity"))


def direction(slope: Column, down: float, up: float) -> Column:
    return F.when(slope < down, "Improving").when(slope > up, "Degrading").otherwise("Stable")


def trend(series: DataFrame) -> DataFrame:
    """Slope of errors over the number of the bucket, and its direction; fewer than two buckets are stable.

    A series has one row a bucket, so numbering them in one task is bounded by the time range.
    """
    numbered = series.withColumn("x", F.row_number().over(Window.orderBy("bucket")) - 1)
    out = numbered.agg(F.regr_slope("total_errors", "x").alias("slope"))
    return out.select("slope", F.when(F.col("slope").isNull(), "Stable").otherwise(direction(F.col("slope"), -0.5, 0.5)).alias("direction"))


def health(series: DataFrame, hot_spots: int) -> DataFrame:
    """0 to 1 from the latest bucket and the number of hot spots; no data is 1."""
    last = series.agg(F.max_by(F.struct("avg_errors", "avg_warnings"), "bucket").alias("l"))
    score = 0.5 / (1 + F.col("l.avg_errors") / 10) + 0.3 / (1 + F.col("l.avg_warnings") / 20) + 0.2 / (1 + hot_spots / 10)
    return last.select(F.coalesce(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)), F.lit(1.0)).alias("health_score"))


def volatility(snapshots: DataFrame) -> DataFrame:
    """Deviation of a file's errors over their mean plus one; below two snapshots 0."""
    out = snapshots.groupBy("file_path").agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("error_count").alias("s"), F.avg("error_count").alias("m"))
    return out.select("file_path", F.when(F.col("n") < 2, 0.0).otherwise(F.col("s") / (F.col("m") + 1)).alias("volatility"))


def file_trends(snapshots: DataFrame, compat: bool = False) -> DataFrame:
    """Mean of a file's later half less that of its earlier half, errors counting twice. compat: with the newest first.

    The halves are found by days: a day lies before the middle, after it, or across it, and only the rows of the day across the middle are put in
    order. So a file with a large part of all snapshots is spread over its days.
    """
    way = F.desc if compat else F.asc
    rows = snapshots.select("file_path", "error_count", "warning_count", "timestamp", "id", F.expr(f"timestamp div {DAY}").alias("day"))
    sums = [F.count(F.lit(1)).alias("n"), F.count("error_count").alias("ne"), F.count("warning_count").alias("nw"), F.sum("error_count").alias("e"), F.sum("warning_count").alias("w")]
    days = rows.groupBy("file_path", "day").agg(*sums)
    by_file = Window.partitionBy("file_path")  # one row a day and file
    before = F.sum("n").over(by_file.orderBy(way("day")).rowsBetween(Window.unboundedPreceding, -1))
    days = days.withColumns({"before": F.coalesce(before, F.lit(0)), "half": F.floor(F.sum("n").over(by_file) / 2)})
    across = (F.col("before") < F.col("half")) & (F.col("before") + F.col("n") > F.col("half"))
    split = days.where(across).select("file_path", F.col("day").alias("_day"), (F.col("half") - F.col("before")).alias("take"))
    inside = rows.join(split, (rows["file_path"] == split["file_path"]) & rows["day"].eqNullSafe(split["_day"])).select(rows["file_path"], "error_count", "warning_count", "take", F.row_number().over(Window.partitionBy(rows["file_path"], "_day").orderBy(way("timestamp"), way("id"))).alias("i"))
    parts = inside.groupBy("file_path", (F.col("i") <= F.col("take")).alias("early")).agg(*sums)
    whole = days.where(~across).select("file_path", (F.col("before") + F.col("n") <= F.col("half")).alias("early"), "n", "ne", "nw", "e", "w")
    both = whole.unionByName(parts).groupBy("file_path")
    of = lambda c, early: F.sum(F.when(F.col("early") == early, F.col(c)))
    mean = lambda c, n, early: F.try_divide(of(c, early), of(n, early))
    out = both.agg(F.sum("n").alias("n"), ((mean("e", "ne", False) - mean("e", "ne", True)) * 2 + mean("w", "nw", False) - mean("w", "nw", True)).alias("change"))
    return out.select("file_path", F.when(F.col("n") < 2, 0.0).otherwise(F.col("change")).alias("change"), F.when(F.col("n") < 2, "Stable").otherwise(direction(F.col("change"), -1.0, 1.0)).alias("trend"))


def predictions(snapshots: DataFrame) -> DataFrame:
    """The whole mean of a file's five newest snapshots; below three snapshots nothing is predicted.

    The limit of five a file applies before the shuffle too, so no file sends more than five rows a task.
    """
    newest = Window.partitionBy("file_path").orderBy(F.desc("timestamp"), F.desc("id"))
    recent = snapshots.select("file_path", "error_count", "warning_count", F.row_number().over(newest).alias("i")).where("i <= 5")
    mean = recent.groupBy("file_path").agg(F.floor(F.avg("error_count")).alias("e"), F.floor(F.avg("warning_count")).alias("w"))
    whole = snapshots.groupBy("file_path").agg(F.count(F.lit(1)).alias("n"), (F.stddev_pop("error_count") / (F.avg("error_count") + 1)).alias("v"))
    enough = F.col("n") >= 3
    return mean.join(whole, "file_path").select("file_path", F.when(enough, F.col("e")).otherwise(0).cast("bigint").alias("next_errors"), F.when(enough, F.col("w")).otherwise(0).cast("bigint").alias("next_warnings"), F.when(enough, 1 / (1 + F.col("v"))).otherwise(0.0).alias("confidence"))


def hot_spots(snapshots: DataFrame, top: int = 10) -> DataFrame:
    """Files by two times the errors plus the warnings a snapshot, with what to do."""
    rows = lifetimes(snapshots).select("file_path", "avg_errors", "avg_warnings", F.round(F.col("avg_errors") * 2 + F.col("avg_warnings"), 9).alias("score"))
    advice = F.when(F.col("avg_errors") > 5, "needs attention now").otherwise("watch for changes")
    return rows.withColumn("recommendation", advice).orderBy(F.desc("score"), "file_path").limit(top)


def recurring(patterns: DataFrame, least: int = 5) -> DataFrame:
    """Error patterns seen often enough, with their rate a day and what to do about them."""
    days = F.greatest((F.col("last_seen") - F.col("first_seen")) / DAY, F.lit(1.0))
    advice = (
        F.when(F.col("occurrence_count") > 100, "write a lint rule or an automatic fix")
        .when(F.col("files_affected") > 10, "refactor across the code base")
        .when(F.col("error_code") == "TS2304", "check imports and type definitions")
        .otherwise("watch its frequency")
    )
    return patterns.where(F.col("occurrence_count") >= least).select("pattern_hash", "error_message", "occurrence_count", (F.col("occurrence_count") / days).alias("occurrence_rate"), advice.alias("action"))


def patterns_of(diagnostics: DataFrame) -> DataFrame:
    """Error patterns derived from diagnostics: a hash of message, code and source, with counts."""
    key = F.substring(F.sha2(F.concat_ws("\x1f", F.coalesce("message", F.lit("")), F.coalesce("code", F.lit("")), F.coalesce("source", F.lit(""))), 256), 1, 20)
    files = diagnostics.groupBy(key.alias("pattern_hash"), "file").agg(F.count(F.lit(1)).alias("n"), F.min("message").alias("m"), F.min("code").alias("c"), F.min("source").alias("s"))
    return files.groupBy("pattern_hash").agg(F.sum("n").alias("occurrence_count"), F.count("file").alias("files_affected"), F.min("m").alias("error_message"), F.min("c").alias("error_code"), F.min("s").alias("source"))


def fix_minutes(categories: DataFrame) -> DataFrame:
    from glintflow.schema import by_value

    return categories.select("category", by_value(F.col("category"), FIX_MINUTES, FIX_MINUTES["Other"]).alias("minutes"))


def trend_metrics(snapshots: DataFrame) -> DataFrame:
    """(metric, value, trend): slope, volatility of the daily errors and health, unpivoted."""
    daily = time_series(snapshots, DAY)
    numbered = daily.withColumn("x", F.row_number().over(Window.orderBy("bucket")) - 1)
    one = numbered.agg(
        F.regr_slope("total_errors", "x").alias("slope"), (F.stddev_pop("total_errors") / (F.avg("total_errors") + 1)).alias("volatility"), F.max_by(F.col("avg_errors"), "bucket").alias("latest_errors"), F.sum("total_errors").cast("double").alias("total_errors")
    )
    way = direction(F.col("slope"), -0.5, 0.5)
    rows = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"), way.alias("trend")) for m in ("slope", "volatility", "latest_errors", "total_errors")))
    return one.select(F.inline(rows))


def retained(snapshots: DataFrame, cutoff: int) -> DataFrame:
    """Snapshots stored since the cutoff."""
    return snapshots.where(F.col("created_at") >= cutoff)


def orphan_files(stats: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Statistics of files that have no snapshot left."""
    return stats.join(snapshots.select("file_path").distinct(), "file_path", "left_anti")


def learning_points(snapshots: DataFrame) -> DataFrame:
    """Snapshots with their file's means and a complexity of its snapshots over a hundred."""
    stats = lifetimes(snapshots).select("file_path", "avg_errors", "avg_warnings", (F.col("total_snapshots") / 100).alias("complexity"))
    return snapshots.select("timestamp", "file_path", "error_count", "warning_count").join(stats, "file_path")
