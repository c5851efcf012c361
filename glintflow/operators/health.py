"""Component health: scores, bands, alerts and advice from measurements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# metric, warning, critical: fixed values
THRESHOLDS = {"cpu": (70.0, 90.0), "memory": (75.0, 90.0), "error_rate": (5.0, 10.0), "response_ms": (1000.0, 5000.0)}
KEPT_ALERTS = 1000


def component_scores(measured: DataFrame) -> DataFrame:
    """Score and status of components (component, hit_rate, error_rate, breaker_open, available)."""
    score = F.greatest(
        F.lit(0.0),
        F.when(~F.coalesce("available", F.lit(True)), 0.0).otherwise(
            100.0 - F.when(F.col("hit_rate") < 0.5, 20.0).otherwise(0.0) - F.when(F.col("error_rate") > 5.0, 30.0).otherwise(0.0) - F.when(F.col("breaker_open"), 50.0).otherwise(0.0)
        ),
    )
    rows = measured.withColumn("score", score)
    issues = F.array_compact(F.array(F.when(F.col("hit_rate") < 0.5, "low hit rate"), F.when(F.col("error_rate") > 5.0, "high error rate"), F.when(F.col("breaker_open"), "breaker open"), F.when(~F.coalesce("available", F.lit(True)), "not available")))
    return rows.select("component", "score", F.when(F.col("score") >= 90, "Online").when(F.col("score") >= 70, "Degraded").otherwise("Offline").alias("status"), F.array_join(issues, ", ").alias("issues"))


def overall(scores: DataFrame) -> DataFrame:
    """The mean of the mean and the lowest score, in bands; no component is Unknown."""
    o = scores.agg(((F.avg("score") + F.min("score")) / 2).alias("overall"))
    return o.select("overall", F.when(F.col("overall").isNull(), "Unknown").when(F.col("overall") >= 90, "Healthy").when(F.col("overall") >= 70, "Warning").when(F.col("overall") >= 50, "Degraded").otherwise("Critical").alias("health"))


def alerts(measured: DataFrame) -> DataFrame:
    """One alert for each metric (cpu, memory, error_rate, response_ms) of a component beyond a threshold, from one pass."""
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.lit(w).alias("w"), F.lit(c).alias("c")) for m, (w, c) in THRESHOLDS.items())))
    rows = measured.select("component", each.alias("x")).select("component", "x.*").where("value > w")
    level = F.when(F.col("value") > F.col("c"), "critical").otherwise("warning")
    return rows.select(F.concat_ws("-", "metric", level, "component").alias("id"), "component", "metric", level.alias("severity"), "value")


def merged_alerts(old: DataFrame, new: DataFrame, keep: int = KEPT_ALERTS) -> DataFrame:
    """Old alerts (id, ts, resolved) and those new ones that aren't open yet; the newest ``keep`` stay."""
    fresh = new.join(old.where("NOT resolved").select("id").distinct(), "id", "left_anti").select("id", "ts", F.lit(False).alias("resolved"))
    return old.select("id", "ts", "resolved").unionByName(fresh).orderBy(F.desc("ts"), "id").limit(keep)


def advice(metrics: DataFrame) -> DataFrame:
    """(component, impact, effort): what the figures (hit_rate, error_rate, memory_mb, avg_millis) call for."""
    rules = [
        (F.col("hit_rate") < 0.7, "cache", F.when(F.col("hit_rate") < 0.5, "Critical").otherwise("High"), "Low"), (F.col("error_rate") > 2, "processor", F.when(F.col("error_rate") > 5, "Critical").otherwise("High"), "Medium"),
        (F.col("memory_mb") > 1024, "system", F.lit("Medium"), "High"), (F.col("avg_millis") > 1000, "processing", F.lit("High"), "High"),
    ]
    each = F.array_compact(F.array(*(F.when(c, F.struct(F.lit(k).alias("component"), i.alias("impact"), F.lit(e).alias("effort"))) for c, k, i, e in rules)))
    return metrics.select(F.inline(each))


def health_summary(metrics: DataFrame) -> DataFrame:
    """100 less the penalties for hit rate, errors and memory, not below 0."""
    p = (
        F.when(F.col("hit_rate") < 0.7, (0.7 - F.col("hit_rate")) * 30).otherwise(0.0)
        + F.when(F.col("error_rate") > 1, F.least("error_rate", F.lit(10.0)) * 3).otherwise(0.0)
        + F.when(F.col("memory_mb") > 512, F.least((F.col("memory_mb") - 512) / 512 * 10, F.lit(20.0))).otherwise(0.0)
    )
    return metrics.select(F.round(F.greatest(F.lit(0.0), 100 - p), 6).alias("score"))


def prometheus(scores: DataFrame, prefix: str = "glintflow") -> DataFrame:
    """Exposition lines (line) of the components' scores."""
    return scores.select(F.format_string(f'{prefix}_component_health_score{{component="%s"}} %.1f', "component", "score").alias("line"))


def json_report(scores: DataFrame) -> DataFrame:
    """(line): a JSON object for each component, with the issues that lower its score."""
    return scores.select(F.to_json(F.struct("component", "score", "status", "issues")).alias("line"))
