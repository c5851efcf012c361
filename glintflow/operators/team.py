"""Registry and team tables: scans, keep-latest writes and workload."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glintflow.operators.orphans import normal_key

PRIORITY_RANK = {"critical": 1, "high": 2, "medium": 3, "low": 4}  # fixed values


def active_by_name(rows: DataFrame) -> DataFrame:
    return rows.where("active").orderBy("name", "id")


def tagged(repositories: DataFrame, tag: str) -> DataFrame:
    """Active repositories with a tag."""
    return repositories.where(F.col("active") & F.array_contains(F.from_json("tags", "array<string>"), tag))


def assignments_of(assignments: DataFrame, member: str, status: str | None = None, by_rank: bool = True) -> DataFrame:
    """A member's assignments by priority and time; by_rank=False sorts the priority as text."""
    from glintflow.schema import by_value

    out = assignments.where(normal_key(F.col("assignee_id")) == member)
    if status is not None:
        out = out.where(F.col("status") == status)
    key: Column = by_value(F.col("priority"), PRIORITY_RANK, 5) if by_rank else F.col("priority")
    return out.orderBy(key, "assigned_at", "id")


def latest_by(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key: an upsert of an append-only table. By aggregation, so that no key is sorted in one task."""
    out = rows.groupBy(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys))).agg(F.max_by(F.struct(*(F.col(f"`{c}`") for c in rows.columns)), F.struct(*order)).alias("_r"))
    return out.select("_r.*")


def workload(members: DataFrame, assignments: DataFrame) -> DataFrame:
    """Each member's assignments, how many are resolved and the mean time to it; members without any have zeros."""
    once = assignments.dropDuplicates(["id"])
    per = once.groupBy(normal_key(F.col("assignee_id")).alias("_m")).agg(F.count(F.lit(1)).alias("assigned"), F.count("completed_at").alias("resolved"), F.avg(F.col("completed_at") - F.col("assigned_at")).alias("avg_seconds"))
    out = members.select("id", "name").join(per, normal_key(F.col("id")) == F.col("_m"), "left")
    return out.select("id", "name", F.coalesce("assigned", F.lit(0)).alias("assigned"), F.coalesce("resolved", F.lit(0)).alias("resolved"), F.round("avg_seconds", 3).alias("avg_seconds"))


def unknown_assignees(assignments: DataFrame, members: DataFrame, active_only: bool = True) -> DataFrame:
    """Assignments whose assignee isn't an (active) member."""
    known = members.where("active") if active_only else members
    return assignments.where(normal_key(F.col("assignee_id")).isNotNull()).join(known.select(normal_key(F.col("id")).alias("_m")).distinct(), normal_key(F.col("assignee_id")) == F.col("_m"), "left_anti")


def status_events(history: DataFrame) -> DataFrame:
    """Changes of status by day: the event log from which a current status is derived."""
    at = F.when(F.abs("timestamp") >= 100_000_000_000, F.floor(F.col("timestamp") / 1000)).otherwise(F.col("timestamp")).cast("bigint")
    action = F.lower(F.regexp_replace("action", "[^A-Za-z]", ""))
    rows = history.where("timestamp IS NOT NULL AND new_value IS NOT NULL").where(action == "statuschanged").select(F.expr("seq").alias("seq"), at.alias("at"), F.lower(F.regexp_replace(F.trim("new_value"), "[ -]", "_")).alias("status"))
    return rows.distinct().groupBy(F.date_format(F.timestamp_seconds("at"), "yyyy-MM-dd").alias("day"), "status").agg(F.count(F.lit(1)).alias("changes"))


def relations_of(relations: DataFrame, repository: str) -> DataFrame:
    """The relations (source_id, target_id, relation_type) that a repository is in, as source or as target."""
    return relations.where((F.col("source_id") == repository) | (F.col("target_id") == repository))


def merged_metrics(old: DataFrame, new: DataFrame) -> DataFrame:
    """Metrics (member_id, repository_id, resolved_count, avg_resolution_time) of two spans as one: counts added, means weighted by them."""
    both = old.unionByName(new).groupBy("member_id", "repository_id")
    total = F.sum(F.col("avg_resolution_time") * F.col("resolved_count"))
    return both.agg(F.sum("resolved_count").alias("resolved_count"), F.try_divide(total, F.sum("resolved_count")).alias("avg_resolution_time"))


def metrics_of(assignments: DataFrame) -> DataFrame:
    """Metrics of resolved assignments, each counted once, by member and repository."""
    done = assignments.where("completed_at IS NOT NULL AND assigned_at IS NOT NULL").dropDuplicates(["id"])
    keys = normal_key(F.col("assignee_id")).alias("member_id"), normal_key(F.col("repository_id")).alias("repository_id")
    return done.groupBy(*keys).agg(F.count(F.lit(1)).alias("resolved_count"), F.avg(F.col("completed_at") - F.col("assigned_at")).alias("avg_resolution_time"))


def with_status(assignments: DataFrame, changes: DataFrame) -> DataFrame:
    """Assignments with the last change (assignment_id, status, at, seq) of their status; the time of completion is set by one to resolved only, and else kept."""
    last = changes.groupBy("assignment_id").agg(F.max_by(F.struct("status", "at"), F.struct("at", "seq")).alias("_c"))
    out = assignments.join(last, assignments["id"] == F.col("assignment_id"), "left").drop("assignment_id")
    done = F.when(F.col("_c.status") == "resolved", F.col("_c.at")).otherwise(F.col("completed_at"))
    return out.withColumns({"completed_at": done, "updated_at": F.coalesce("_c.at", "updated_at"), "status": F.coalesce("_c.status", "status")}).drop("_c")
