"""Current state of a table from a feed of inserts, updates and deletes.

Column-wise last-writer-wins in one aggregation: each field takes ``max_by`` over the changes that
set it. A creation sets every field, a deletion none; whether the record exists is the last of its
creations and deletions. If that last one is a creation, it precedes no deletion, so for each field
the latest change that sets it is that creation or one after it: taking the maximum over all
changes of the field equals taking it over the changes after the latest deletion or replacement,
and no second pass is needed. ``max_by`` has partial sums before the shuffle, so a record with a third
of all changes is one row a task.

Defined results
---------------
* Order: timestamp in seconds, then the writer's sequence; repeated deliveries of a sequence have no effect.
* Rows with a null timestamp are passed over; so are changes other than deletions with a null value.
* A null sequence counts as the lowest of its time.
* Values that can't be read as a status or priority, and creations in JSON that isn't complete, leave that field as null
  on creation and have no effect as a change of one field.
* Blank members are null. An empty feed gives an empty table. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATUSES = ("open", "in_progress", "review", "resolved", "closed")  # fixed values
PRIORITIES = ("critical", "high", "medium", "low")  # fixed values


def one_of(value: Column, allowed: tuple[str, ...]) -> Column:
    """The value in its fixed spelling, or null: case, blanks, hyphens and underscores do not count."""
    plain = F.lower(F.regexp_replace(value, r"[\s _-]+", ""))
    out = F.lit(None).cast("string")
    for a in allowed:
        out = F.when(plain == a.replace("_", ""), F.lit(a)).otherwise(out)
    return out


def member_of(value: Column) -> Column:
    """The member in ``Assigned to <member>`` or in the plain value."""
    v = F.regexp_replace(F.regexp_replace(value, r"(?i)^[\s ]*assigned\s+to\s+", ""), r"^[\s ]+|[\s ]+$", "")
    return F.when(v != "", v)


def changes(feed: DataFrame) -> DataFrame:
    """The feed as (assignment_id, _pos, _action, status, assignee_id, priority): nulls where a change sets nothing."""
    action = F.lower(F.regexp_replace("action", r"[\s _-]+", ""))
    at = F.when(F.abs("timestamp") >= 100_000_000_000, F.floor(F.col("timestamp") / 1000)).otherwise(F.col("timestamp")).cast("bigint")
    rows = feed.select("assignment_id", F.struct(at.alias("at"), F.coalesce(F.col("seq").cast("bigint"), F.lit(-(1 << 62))).alias("seq")).alias("_pos"), action.alias("_action"), F.col("new_value").alias("_v"))
    rows = rows.where("assignment_id IS NOT NULL AND _pos.at IS NOT NULL AND (_action = 'deleted' OR _v IS NOT NULL) AND _action IN ('created', 'deleted', 'statuschanged', 'prioritychanged', 'reassigned')")
    is_json = F.col("_v").rlike(r"^\s*\{")
    made = F.when((F.col("_action") == "created") & is_json, F.from_json("_v", "status STRING, assignee_id STRING, priority STRING"))
    act = lambda a: F.col("_action") == a
    return rows.withColumn("_made", made).select(
        "assignment_id",
        "_pos",
        "_action",
        F.when(act("statuschanged"), one_of(F.col("_v"), STATUSES)).when(act("created"), F.when(is_json, one_of(F.col("_made.status"), STATUSES)).otherwise("open")).alias("status"),
        F.when(act("reassigned"), member_of(F.col("_v"))).when(act("created"), F.when(is_json, member_of(F.col("_made.assignee_id"))).otherwise(member_of(F.col("_v")))).alias("assignee_id"),
        F.when(act("prioritychanged"), one_of(F.col("_v"), PRIORITIES)).when(act("created"), F.when(is_json, one_of(F.col("_made.priority"), PRIORITIES)).otherwise("medium")).alias("priority"),
    )


def current_state(feed: DataFrame) -> DataFrame:
    """(assignment_id, status, assignee_id, priority) of each assignment that exists after all changes."""
    rows = changes(feed)
    created = F.col("_action") == "created"

    def last(field: str) -> Column:
        sets = created | F.col(field).isNotNull()
        return F.max_by(field, F.when(sets, F.col("_pos"))).alias(field)

    fate = F.max_by("_action", F.when(F.col("_action").isin("created", "deleted"), F.struct("_pos", (F.col("_action") == "deleted").alias("d"))))
    return rows.groupBy("assignment_id").agg(fate.alias("_fate"), last("status"), last("assignee_id"), last("priority")).where("_fate = 'created'").drop("_fate")
