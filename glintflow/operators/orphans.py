"""References to records that do not exist.

Distinct non-null foreign keys of all child fields are anti-joined to the parent keys; what is
known of each distinct key (registered when, removed, never seen) is joined back to the references,
which gives the orphan references themselves and their counts per table, field, reason and period.

Defined results
---------------
* Keys are compared trimmed and in lower case. Null, blank, ``unassigned``, ``none`` and ``n/a`` refer to nothing.
* A parent registered more than once counts from its earliest registration; one without a
  registration time is never late.
* A reference whose own time is null has the period ``unknown`` and is never late.
* A deletion log may hold keys that are registered again: the parent table wins.
* Repeated child rows (same record id, field, reason and period) are one reference.
* Empty children give an empty result; an empty parent makes every key missing or deleted.
* Extra columns in any table are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NOTHING = ("", "unassigned", "none", "n/a")  # fixed values: spellings that refer to no record
MILLIS_FROM = 100_000_000_000  # epoch seconds never reach this before the year 5138


@dataclass(frozen=True)
class Reference:
    """A foreign key field of a child table."""

    field: str
    parent: str


def normal_key(key: Column) -> Column:
    """Keys without surrounding white space, in lower case; null where they refer to nothing."""
    k = F.lower(F.regexp_replace(key.cast("string"), r"^[\s ]+|[\s ]+$", ""))
    return F.when(~k.isin(*NOTHING), k)


def epoch_seconds(time: Column) -> Column:
    """Epoch seconds of times that some writers send in milliseconds."""
    return F.when(F.abs(time) >= MILLIS_FROM, F.floor(time / 1000)).otherwise(time).cast("bigint")


def references(child: DataFrame, table_name: str, record_id: str, time: Column, fields: list[Reference]) -> DataFrame:
    """One row for each non-empty reference of a child table, from a single scan."""
    each = F.explode(F.array(*(F.struct(F.lit(r.field).alias("field_name"), F.lit(r.parent).alias("_parent"), normal_key(F.col(r.field)).alias("_key")) for r in fields)))
    return (
        child.select(F.lit(table_name).alias("table_name"), F.col(record_id).cast("string").alias("record_id"), epoch_seconds(time).alias("_at"), each.alias("_r"))
        .select("table_name", "record_id", "_at", "_r.*")
        .where("_key IS NOT NULL")
    )


def known_keys(refs: DataFrame, parents: DataFrame, deleted: DataFrame) -> DataFrame:
    """The distinct referred keys that have orphans: ``_state`` deleted, missing or late, ``_since`` when, and ``_n`` references.

    ``parents`` and ``deleted`` have (_parent, _key) and parents also ``_since``. A registered key is late only for references before
    its registration; those whose first reference is after it are left out.
    """
    from glintflow.session import checkpointed

    on = ["_parent", "_key"]
    keys = checkpointed(refs.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first")))  # a row a distinct key; partial sums before the shuffle: hot keys are one row a task
    registered = parents.where("_key IS NOT NULL").groupBy(*on).agg(F.min("_since").alias("_since"))
    orphans = keys.join(registered, on, "left_anti")
    gone = deleted.where("_key IS NOT NULL").select(*on).distinct()
    never = orphans.join(gone.withColumn("_gone", F.lit(True)), on, "left")
    never = never.select(*on, F.when(F.col("_gone"), "deleted").otherwise("missing").alias("_state"), F.lit(None).cast("bigint").alias("_since"), "_n")
    late = keys.join(registered, on).where("_since > _first").select(*on, F.lit("late").alias("_state"), "_since", "_n")
    return never.unionByName(late)


HOT = 1 << 20  # references of a key in one task


def orphan_references(refs: DataFrame, parents: DataFrame, deleted: DataFrame) -> DataFrame:
    """Rows (table_name, field_name, record_id, reason, period) of references without a valid parent.

    The state of a key is one row. A key of more than ``HOT`` references is spread over as many tasks as it has multiples of that, by a salt
    from the record id, and only its state is replicated as often. The list of these keys is broadcast: one for each ``HOT`` references at most.
    """
    from glintflow.session import checkpointed

    state = checkpointed(known_keys(refs, parents, deleted)).withColumn("_salts", F.ceil(F.col("_n") / HOT).cast("int"))
    hot = state.where("_salts > 1").select("_parent", "_key", "_salts")
    salted = refs.join(F.broadcast(hot), ["_parent", "_key"], "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64("record_id"), F.col("_salts")).cast("int"), F.lit(0))).drop("_salts")
    state = state.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)))
    found = salted.join(state, ["_parent", "_key", "_salt"]).where((F.col("_state") != "late") | (F.col("_since") > F.col("_at")))
    period = F.coalesce(F.date_format(F.timestamp_seconds("_at"), "yyyy-MM"), F.lit("unknown"))
    return found.select("table_name", "field_name", "record_id", F.col("_state").alias("reason"), period.alias("period")).distinct()


def orphan_counts(found: DataFrame) -> DataFrame:
    """Orphan references per table, field, reason and period."""
    return found.groupBy("table_name", "field_name", "reason", "period").agg(F.count(F.lit(1)).alias("n_references"))


ASSIGNMENT_FIELDS = [Reference("repository_id", "repositories"), Reference("assignee_id", "team_members"), Reference("assigned_by", "team_members")]
HISTORY_FIELDS = [Reference("member_id", "team_members")]


def diagnostics_orphans(assignments: DataFrame, history: DataFrame, repositories: DataFrame, members: DataFrame, deleted: DataFrame) -> DataFrame:
    """Orphan references of this project's assignments and history."""
    refs = references(assignments, "diagnostic_assignments", "id", F.col("assigned_at"), ASSIGNMENT_FIELDS).unionByName(
        references(history, "assignment_history", "id", F.col("timestamp"), HISTORY_FIELDS)
    )
    parent = lambda df, name: df.select(F.lit(name).alias("_parent"), normal_key(F.col("id")).alias("_key"), F.col("created_at").cast("bigint").alias("_since"))
    parents = parent(repositories, "repositories").unionByName(parent(members, "team_members"))
    gone = deleted.select(F.lower(F.trim("table_name")).alias("_parent"), normal_key(F.col("key_id")).alias("_key"))
    return orphan_references(refs, parents, gone)
