"""What changed between runs, and results that keep what did not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def changed_files(current: DataFrame, previous: DataFrame) -> DataFrame:
    """(file, state) of files (file, mtime, hash): added, changed, touched (newer, same content), unchanged or removed."""
    c = current.select("file", F.col("mtime").alias("m"), F.col("hash").alias("h"), F.lit(True).alias("c"))
    p = previous.select("file", F.col("mtime").alias("pm"), F.col("hash").alias("ph"), F.lit(True).alias("p"))
    state = (
        F.when(F.col("p").isNull(), "added").when(F.col("c").isNull(), "removed").when(F.col("m").eqNullSafe(F.col("pm")), "unchanged").when(F.col("h").eqNullSafe(F.col("ph")), "touched").otherwise("changed")
    )
    return c.join(p, "file", "full").select("file", state.alias("state"))


def merged(new: DataFrame, old: DataFrame, states: DataFrame) -> DataFrame:
    """New rows of files that changed, and old rows of those that did not; rows of removed files go."""
    gone = states.where("state IN ('added', 'changed', 'removed')").select("file")
    return new.unionByName(old.join(gone, "file", "left_anti"))


def run_statistics(states: DataFrame) -> DataFrame:
    """Files by state and the share that needed no work."""
    kept = F.count_if(F.col("state").isin("unchanged", "touched"))
    return states.agg(F.count(F.lit(1)).alias("files"), kept.alias("reused"), F.coalesce(F.try_divide(kept, F.count(F.lit(1))), F.lit(0.0)).alias("hit_rate"))


def cached_snapshots(snapshots: DataFrame, now: int, ttl: int, most: int) -> DataFrame:
    """What a cache still holds: not older than its time, the newest ``most``."""
    return snapshots.where(F.col("timestamp") > now - ttl).orderBy(F.desc("timestamp"), F.desc("id")).limit(most)


def changed_since(files: DataFrame, since: int) -> DataFrame:
    """Files (file, mtime) that were modified at a time or later."""
    return files.where(F.col("mtime") >= since)


def of_files(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Rows of the listed files (file), such as those that changed since a commit."""
    return rows.join(files.select("file").distinct(), "file", "left_semi")


def git_state(index: Column, tree: Column) -> Column:
    """The state of a file by its two letters: of the index and of the working tree."""
    return (
        F.when((index == "M") | (tree == "M"), "modified").when(index == "A", "added").when((index == "D") | (tree == "D"), "deleted").when(index == "R", "renamed").when(index == "C", "copied")
        .when((index == "?") & (tree == "?"), "untracked").when((index == "!") & (tree == "!"), "ignored").when((index == "U") | (tree == "U"), "conflict").when(index != " ", "staged").otherwise("modified")
    )
