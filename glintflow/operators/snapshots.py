"""What changed between consecutive full snapshots of a file.

Each snapshot is sorted by diagnostic id and cut into content-defined chunks: a chunk begins at each id
whose hash is divisible by ``CHUNK``, so an insertion moves no boundary but its own. A chunk's digest
covers its ids and the digests of its rows. Chunk digests that a snapshot shares with its successor are
discarded; only rows of chunks without a match are joined by id to be classified.

The JSON is parsed once and reduced to chunks of (id, digest) in a narrow pass; a snapshot stays one row until its unmatched chunks are
known. Then its rows move once, to its key; its neighbours send it their chunk digests only, and only rows of
unmatched chunks move again. Matching costs the number of a snapshot's chunks times that of the unmatched ones. The successor of a
snapshot is found within (file, day) and across days by each day's first and last time, so that a file
with a third of all snapshots is not one task.

Defined results
---------------
* A delivery whose JSON is null or not one complete array is no snapshot; ``[]`` is one.
* Of several deliveries of a file and time the highest id holds; null paths or times are passed over.
* Elements are compared by the text of their values; order of keys and elements and spacing don't
  matter and an absent key equals null. Elements without an id are passed over; of several with one id the
  greatest digest stands for it.
* The first snapshot of a file gives no changes. An empty table gives none. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 8  # a chunk has so many rows on average
DAY = 86_400


def normal_path(path: Column) -> Column:
    """Forward slashes, without leading ``./``."""
    return F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"^(\./+)+", "")


def snapshot_rows(snapshots: DataFrame) -> DataFrame:
    """Valid deliveries as (file_path, ts, _id, diags): diags is an array of (id, digest) sorted by id, one for each id."""
    # parse_json passes over text after a value; as the only element of an array nothing can follow it
    whole = F.try_parse_json(F.concat(F.lit("["), "diagnostics_json", F.lit("]")))
    parsed = snapshots.where(r"file_path IS NOT NULL AND timestamp IS NOT NULL AND diagnostics_json RLIKE '^\\s*\\['").select(
        normal_path(F.col("file_path")).alias("file_path"), F.col("timestamp").cast("bigint").alias("ts"), F.coalesce(F.col("id").cast("bigint"), F.lit(-(1 << 63))).alias("_id"), whole.alias("_w")
    )
    items = F.when(F.try_variant_get("_w", "$[1]", "variant").isNull(), F.try_variant_get("_w", "$[0]", "array<variant>"))
    rows = parsed.select("file_path", "ts", "_id", F.explode(F.array(items)).alias("_a")).where("_a IS NOT NULL")  # by a generator, so that nothing is parsed once for the condition and once more
    # a variant keeps its keys sorted, so its text has one order; nulls are taken out, as absent ones are
    drop_nulls = lambda t: F.when(~t.contains(":null"), t).otherwise(F.regexp_replace(F.regexp_replace(t, r'"(?:[^"\\]|\\.)*":null,', ""), r',?"(?:[^"\\]|\\.)*":null(?=\})', ""))
    texts = F.transform("_a", lambda v: F.struct(F.try_variant_get(v, "$.id", "string").alias("id"), F.to_json(v).alias("json")))
    items = F.transform(texts, lambda x: F.struct(x["id"].alias("id"), F.xxhash64(drop_nulls(x["json"])).alias("digest")))
    rows = rows.select("file_path", "ts", "_id", F.array_sort(F.filter(items, lambda x: x["id"].isNotNull())).alias("diags"))
    last = lambda x, i: F.coalesce(F.get("diags", i + 1)["id"] != x["id"], F.lit(True))
    return rows.select("file_path", "ts", "_id", F.filter("diags", last).alias("diags"))


def chunked(rows: DataFrame) -> DataFrame:
    """(file_path, ts, _id, chunks): the content-defined chunks of each delivery, an array of (digest, items)."""
    first = F.filter(F.transform("diags", lambda x, i: F.when((i == 0) | (F.pmod(F.xxhash64(x["id"]), F.lit(CHUNK)) == 0), i)), lambda i: i.isNotNull())
    cut = rows.select("file_path", "ts", "_id", "diags", first.alias("_s"))
    items = F.transform("_s", lambda i, k: F.slice("diags", i + 1, F.coalesce(F.get("_s", k + 1), F.size("diags")) - i))
    return cut.select("file_path", "ts", "_id", items.alias("_c")).select("file_path", "ts", "_id", F.transform("_c", lambda c: F.struct(F.xxhash64(c).alias("digest"), c.alias("items"))).alias("chunks"))


def neighbours(times: DataFrame) -> DataFrame:
    """(file_path, ts, _id, prev_ts, next_ts) of distinct (file_path, ts, _id), without a file ever being one task's window."""
    days = times.groupBy("file_path", F.expr(f"ts div {DAY}").alias("day")).agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    by_file = Window.partitionBy("file_path").orderBy("day")  # one row a day and file
    days = days.select("file_path", "day", F.lag("hi").over(by_file).alias("before"), F.lead("lo").over(by_file).alias("after"))
    in_day = Window.partitionBy("file_path", "day").orderBy("ts")
    rows = times.withColumn("day", F.expr(f"ts div {DAY}")).withColumn("p", F.lag("ts").over(in_day)).withColumn("n", F.lead("ts").over(in_day))
    return rows.join(days, ["file_path", "day"]).select("file_path", "ts", "_id", F.coalesce("p", "before").alias("prev_ts"), F.coalesce("n", "after").alias("next_ts"))


def changed_rows(snapshots: DataFrame) -> DataFrame:
    """(file_path, snapshot_ts, diagnostic_id, change) with change added, removed or changed."""
    from glintflow.session import checkpointed

    rows = checkpointed(chunked(snapshot_rows(snapshots)))  # the parsed form is read by the times and by the chunks
    held = rows.groupBy("file_path", "ts").agg(F.max("_id").alias("_id"))  # the delivery that holds
    near = neighbours(held).withColumnRenamed("_id", "_held")
    here = rows.join(near, ["file_path", "ts"]).where("_id >= _held")  # the one that holds has the highest id; equality would become a key of its own
    digests = F.transform("chunks", lambda c: c["digest"])
    sent = here.select("file_path", F.explode(F.array(F.struct(F.col("next_ts").alias("ts"), F.lit(True).alias("back")), F.struct(F.col("prev_ts").alias("ts"), F.lit(False).alias("back")))).alias("to"), digests.alias("d"))
    sent = sent.where("to.ts IS NOT NULL").groupBy("file_path", "to.ts").agg(F.any_value(F.when(F.col("to.back"), F.col("d")), True).alias("was"), F.any_value(F.when(~F.col("to.back"), F.col("d")), True).alias("next"))
    both = here.join(sent, ["file_path", "ts"])
    rest = lambda other: F.array_except(digests, F.col(other))
    both = both.select("file_path", "ts", "next_ts", "chunks", rest("was").alias("new"), rest("next").alias("old")).where("size(new) > 0 OR size(old) > 0")
    rows_of = lambda kept: F.flatten(F.transform(F.filter("chunks", lambda c: F.array_contains(kept, c["digest"])), lambda c: c["items"]))
    side = lambda kept, at, lo: F.struct(F.col(at).alias("snapshot_ts"), F.lit(lo).alias("side"), F.when(F.size(kept) > 0, rows_of(kept)).alias("items"))
    each = both.select("file_path", F.inline(F.array(side("new", "ts", 1), side("old", "next_ts", 0)))).where("items IS NOT NULL")
    each = each.select("file_path", "snapshot_ts", "side", F.inline("items")).groupBy("file_path", "snapshot_ts", F.col("id").alias("diagnostic_id"))
    ids = each.agg(F.max(F.when(F.col("side") == 0, F.col("digest"))).alias("was"), F.max(F.when(F.col("side") == 1, F.col("digest"))).alias("now"))
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "changed")
    return ids.select("file_path", "snapshot_ts", "diagnostic_id", change.alias("change")).where("change IS NOT NULL")
