"""Duplicates hidden by formatting: one record for each content, with the number of its copies.

Merkle-style hashing, bottom-up over nested records: a leaf is normalised to its letters and digits in lower case and hashed; an
ordered node (an array) hashes the digests of its children in their order, an unordered one (a struct, a map, an array named as such)
hashes the sorted digests of its labelled children, so neither the order of fields nor their packing into one text matters. Records are
grouped by their 16-byte root digest, and the members of a group are then compared by their whole normalised structure: a
collision of digests never joins two records.

The table is read and normalised once, into a checkpoint of (id, root, structure). Members move once, to the key of their root; a group of
more than ``HOT`` records is spread over as many tasks as it has multiples of ``HOT``, each of which finds its own first id; only
these first ids, one a task and structure, are brought together. What is broadcast are the digests of groups of
more than ``HOT`` records and those first ids: at most one for each ``HOT`` records of the table.

Defined results
---------------
* Null is empty, in fields as in children; a record whose fields are all empty is a record like others. Child order of equal digests doesn't matter.
* Fields labelled inside message (JSON, or ``label: value`` parts between bars, in any order and case) are unpacked only where
  code and source are null and all three labels are there.
* Numbers, booleans and times are leaves by their text. Keys of maps are normalised like leaves; null keys don't occur.
* Ids: the smallest as a string is the first; rows with a null id are passed over; repeated rows of an id are one record.
* Empty tables give no rows. Extra columns are ignored. Texts are used whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

HOT = 1 << 20  # records of a group in one task
FIELDS = ("message", "code", "source")
_LABEL = r"(?:message|code|source)\s*[:=]"


def normal_leaf(text: Column) -> Column:
    """Letters and digits in lower case; null is empty."""
    return F.coalesce(F.regexp_replace(F.lower(F.upper(text)), r"[^\p{L}\p{N}]", ""), F.lit(""))


def root_digest(node: Column, kind: T.DataType, unordered: tuple[str, ...] = (), name: str = "") -> Column:
    """The digest of a node of any nesting, in hexadecimal. unordered: names of fields whose arrays have no order."""
    labelled = lambda label, child: F.md5(F.concat(label, F.lit("\x1f"), child))
    if isinstance(kind, T.StructType):
        return F.md5(F.concat(F.lit("U"), F.array_join(F.array_sort(F.array(*(labelled(F.lit(f.name.lower()), root_digest(node[f.name], f.dataType, unordered, f.name)) for f in kind))), "")))
    if isinstance(kind, T.MapType):
        children = F.transform(F.coalesce(F.map_entries(node), F.array().cast(T.ArrayType(T.StructType([T.StructField("key", kind.keyType), T.StructField("value", kind.valueType)])))), lambda e: labelled(normal_leaf(e["key"].cast("string")), root_digest(e["value"], kind.valueType, unordered, name)))
        return F.md5(F.concat(F.lit("U"), F.array_join(F.array_sort(children), "")))
    if isinstance(kind, T.ArrayType):
        children = F.transform(F.coalesce(node, F.array().cast(kind)), lambda e: root_digest(e, kind.elementType, unordered, name))
        return F.md5(F.concat(F.lit("U" if name in unordered else "O"), F.array_join(F.array_sort(children) if name in unordered else children, "")))
    return F.md5(normal_leaf(node.cast("string")))


def structure(node: Column, kind: T.DataType, unordered: tuple[str, ...] = (), name: str = "") -> Column:
    """The whole normalised structure of a node as a text that no other structure has: leaves hold letters and digits only."""
    inside = lambda parts: F.concat(F.lit("\x02"), F.array_join(parts, "\x1e"), F.lit("\x03"))
    if isinstance(kind, T.StructType):
        return inside(F.array(*(structure(node[f.name], f.dataType, unordered, f.name) for f in sorted(kind, key=lambda f: f.name.lower()))))
    if isinstance(kind, T.MapType):
        empty = F.array().cast(T.ArrayType(T.StructType([T.StructField("key", kind.keyType), T.StructField("value", kind.valueType)])))
        return inside(F.array_sort(F.transform(F.coalesce(F.map_entries(node), empty), lambda e: F.concat(normal_leaf(e["key"].cast("string")), F.lit("\x1f"), structure(e["value"], kind.valueType, unordered, name)))))
    if isinstance(kind, T.ArrayType):
        children = F.transform(F.coalesce(node, F.array().cast(kind)), lambda e: structure(e, kind.elementType, unordered, name))
        return inside(F.array_sort(children) if name in unordered else children)
    return normal_leaf(node.cast("string"))


def unpacked(message: Column, code: Column, source: Column) -> dict[str, Column]:
    """The three fields, taken out of message where all are labelled in it."""
    bare = code.isNull() & source.isNull()
    entries = F.map_entries(F.from_json(F.when(bare & message.rlike(r"^\s*\{[\s\S]*\}\s*$"), message), "map<string,string>"))
    named = lambda k: F.filter(entries, lambda e: F.lower(F.trim(e["key"])) == k)
    is_json = bare & (F.size(named("message")) > 0) & (F.size(named("code")) > 0) & (F.size(named("source")) > 0)
    label = lambda k: rf"(?is)(?:^|\|)\s*{k}\s*[:=]"
    is_bars = bare & message.rlike(rf"(?is)^\s*{_LABEL}") & message.rlike(label("message")) & message.rlike(label("code")) & message.rlike(label("source"))
    value = lambda k: F.regexp_extract(message, rf"(?is)(?:^|\|)\s*{k}\s*[:=](.*?)(?=\|\s*{_LABEL}|\z)", 1)
    plain = {"message": message, "code": code, "source": source}
    return {k: F.when(is_json, named(k)[0]["value"]).when(is_bars, value(k)).otherwise(plain[k]) for k in FIELDS}


def diagnostic_records(rows: DataFrame, record_id: str, message: str, code: str, source: str) -> DataFrame:
    """(id, record): the three fields as one record, unpacked where they are packed into message."""
    r = rows.select(F.col(record_id).cast("string").alias("id"), *(F.col(c).cast("string").alias(k) for c, k in zip((message, code, source), FIELDS, strict=True)))
    u = unpacked(F.col("message"), F.col("code"), F.col("source"))
    return r.select("id", F.struct(*(u[k].alias(k) for k in FIELDS)).alias("record"))


def rooted(records: DataFrame, unordered: tuple[str, ...] = ()) -> DataFrame:
    """(id, root, whole) of (id, record): the digest of 16 bytes and the structure."""
    kind = records.schema["record"].dataType
    # the normalised form first, so that digests and structure don't normalise anew
    if isinstance(kind, T.StructType) and all(isinstance(f.dataType, T.StringType) for f in kind):
        records = records.select("id", F.struct(*(normal_leaf(F.col("record")[f.name]).alias(f.name) for f in kind)).alias("record"))
        children = F.array_sort(F.array(*(F.md5(F.concat(F.lit(f"{f.name.lower()}\x1f"), F.md5(F.col("record")[f.name]))) for f in kind)))
        root = F.md5(F.concat(F.lit("U"), F.array_join(children, "")))
        whole = F.concat(F.lit("\x02"), F.array_join(F.array(*(F.col("record")[f.name] for f in sorted(kind, key=lambda f: f.name.lower()))), "\x1e"), F.lit("\x03"))
    else:
        root, whole = root_digest(F.col("record"), kind, unordered), structure(F.col("record"), kind, unordered)
    return records.where("id IS NOT NULL").select("id", F.unhex(root).alias("root"), whole.alias("whole"))


def _placed(records: DataFrame) -> DataFrame:
    """(id, root, whole, salt, salts), all of a root and salt in one task; salts is null for roots of up to ``HOT`` records."""
    from glintflow.session import checkpointed

    held = checkpointed(records)
    hot = held.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT).select("root", F.ceil(F.col("n") / HOT).cast("int").alias("salts"))
    salt = F.coalesce(F.pmod(F.xxhash64("id"), F.col("salts")).cast("int"), F.lit(0))
    return held.join(F.broadcast(hot), "root", "left").select("id", "root", "whole", salt.alias("salt"), "salts").repartition("root", "salt")  # hot: at most one row for each HOT records


def record_copies(records: DataFrame, unordered: tuple[str, ...] = ()) -> DataFrame:
    """(first_id, copy_id) of (id, record): a row for each record but the first of its group."""
    placed = _placed(rooted(records, unordered))
    same = Window.partitionBy("root", "salt", "whole").orderBy("id")  # the members of a root are told apart by their whole structure
    near = placed.select("id", "root", "whole", "salts", F.first("id").over(same).alias("near"), F.lag("id").over(same).alias("before")).where("before IS NULL OR before <> id")
    # groups in several tasks: the first id of each task and structure, and the least of them
    heads = near.where("salts IS NOT NULL AND id = near").select("near", F.min("near").over(Window.partitionBy("root", "whole")).alias("least")).where("near <> least")
    own = near.select("id", "near", F.when(F.col("salts").isNotNull(), F.col("near")).alias("_k"))
    found = own.join(F.broadcast(heads.withColumnRenamed("near", "_k")), "_k", "left").select(F.coalesce("least", "near").alias("first_id"), F.col("id").alias("copy_id"))  # heads: two for each HOT records at most
    return found.where("first_id <> copy_id")


def record_groups(records: DataFrame, unordered: tuple[str, ...] = ()) -> DataFrame:
    """(first_id, copies) of every distinct record of (id, record)."""
    placed = _placed(rooted(records, unordered))
    near = placed.groupBy("root", "salt", "whole", "salts").agg(F.min("id").alias("first_id"), F.count_distinct("id").alias("copies"))
    cold = near.where("salts IS NULL").select("first_id", "copies")
    return cold.unionByName(near.where("salts IS NOT NULL").groupBy("root", "whole").agg(F.min("first_id").alias("first_id"), F.sum("copies").alias("copies")).select("first_id", "copies"))


def collapsed(rows: DataFrame, table_name: str, record_id: str, message: str, code: str, source: str) -> DataFrame:
    """(table_name, first_id, copies) of every distinct diagnostic."""
    return record_groups(diagnostic_records(rows, record_id, message, code, source)).select(F.lit(table_name).alias("table_name"), "first_id", "copies")


def copies(rows: DataFrame, table_name: str, record_id: str, message: str, code: str, source: str) -> DataFrame:
    """(table_name, first_id, copy_id): a row for each diagnostic but the first of its group."""
    return record_copies(diagnostic_records(rows, record_id, message, code, source)).select(F.lit(table_name).alias("table_name"), "first_id", "copy_id")
