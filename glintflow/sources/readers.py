"""Readers of diagnostics in the JSON of several tools, of folders and of package manifests.

Every reader takes rows (record, data) with the JSON text and gives the columns of ``COLUMNS``; declared schemas, no inference. Rows whose
JSON can't be read give nothing; ``broken`` finds them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glintflow.functions.text import language_of, normal_uri
from glintflow.schema import by_value

COLUMNS = ("record", "position", "file", "start_line", "start_character", "end_line", "end_character", "severity", "message", "code", "source", "related")
_POINT = "STRUCT<line: INT, character: INT>"
_TS = f"STRUCT<file: STRING, fileName: STRING, start: {_POINT}, end: {_POINT}, category: INT, messageText: STRING, message: STRING, code: STRING, relatedInformation: ARRAY<STRUCT<file: STRUCT<fileName: STRING>, start: {_POINT}, end: {_POINT}, messageText: STRING, message: STRING>>>"
_SPAN = "STRUCT<file_name: STRING, line_start: INT, line_end: INT, column_start: INT, column_end: INT, label: STRING>"
_RUST = f"STRUCT<spans: ARRAY<{_SPAN}>, level: STRING, message: STRING, code: STRUCT<code: STRING>>"
_ESLINT = "STRUCT<filePath: STRING, messages: ARRAY<STRUCT<line: INT, column: INT, endLine: INT, endColumn: INT, severity: INT, message: STRING, ruleId: STRING>>>"
_LSP = f"STRUCT<id: STRING, uri: STRING, file: STRING, source: STRING, range: STRUCT<start: {_POINT}, end: {_POINT}>, severity: STRING, message: STRING, code: STRING>"

# fixed values
TS_SEVERITY = {0: "Warning", 1: "Error", 2: "Hint", 3: "Information"}
RUST_SEVERITY = {"error": "Error", "warning": "Warning", "note": "Information", "info": "Information", "help": "Hint"}
ESLINT_SEVERITY = {1: "Warning", 2: "Error"}
LSP_SEVERITY = {"1": "Error", "2": "Warning", "3": "Information", "4": "Hint"}


def zero_based(n: Column) -> Column:
    return F.greatest(F.coalesce(n, F.lit(1)) - 1, F.lit(0))


def _items(raw: DataFrame, kind: str, key: str = "diagnostics") -> DataFrame:
    """The elements of ``{key: [...]}`` or of a bare array."""
    wrapped = F.from_json("data", f"STRUCT<{key}: ARRAY<{kind}>>")[key]
    bare = F.from_json("data", f"ARRAY<{kind}>")
    each = raw.select("record", F.posexplode(F.when(F.col("data").rlike(r"^\s*\["), bare).otherwise(wrapped)).alias("position", "d"))
    return each.withColumn("position", F.col("position").cast("bigint"))


def _span(d: str, end_default: bool = True) -> list[Column]:
    s, e = F.col(f"{d}.start"), F.col(f"{d}.end")
    e = F.coalesce(e, s) if end_default else e
    zero = lambda c: F.coalesce(c, F.lit(0))
    return [zero(s["line"]).alias("start_line"), zero(s["character"]).alias("start_character"), zero(e["line"]).alias("end_line"), zero(e["character"]).alias("end_character")]


def _none() -> Column:
    return F.array().cast("array<struct<file:string,line:int,message:string>>").alias("related")


def typescript(raw: DataFrame) -> DataFrame:
    related = F.transform(F.coalesce("d.relatedInformation", F.array().cast("array<" + _TS.split("relatedInformation: ARRAY<")[1][:-1])), lambda r: F.struct(normal_uri(F.coalesce(r["file"]["fileName"], F.lit(""))).alias("file"), r["start"]["line"].alias("line"), F.coalesce(r["messageText"], r["message"], F.lit("")).alias("message")))
    return _items(raw, _TS).select(
        "record", "position", normal_uri(F.coalesce("d.file", "d.fileName", F.lit(""))).alias("file"), *_span("d"), by_value(F.coalesce("d.category", F.lit(1)), TS_SEVERITY, "Error").alias("severity"),
        F.coalesce("d.messageText", "d.message", F.lit("")).alias("message"), F.col("d.code").alias("code"), F.lit("typescript").alias("source"), related.alias("related"),
    )


def rust(raw: DataFrame) -> DataFrame:
    """The first span is the place, the others are related; rows without spans are broken."""
    s = F.col("d.spans")[0]
    related = F.transform(F.slice("d.spans", 2, F.greatest(F.size("d.spans") - 1, F.lit(0))), lambda x: F.struct(normal_uri(F.coalesce(x["file_name"], F.lit(""))).alias("file"), zero_based(x["line_start"]).alias("line"), F.coalesce(x["label"], F.lit("")).alias("message")))
    return _items(raw, _RUST).where("size(d.spans) > 0").select(
        "record", "position", normal_uri(F.coalesce(s["file_name"], F.lit(""))).alias("file"), zero_based(s["line_start"]).alias("start_line"), zero_based(s["column_start"]).alias("start_character"), zero_based(s["line_end"]).alias("end_line"), zero_based(s["column_end"]).alias("end_character"),
        by_value(F.lower(F.coalesce("d.level", F.lit("error"))), RUST_SEVERITY, "Error").alias("severity"), F.coalesce("d.message", F.lit("")).alias("message"), F.col("d.code.code").alias("code"), F.lit("rust-analyzer").alias("source"), related.alias("related"),
    )


def eslint(raw: DataFrame) -> DataFrame:
    m = _items(raw, _ESLINT, "results").select("record", F.col("position").alias("outer"), F.col("d.filePath").alias("path"), F.posexplode("d.messages").alias("inner", "m"))
    return m.select(
        "record", (F.col("outer").cast("bigint") * (1 << 32) + F.col("inner")).alias("position"), normal_uri(F.coalesce("path", F.lit(""))).alias("file"), zero_based(F.col("m.line")).alias("start_line"), zero_based(F.col("m.column")).alias("start_character"),
        zero_based(F.coalesce("m.endLine", "m.line")).alias("end_line"), zero_based(F.coalesce("m.endColumn", "m.column")).alias("end_character"), by_value(F.col("m.severity"), ESLINT_SEVERITY, "Warning").alias("severity"),
        F.coalesce("m.message", F.lit("")).alias("message"), F.col("m.ruleId").alias("code"), F.lit("eslint").alias("source"), _none(),
    )


def generic(raw: DataFrame, source: str = "lsp") -> DataFrame:
    """Language-server rows: the file from uri, else source, else file; rows without a range are broken."""
    kept = _items(raw, _LSP).where("d.range IS NOT NULL")
    named = F.col("d.severity")
    severity = F.when(named.isin("Error", "Warning", "Information", "Hint"), named).otherwise(by_value(F.coalesce(named, F.lit("1")), LSP_SEVERITY, "Error"))
    return kept.select(
        "record", "position", normal_uri(F.coalesce("d.uri", "d.source", "d.file", F.lit(""))).alias("file"), *_span("d.range"), severity.alias("severity"),
        F.coalesce("d.message", F.lit("")).alias("message"), F.col("d.code").alias("code"), F.coalesce("d.source", F.lit(source)).alias("source"), _none(),
    )


def broken(raw: DataFrame) -> DataFrame:
    """Records whose JSON can't be read at all."""
    return raw.where(F.try_parse_json("data").isNull())


def detected(source: Column, data: Column) -> Column:
    """The dialect, by the source's name, else by the shape of the JSON."""
    s = F.lower(F.coalesce(source, F.lit("")))
    first = F.get_json_object(data, "$.diagnostics[0]")
    has = lambda key: F.get_json_object(first, f"$.{key}").isNotNull()
    return (
        F.when(s.contains("typescript") | s.rlike("(?<!e?slin)ts") & ~s.contains("eslint"), "typescript")
        .when(s.contains("rust") | s.contains("analyzer"), "rust")
        .when(s.contains("eslint"), "eslint")
        .when(has("code") & has("category"), "typescript")
        .when(has("level") & has("spans"), "rust")
        .when(F.get_json_object(data, "$.results").isNotNull(), "eslint")
        .otherwise("generic")
    )


def normalised(raw: DataFrame) -> DataFrame:
    """Rows (record, source, data) of any dialect, each read by its own reader."""
    rows = raw.withColumn("_d", detected(F.col("source"), F.col("data")))
    out = None
    for name, read in (("typescript", typescript), ("rust", rust), ("eslint", eslint), ("generic", generic)):
        part = read(rows.where(F.col("_d") == name).select("record", "data"))
        out = part if out is None else out.unionByName(part)
    return out


def dependencies(manifests: DataFrame) -> DataFrame:
    """(record, name, version, kind) of package manifests (record, data): normal and development dependencies."""
    each = None
    for kind in ("dependencies", "devDependencies"):
        part = manifests.select("record", F.explode(F.from_json(F.get_json_object("data", f"$.{kind}"), "map<string,string>")).alias("name", "version"), F.lit(kind).alias("kind"))
        each = part if each is None else each.unionByName(part)
    return each


def cargo_dependencies(text: str) -> dict[str, str]:
    """Names and versions of a Cargo manifest, read on the driver."""
    import tomllib

    deps = tomllib.loads(text).get("dependencies", {})
    return {k: v if isinstance(v, str) else v.get("version", "*") if isinstance(v, dict) else "*" for k, v in deps.items()}


def build_system(manifest: Column) -> Column:
    """The build tool named in a manifest's scripts, else its package manager, else npm."""
    scripts, manager = F.coalesce(F.get_json_object(manifest, "$.scripts"), F.lit("")), F.coalesce(F.get_json_object(manifest, "$.packageManager"), F.lit(""))
    out = None
    for tool in ("nx", "lerna", "rush", "turbo"):
        out = F.when(scripts.contains(f"{tool} "), tool) if out is None else out.when(scripts.contains(f"{tool} "), tool)
    return out.when(manager.startswith("pnpm"), "pnpm").when(manager.startswith("yarn"), "yarn").otherwise("npm")


def files_under(spark: SparkSession, folder: str, glob: str = "*", ignored: list[str] | None = None) -> DataFrame:
    """(file, size, mtime, language, hash) of the files under a folder; ignored: globs of paths left out."""
    from glintflow.functions.patterns import glob_regex

    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
    rows = rows.select(normal_uri(F.regexp_replace("path", "^file:/+", "/")).alias("file"), F.col("length").alias("size"), F.unix_seconds("modificationTime").alias("mtime"), F.sha2("content", 256).alias("hash"))
    for g in ignored or []:
        rows = rows.where(~F.col("file").rlike(glob_regex(g)))
    return rows.withColumn("language", language_of(F.col("file")))
