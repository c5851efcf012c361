"""Training sets: statistics, filters, texts and made errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glintflow.operators.scoring import confidence_bucket, fix_quality

META = "language STRING, confidence DOUBLE, diagnostic_count BIGINT, timestamp BIGINT"


def with_metadata(examples: DataFrame) -> DataFrame:
    """Adds language, confidence, diagnostic_count and ts of the metadata's JSON."""
    m = F.from_json("metadata", META)
    return examples.withColumn("_m", m).select("*", F.col("_m.language").alias("language"), F.col("_m.confidence").alias("confidence"), F.col("_m.diagnostic_count").alias("diagnostic_count"), F.col("_m.timestamp").alias("ts")).drop("_m")


def dataset_statistics(examples: DataFrame) -> DataFrame:
    """(statistic, key, n): pairs by language, confidence bucket and format, from one pass."""
    e = with_metadata(examples)
    each = F.explode(F.array(F.struct(F.lit("language").alias("statistic"), F.coalesce("language", F.lit("unknown")).alias("key")), F.struct(F.lit("confidence").alias("statistic"), F.when(F.col("confidence").isNull(), "unknown").otherwise(confidence_bucket(F.col("confidence"))).alias("key")), F.struct(F.lit("format").alias("statistic"), F.col("format").alias("key"))))
    return e.select(each.alias("s")).groupBy("s.statistic", "s.key").agg(F.count(F.lit(1)).alias("n"))


def filtered(examples: DataFrame, least: float, language: str | None = None) -> DataFrame:
    e = with_metadata(examples).where(F.col("confidence") >= least)
    return e if language is None else e.where(F.col("language") == language)


def annotation_report(examples: DataFrame) -> DataFrame:
    """Pairs and mean confidence of each grade of quality."""
    e = with_metadata(examples).where("confidence IS NOT NULL")
    return e.groupBy(fix_quality(F.col("diagnostic_count"), F.col("confidence")).alias("quality")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 6).alias("avg_confidence"))


def prompt_text(language: Column, diagnostics: Column, code: Column, context: Column, most: int = 4000) -> Column:
    """The prompt: diagnostics (array of line, severity, message), code, and context of at most ``most`` characters. Its wording is fixed."""
    lines = F.array_join(F.transform(diagnostics, lambda d: F.concat(F.lit("- Line "), d["line"].cast("string"), F.lit(": "), d["severity"], F.lit(" - "), d["message"], F.lit("\n"))), "")
    extra = F.when(F.length(context) > most, F.concat(F.substring(context, 1, most), F.lit("...\n"))).otherwise(context)
    return F.concat(
        F.lit("Fix the following "), language, F.lit(" code that has these diagnostics:\n\nDiagnostics:\n"), lines, F.lit("\nCode:\n```"), language, F.lit("\n"), code, F.lit("\n```\n"),
        F.when(F.length(context) > 0, F.concat(F.lit("\nContext:\n"), extra)).otherwise(""),
    )


def completion_text(language: Column, description: Column, code: Column) -> Column:
    head = F.when(F.length(description) > 0, F.concat(F.lit("Fix: "), description, F.lit("\n\n"))).otherwise("")
    return F.concat(head, F.lit("```"), language, F.lit("\n"), code, F.lit("\n```"))


def pairs(examples: DataFrame, *more: str) -> DataFrame:
    """(example_id, prompt, answer) of either format, with more columns if named."""
    of = lambda role: F.filter("messages", lambda m: F.lower(F.trim(m["role"])) == role)
    last = lambda role: F.try_element_at(of(role), F.lit(-1))["content"]
    chat = (F.size("messages") > 0) & F.col("prompt").isNull() & F.col("completion").isNull()
    return examples.where("example_id IS NOT NULL").select("example_id", F.when(chat, last("user")).otherwise(F.col("prompt")).alias("prompt"), F.when(chat, last("assistant")).otherwise(F.col("completion")).alias("answer"), *more)


def code_blocks(text: Column) -> Column:
    """The code of every fenced block that isn't empty; the last one may lack its end."""
    return F.filter(F.regexp_extract_all(text, F.lit(r"(?s)```[\w+#.-]*[ \t]*\r?\n(.*?)(?:```|\z)"), 1), lambda c: F.trim(c) != "")


def _answered(examples: DataFrame) -> DataFrame:
    return pairs(examples).where("prompt IS NOT NULL AND answer IS NOT NULL")


def as_chat(examples: DataFrame, system: str) -> DataFrame:
    """(example_id, line): one chat record in JSON for each pair of prompt and answer, of either format."""
    turn = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return _answered(examples).select("example_id", F.to_json(F.struct(F.array(turn("system", F.lit(system)), turn("user", F.col("prompt")), turn("assistant", F.col("answer"))).alias("messages"))).alias("line"))


def as_lines(examples: DataFrame) -> DataFrame:
    """(example_id, line): one prompt and completion record in JSON for each pair, of either format."""
    return _answered(examples).select("example_id", F.to_json(F.struct("prompt", F.col("answer").alias("completion"))).alias("line"))


def as_custom(examples: DataFrame, fields: dict[str, str]) -> DataFrame:
    """(example_id, line): a JSON record for each pair with the named fields, each taken from example_id, prompt, answer, language or confidence; nulls are left out."""
    e = pairs(with_metadata(examples), "language", "confidence").where("prompt IS NOT NULL AND answer IS NOT NULL")
    return e.select("example_id", F.to_json(F.struct(*(F.col(c).alias(name) for name, c in fields.items()))).alias("line"))


def as_labelled(examples: DataFrame) -> DataFrame:
    """(example_id, text, label): the prompt as text and the answer as its label, of either format."""
    return _answered(examples).select("example_id", F.col("prompt").alias("text"), F.col("answer").alias("label"))


def context_statistics(examples: DataFrame) -> DataFrame:
    """(total_pairs, avg_context_size): pairs, and the mean size of the code in their prompts, rounded down."""
    size = F.aggregate(code_blocks(F.coalesce("prompt", F.lit(""))), F.lit(0).cast("bigint"), lambda a, c: a + F.length(c))
    out = pairs(examples).agg(F.count(F.lit(1)).alias("total_pairs"), F.sum(size).alias("_s"))
    return out.select("total_pairs", F.coalesce(F.floor(F.try_divide(F.col("_s"), F.col("total_pairs"))), F.lit(0)).cast("bigint").alias("avg_context_size"))


def session_statistics(annotations: DataFrame, session: str) -> DataFrame:
    """(session, total_reviewed, quality, n, avg_confidence_adjustment, seconds_per_annotation) of annotations (quality, adjustment, ts), by session and quality."""
    key = F.col(session).alias("session")
    whole = annotations.groupBy(key).agg(F.count(F.lit(1)).alias("total_reviewed"), F.round(F.avg("adjustment"), 6).alias("avg_confidence_adjustment"), F.round(F.try_divide(F.max("ts") - F.min("ts"), F.count(F.lit(1))), 6).alias("seconds_per_annotation"))
    graded = annotations.groupBy(key, "quality").agg(F.count(F.lit(1)).alias("n"))
    return graded.join(whole, "session").select("session", "total_reviewed", "quality", "n", "avg_confidence_adjustment", "seconds_per_annotation")


# fixed values: name, difficulty, language, from, to, message of the errors that are made by default
PATTERNS = [
    ("missing_semicolon", "Beginner", "typescript", '";', '"', "';' expected"), ("typo_in_console", "Beginner", "typescript", "console.log", "console.lg", "Property 'lg' does not exist on type 'Console'. Did you mean 'log'?"),
    ("type_mismatch", "Intermediate", "typescript", "const x: string =", "const x: number =", "Type 'string' is not assignable to type 'number'"), ("undefined_property", "Advanced", "typescript", "user.name", "user.firstName", "Property 'firstName' does not exist on type 'User'"),
    ("missing_mut", "Beginner", "rust", "let mut x = 5;", "let x = 5;", "cannot assign twice to immutable variable"), ("borrow_checker", "Intermediate", "rust", "&data", "&mut data", "cannot borrow as mutable"),
    ("indentation_error", "Beginner", "python", "    return x", "   return x", "IndentationError: unexpected indent"), ("undefined_variable", "Intermediate", "python", "result = x + y", "result = x + z", "NameError: name 'z' is not defined"),
]

# more general ones of our own: name, difficulty, language, from, to, message
ERRORS = [
    ("missing_semicolon", "Beginner", "typescript", ";", "", "';' expected"), ("missing_await", "Intermediate", "typescript", "await ", "", "Property does not exist on type Promise"),
    ("wrong_length", "Beginner", "typescript", ".length", ".len", "Property 'len' does not exist"), ("missing_question_mark", "Intermediate", "rust", "?;", ";", "mismatched types"),
    ("immutable", "Beginner", "rust", "let mut ", "let ", "cannot assign twice to immutable variable"), ("missing_colon", "Beginner", "python", "):", ")", "expected ':'"),
    ("none_equality", "Intermediate", "python", " is None", " = None", "invalid syntax"), ("shadowed_error", "Intermediate", "go", ", err :=", " :=", "assignment mismatch"),
]


def injected(code: DataFrame, errors: list[tuple] = [*PATTERNS, *ERRORS]) -> DataFrame:
    """One made error for each code (code_id, language, code) that an error fits: which one is settled by a hash of the id.

    (code_id, error, difficulty, line, message, broken): all places are changed, the line is that of the first one.
    """
    tried = F.array_compact(F.array(*(F.when((F.col("language") == lang) & F.col("code").contains(old), F.struct(F.lit(name).alias("error"), F.lit(level).alias("difficulty"), F.lit(old).alias("old"), F.lit(new).alias("new"), F.lit(msg).alias("message"))) for name, level, lang, old, new, msg in errors)))
    digit = lambda i: F.instr(F.lit("0123456789abcdef"), F.substring(F.md5(F.col("code_id").cast("string")), i, 1)) - 1
    rows = code.withColumn("_t", tried).where("size(_t) > 0").withColumn("_e", F.col("_t")[(16 * digit(1) + digit(2)) % F.size("_t")])
    line = F.expr(r"size(split(substring_index(code, _e.old, 1), '\n'))")
    return rows.select("code_id", "_e.error", "_e.difficulty", line.alias("line"), "_e.message", F.expr("replace(code, _e.old, _e.new)").alias("broken"))
