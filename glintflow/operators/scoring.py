"""Scores of diagnostics, fixes and context: arithmetic on columns, all inside whole-stage code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glintflow.functions.text import any_contains, extension, first_kind, language_of
from glintflow.schema import by_value

# fixed values of the analysis: code, category
RUST_CODES = {"0499": "borrow", "0502": "borrow", "0503": "borrow", "0504": "borrow", "0505": "borrow", "0106": "lifetime", "0621": "lifetime", "0623": "lifetime", "0495": "lifetime", "0382": "move", "0507": "move", "0508": "move", "0509": "move", "0308": "type", "0277": "trait"}
TYPESCRIPT_CODES = {"2339": "property", "2551": "property", "2322": "type", "2345": "type", "2304": "import", "2552": "import", "2314": "generic"}
CATEGORY_SCORE = {"SyntaxError": 100.0, "ParseError": 100.0, "MissingImport": 90.0, "UndefinedVariable": 85.0, "TypeMismatch": 70.0, "MissingProperty": 65.0, "BorrowChecker": 60.0, "LifetimeError": 55.0, "UnusedVariable": 40.0, "CodeQuality": 35.0, "Performance": 30.0}
COMPLEXITY_SCORE = {1: 100.0, 2: 80.0, 3: 60.0, 4: 40.0, 5: 20.0}
SEVERITY_SCORE = {"Error": 100.0, "Warning": 60.0, "Information": 30.0, "Hint": 10.0}
PATTERN_RATE = {"TS2322": 0.85, "TS2339": 0.75, "TS2345": 0.80, "TS1005": 0.95, "E0308": 0.80, "E0384": 0.90, "E0382": 0.70, "E0596": 0.85}
LANGUAGE_RATE = {"typescript": 0.9, "javascript": 0.85, "rust": 0.95, "python": 0.80, "go": 0.85}
SAFETY = {"Error": 0.7, "Warning": 0.8, "Information": 0.9, "Hint": 0.95}
PRIORITY_WEIGHT = {"function": 1.0, "class": 0.8, "type": 0.7, "import": 0.6, "variable": 0.5, "call": 0.4, "dependency": 0.3}
TOKEN_COST = {"function": 50, "class": 30, "type": 25, "dependency": 20, "call": 15, "import": 10, "variable": 5}
TOKENS_A_LINE = 4.0


def is_type_mismatch(m: Column) -> Column:
    return (m.contains("expected") & m.contains("found")) | m.contains("type mismatch") | m.contains("cannot be assigned to")


def is_missing_import(m: Column) -> Column:
    return any_contains(m, ("cannot find", "not found", "unresolved import", "module not found"))


def is_syntax_error(m: Column) -> Column:
    return m.contains("unexpected token") | (m.contains("expected") & any_contains(m, ("';'", "'}'", "')'"))) | m.contains("unterminated")


def message_category(m: Column) -> Column:
    return first_kind([("SyntaxError", is_syntax_error(m)), ("TypeMismatch", is_type_mismatch(m)), ("MissingImport", is_missing_import(m))], "UndefinedVariable")


def message_complexity(category: Column, m: Column) -> Column:
    """1 (trivial) to 6."""
    return (
        F.when(category == "SyntaxError", F.when(any_contains(m, ("missing", "expected")), 1).otherwise(2))
        .when(category == "MissingImport", 2)
        .when(category == "TypeMismatch", F.when(m.contains("cannot be assigned"), 3).otherwise(4))
        .when(category == "UndefinedVariable", 6)
        .otherwise(5)
    )


def message_confidence(m: Column, has_context: Column) -> Column:
    bonus = lambda c: F.when(c, 0.1).otherwise(0.0)
    return F.least(F.lit(1.0), F.lit(0.7) + bonus(F.length(m) > 50) + bonus(has_context) + bonus(is_syntax_error(m) | is_type_mismatch(m)))


def rust_kind(code: Column, m: Column) -> Column:
    """By a known code, else by the message."""
    number = F.lpad(F.regexp_replace(F.coalesce(code, F.lit("")), "^E", ""), 4, "0")
    by_message = first_kind(
        [("borrow", m.contains("borrow")), ("lifetime", any_contains(m, ("lifetime", "does not live long enough"))), ("move", m.contains("move")), ("type", m.contains("expected") & m.contains("found")), ("trait", m.contains("trait") & m.contains("not implemented"))],
        "unknown",
    )
    return F.coalesce(by_value(number, RUST_CODES), by_message)


def typescript_kind(code: Column, m: Column) -> Column:
    """By a known number without prefix, else by the message."""
    by_message = first_kind([("property", m.contains("Property") & m.contains("does not exist")), ("type", m.contains("Type") & m.contains("is not assignable")), ("import", m.contains("Cannot find"))], "unknown")
    return F.coalesce(by_value(code, TYPESCRIPT_CODES), by_message)


# kind: (category, complexity, cascading); fixed values
KINDS = {
    "rust": {"borrow": ("BorrowChecker", 3, True), "lifetime": ("LifetimeError", 4, False), "move": ("BorrowChecker", 2, False), "type": ("TypeMismatch", 2, False), "trait": ("TypeMismatch", 3, False)},
    "typescript": {"property": ("MissingProperty", 2, False), "type": ("TypeMismatch", 3, False), "import": ("MissingImport", 2, False), "generic": ("TypeMismatch", 2, False)},
}


def analysed(diagnostics: DataFrame) -> DataFrame:
    """Adds language, kind, category, fix_complexity and cascading."""
    m, s = F.col("message"), F.lower(F.coalesce("source", F.lit("")))
    language = F.when(any_contains(s, ("typescript", "eslint")), "typescript").when(s.contains("rust"), "rust")
    kind = F.when(F.col("language") == "rust", rust_kind(F.col("code"), m)).when(F.col("language") == "typescript", typescript_kind(F.col("code"), m)).otherwise("unknown")

    def of(i: int, default) -> Column:
        out = None
        for lang, kinds in KINDS.items():
            for k, v in kinds.items():
                c = (F.col("language") == lang) & (F.col("kind") == k)
                out = F.when(c, F.lit(v[i])) if out is None else out.when(c, F.lit(v[i]))
        return out.otherwise(F.lit(default))

    rows = diagnostics.withColumn("language", language).withColumn("kind", kind)
    several = (F.col("kind") == "borrow") & m.contains("cannot borrow") & m.contains("as mutable more than once")
    short = (F.col("kind") == "borrow") & m.contains("does not live long enough")
    return rows.withColumns({"category": F.when(short, "LifetimeError").otherwise(of(0, "Unknown")), "fix_complexity": F.when(several, 4).otherwise(of(1, 3)), "cascading": of(2, False)})


def prioritised(groups: DataFrame) -> DataFrame:
    """Priority of groups (severity, line, related_count, category, fix_complexity, cascading), 0 to 100, with its parts."""
    severity = by_value(F.col("severity"), SEVERITY_SCORE, 10.0)
    location = F.when(F.col("line") < 50, 90.0).when(F.col("line") < 200, 70.0).when(F.col("line") < 500, 50.0).otherwise(30.0)
    n = F.col("related_count")
    base = F.when(n == 0, 20.0).when(n <= 2, 40.0).when(n <= 5, 60.0).when(n <= 10, 80.0).otherwise(100.0)
    impact = F.when(F.col("cascading"), F.least(base * 1.5, F.lit(100.0))).otherwise(base)
    complexity = by_value(F.col("fix_complexity"), COMPLEXITY_SCORE, 30.0)
    category = by_value(F.col("category"), CATEGORY_SCORE, 50.0)
    rows = groups.withColumns({"severity_score": severity, "location_score": location, "impact_score": impact, "complexity_score": complexity, "category_score": category})
    total = F.col("severity_score") * 0.35 + F.col("location_score") * 0.15 + F.col("impact_score") * 0.25 + F.col("complexity_score") * 0.15 + F.col("category_score") * 0.10
    return rows.withColumns({"priority": F.round(total, 6), "impact_radius": (n + F.when(F.col("cascading"), 5).otherwise(0)).cast("bigint")})


def priority_summary(p: DataFrame) -> DataFrame:
    return p.agg(F.count(F.lit(1)).alias("groups"), F.count_if(F.col("priority") >= 70).alias("high_priority"), F.count_if(F.col("fix_complexity") <= 2).alias("quick_fixes"), F.count_if(F.col("impact_radius") > 5).alias("cascading"), F.coalesce(F.round(F.avg("priority"), 6), F.lit(0.0)).alias("average_priority"))


def fix_order(p: DataFrame, top: int) -> DataFrame:
    """The ``top`` groups by priority with their rank and reasons."""
    reasons = F.concat_ws(
        ", ", F.when(F.col("severity_score") >= 90, "severe"), F.when(F.col("impact_score") >= 80, "affects many"), F.when(F.col("complexity_score") >= 80, "quick fix"), F.when(F.col("location_score") >= 80, "early in file")
    )
    best = p.withColumn("reason", F.when(reasons == "", "standard").otherwise(reasons)).orderBy(F.desc("priority"), "id").limit(top)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("priority"), "id")))  # at most ``top`` rows


def fix_confidence(rows: DataFrame, fix_text: Column, has_action: Column) -> DataFrame:
    """Weighted confidence of a fix for each diagnostic."""
    pattern = F.when(F.col("code").isNull(), 0.3).otherwise(by_value(F.col("code"), PATTERN_RATE, 0.5))
    n = F.length(fix_text)
    size = F.when(n <= 20, 0.9).when(n <= 50, 0.8).when(n <= 100, 0.6).when(n <= 200, 0.4).otherwise(0.2)
    language = by_value(language_of(F.col("file")), LANGUAGE_RATE, 0.5)
    safety = by_value(F.col("severity"), SAFETY, 0.7)
    score = pattern * 0.25 + size * 0.15 + pattern * 0.20 + safety * 0.15 + language * 0.10 + F.when(has_action, 0.95).otherwise(0.5) * 0.15
    return rows.withColumn("confidence", F.round(score, 6))


def confidence_bucket(score: Column) -> Column:
    return F.when(score >= 0.9, "Certain").when(score >= 0.7, "Probable").when(score >= 0.5, "Possible").otherwise("Uncertain")


def routed(score: Column, auto: float = 0.9, suggest: float | None = None) -> Column:
    """apply, confirm or reject; the second threshold is 0.7 of the first unless given."""
    return F.when(score >= auto, "apply").when(score >= (auto * 0.7 if suggest is None else suggest), "confirm").otherwise("reject")


def verify_complexity(message: Column, file: Column) -> Column:
    """Complexity of verifying a fix by words of the message and the file's extension, at most 1."""
    m = F.lower(message)
    add = lambda words, v: F.when(any_contains(m, words), v).otherwise(0.0)
    ext = extension(file)
    kind = F.when(ext.isin("ts", "tsx"), 0.1).when(ext == "rs", 0.15).when(ext.isin("cpp", "cc", "cxx"), 0.2).otherwise(0.0)
    return F.least(F.lit(1.0), F.round(add(("type", "interface"), 0.3) + add(("async", "await"), 0.2) + add(("generic", "template"), 0.4) + add(("undefined", "not found"), 0.1) + add(("semicolon", "syntax"), 0.05) + kind, 6))


def type_relevance(message: Column) -> dict[str, Column]:
    m = F.lower(message)
    pick = lambda words, low: F.when(any_contains(m, words), 1.0).otherwise(low)
    return {
        "type_error": pick(("type", "cannot assign", "incompatible"), 0.5), "import_error": pick(("cannot find", "import", "module"), 0.3), "variable_error": pick(("undefined", "not defined", "variable"), 0.4),
        "function_error": pick(("function", "method", "call"), 0.5), "class_error": pick(("class", "struct", "interface"), 0.4),
    }


def linear_proximity(item_line: Column, line: Column, reach: int) -> Column:
    d = F.abs(item_line - line)
    return F.when(d <= reach, 1.0 - d / float(reach) * 0.5).otherwise(0.5)


def stepped_proximity(item_line: Column, line: Column) -> Column:
    d = F.abs(item_line - line)
    return F.when(d <= 3, 1.0).when(d <= 10, 0.8).when(d <= 30, 0.6).when(d <= 50, 0.4).otherwise(0.2)


def direction_factor(item_line: Column, line: Column) -> Column:
    return F.when(item_line < line, 1.1).when(item_line == line, 1.0).otherwise(0.9)


def element_relevance(kind: Column, name: Column, message: Column, inside: Column, near: Column) -> Column:
    """Relevance of a context element to a message, by its kind; at most 1."""
    named = message.contains(name)
    when = lambda c, v: F.when(c, v).otherwise(1.0)
    factor = (
        F.when(kind == "function", when(named, 1.5) * when(inside, 1.3))
        .when(kind == "class", when(named, 1.4) * when(any_contains(message, ("type", "interface", "struct")), 1.2))
        .when(kind == "import", when(named, 1.3))
        .when(kind == "type", F.when(named, 1.8).when(message.contains("type"), 1.3).otherwise(1.0))
        .when(kind == "variable", F.when(named, 1.4).when(near, 1.2).otherwise(1.0))
        .when(kind == "call", when(named, 1.3))
        .when(kind == "dependency", when(named, 1.4))
        .otherwise(1.0)
    )
    return F.least(F.lit(1.0), F.round(by_value(kind, PRIORITY_WEIGHT, 0.0) * factor, 6))


def element_tokens(kind: Column, lines: Column) -> Column:
    """Estimated tokens of a context element of so many lines."""
    body = F.when(kind.isin("function", "class"), F.floor(lines * TOKENS_A_LINE)).when(kind == "type", F.floor(lines * TOKENS_A_LINE * 0.5)).otherwise(0)
    return (by_value(kind, TOKEN_COST, 0) + body).cast("bigint")


def context_relevance(parts: dict[str, Column]) -> Column:
    """0 to 1 by which parts a context has."""
    weight = {"function": 0.3, "class": 0.2, "imports": 0.1, "types": 0.15, "variables": 0.15, "calls": 0.1}  # fixed values
    out = F.lit(0.0)
    for k, w in weight.items():
        out = out + F.when(parts[k], w).otherwise(0.0)
    return F.least(F.lit(1.0), F.round(out, 6))


def budgeted(elements: DataFrame, key: str, budget: int) -> DataFrame:
    """Context elements (key, id, priority, tokens) taken into a budget: essential, supplementary or excluded.

    A greedy fold in three passes by priority (0.8, 0.4, rest), in order of priority; what doesn't fit is skipped and smaller ones may still fit.
    The state of the fold is a number, so it runs as a higher-order function over each key's sorted array, in the JVM.
    """
    tier = F.when(F.col("priority") >= 0.8, 0).when(F.col("priority") >= 0.4, 1).otherwise(2)
    rows = elements.select(key, F.struct(tier.alias("tier"), (-F.col("priority")).alias("p"), "id", "tokens").alias("e"))
    packed = rows.groupBy(key).agg(F.array_sort(F.collect_list("e")).alias("es"))
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast("array<struct<id:string,took:boolean>>").alias("got"))

    def step(acc, e):
        fits = acc["used"] + e["tokens"] <= budget
        return F.struct((acc["used"] + F.when(fits, e["tokens"]).otherwise(0)).alias("used"), F.concat(acc["got"], F.array(F.struct(e["id"].cast("string").alias("id"), fits.alias("took")))).alias("got"))

    done = packed.select(key, "es", F.aggregate("es", start, step).alias("r"))
    each = done.select(key, F.col("r.used").alias("tokens_used"), F.explode(F.arrays_zip("es", "r.got")).alias("z"))
    state = F.when(~F.col("z.got.took"), "excluded").when(F.col("z.es.tier") == 0, "essential").otherwise("supplementary")
    return each.select(key, F.col("z.got.id").alias("id"), state.alias("state"), "tokens_used")


def within_thresholds(elements: DataFrame, priority: float | None = None, tokens: int | None = None) -> DataFrame:
    """Elements of a priority or more, of so many tokens or less."""
    if priority is not None:
        elements = elements.where(F.col("priority") >= priority)
    return elements if tokens is None else elements.where(F.col("tokens") <= tokens)


def nearest_name(words: DataFrame, known: DataFrame, most: int) -> DataFrame:
    """The nearest of a short list of known names (name) for each word, within ``most`` edits; the first best by name.

    The list is meant to be a vocabulary of bounded size: more than 1000 names are refused.
    """
    names = [r[0] for r in known.select("name").where("name IS NOT NULL").distinct().limit(1001).collect()]
    if len(names) > 1000:
        raise ValueError("the vocabulary has more than 1000 names")
    tried = F.array_sort(F.array(*(F.struct(F.levenshtein(F.col("word"), F.lit(n)).alias("d"), F.lit(n).alias("name")) for n in sorted(names))))
    best = tried[0]
    return words.select("word", F.when(best["d"] <= most, best["name"]).alias("nearest"))


def verification_adjustment(compiles: Column, tests_pass: Column, warnings: Column, side_effects: Column) -> Column:
    score = F.lit(0.5) + F.when(compiles, 0.3).otherwise(0.0) + F.when(tests_pass, 0.2).otherwise(0.0) - F.least(warnings * 0.05, F.lit(0.2)) - F.least(side_effects * 0.1, F.lit(0.2))
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 6)


def fix_quality(diagnostics: Column, confidence: Column) -> Column:
    return F.when(diagnostics == 0, "Perfect").when(confidence > 0.9, "Good").when(confidence > 0.7, "Acceptable").when(confidence > 0.5, "Poor").otherwise("Incorrect")
