"""Source code in columns: edits of a range and the functions and classes that a text defines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def applied_edit(content: Column, start_line: Column, start_char: Column, end_line: Column, end_char: Column, new_text: Column) -> Column:
    """The content with a range (lines and characters from 0, end exclusive) replaced; a range outside the content changes nothing."""
    lines = F.split(content, "\n", -1)
    n = F.size(lines)
    inside = (start_line >= 0) & (end_line < n) & ((start_line < end_line) | (start_line == end_line) & (start_char <= end_char))
    inside = inside & (start_char >= 0) & (start_char <= F.length(F.get(lines, start_line))) & (end_char >= 0) & (end_char <= F.length(F.get(lines, end_line)))
    head = F.concat(F.array_join(F.slice(lines, F.lit(1), F.greatest(start_line, F.lit(0))), "\n"), F.when(start_line > 0, "\n").otherwise(""), F.substring(F.get(lines, start_line), F.lit(1), start_char))
    rest = F.slice(lines, F.greatest(end_line + 2, F.lit(1)), F.greatest(n - end_line - 1, F.lit(0)))
    last = F.get(lines, end_line)
    tail = F.concat(F.substring(last, end_char + 1, F.length(last)), F.when(end_line + 1 < n, "\n").otherwise(""), F.array_join(rest, "\n"))
    return F.when(F.coalesce(inside, F.lit(False)), F.concat(head, new_text, tail)).otherwise(content)


# language: pattern with the kind in group 1 and the name in group 2
DEFINITIONS = {
    "typescript": r"\b(function|class|interface)\s+([A-Za-z_$][\w$]*)",
    "javascript": r"\b(function|class)\s+([A-Za-z_$][\w$]*)",
    "python": r"^\s*(def|class)\s+([A-Za-z_]\w*)",
    "rust": r"\b(fn|struct|enum|trait|impl)\s+([A-Za-z_]\w*)",
    "go": r"\b(func|type)\s+(?:\([^)]*\)\s*)?([A-Za-z_]\w*)",
}
FUNCTIONS = ("function", "def", "fn", "func")


def definitions(code: DataFrame) -> DataFrame:
    """(code_id, line_no, kind, name) of what (code_id, language, code) defines, line by line; kind is function or type."""
    lines = code.select("code_id", "language", F.posexplode(F.split("code", "\n")).alias("line_no", "line"))
    word, name = F.lit(None).cast("string"), F.lit(None).cast("string")
    for language, pattern in DEFINITIONS.items():
        here = F.col("language") == language
        word = F.when(here, F.regexp_extract("line", pattern, 1)).otherwise(word)
        name = F.when(here, F.regexp_extract("line", pattern, 2)).otherwise(name)
    rows = lines.withColumns({"_word": word, "name": name}).where("name <> ''")
    return rows.select("code_id", "line_no", F.when(F.col("_word").isin(*FUNCTIONS), "function").otherwise("type").alias("kind"), "name")


# language: patterns with the name in group 1; what a line assigns
VARIABLES = {"typescript": r"\b(?:const|let|var)\s+([A-Za-z_$][\w$]*)", "javascript": r"\b(?:const|let|var)\s+([A-Za-z_$][\w$]*)", "python": r"^\s*([A-Za-z_][\w.]*)\s*=[^=]", "rust": r"\blet\s+(?:mut\s+)?([a-z_]\w*)", "go": r"([A-Za-z_]\w*)\s*:="}
CALL = r"([A-Za-z_]\w*)\("
NO_CALLS = ("if", "for", "while", "switch", "match", "return", "catch", "func", "fn", "def", "function")
CLASSES = ("class", "struct", "impl")


def elements(code: DataFrame) -> DataFrame:
    """(code_id, line_no, kind, name) of what (code_id, language, code) holds, by pattern: functions, classes, types, imports, variables and calls.

    A name counts once a line and kind; a definition is no call. Other languages have none.
    """
    from glintflow.operators.multirepo import imported_module

    lines = code.select("code_id", "language", F.posexplode(F.split("code", "\n")).alias("line_no", "line"))
    none = F.array().cast("array<string>")
    word, name, assigned = F.lit(""), F.lit(""), none
    for language, pattern in DEFINITIONS.items():
        here = F.col("language") == language
        word, name = F.when(here, F.regexp_extract("line", pattern, 1)).otherwise(word), F.when(here, F.regexp_extract("line", pattern, 2)).otherwise(name)
        assigned = F.when(here, F.regexp_extract_all("line", F.lit(VARIABLES[language]), 1)).otherwise(assigned)
    called = F.when(F.col("language").isin(*DEFINITIONS), F.regexp_extract_all("line", F.lit(CALL), 1)).otherwise(none)
    rows = lines.withColumns({"_word": word, "_name": name, "_module": F.coalesce(imported_module(), F.lit(""))})
    kind = F.when(F.col("_word").isin(*FUNCTIONS), "function").when(F.col("_word").isin(*CLASSES), "class").otherwise("type")
    calls = F.filter(F.array_distinct(called), lambda c: ~c.isin(*NO_CALLS) & (c != F.col("_name")))
    one = lambda k, n: F.struct(k.alias("kind"), n.alias("name"))
    each = F.concat(
        F.when(F.col("_name") != "", F.array(one(kind, F.col("_name")))).otherwise(F.array().cast("array<struct<kind:string,name:string>>")),
        F.when(F.col("_module") != "", F.array(one(F.lit("import"), F.col("_module")))).otherwise(F.array().cast("array<struct<kind:string,name:string>>")),
        F.transform(F.array_distinct(assigned), lambda v: one(F.lit("variable"), v)), F.transform(calls, lambda c: one(F.lit("call"), c)),
    )
    return rows.select("code_id", "line_no", F.inline(each))
