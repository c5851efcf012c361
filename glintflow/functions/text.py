"""Column expressions over messages and paths: names, kinds, masks and patterns. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_kind(kinds: list[tuple[str, Column]], default: str) -> Column:
    """The name of the first condition that holds."""
    out = F.when(kinds[0][1], kinds[0][0])
    for name, holds in kinds[1:]:
        out = out.when(holds, name)
    return out.otherwise(default)


def any_contains(text: Column, parts: tuple[str, ...]) -> Column:
    out = text.contains(parts[0])
    for p in parts[1:]:
        out = out | text.contains(p)
    return out


# the words of the next four, and the patterns and marks of the masks below, are fixed values


def symbol_type(message: Column, code: Column) -> Column:
    """What kind of symbol a diagnostic is about: by message or code, methods and variables by message alone."""
    either = [(k, F.coalesce(message.contains(k) | code.contains(k), F.lit(False))) for k in ("function", "class", "struct", "trait", "enum")]
    return first_kind([*either, ("method", message.contains("method")), ("variable", message.contains("variable"))], "unknown")


def is_symbol(message: Column, code: Column) -> Column:
    return code.isNotNull() & (any_contains(code, ("function", "class", "struct", "trait", "enum", "type")) | any_contains(message, ("method", "variable")))


def reference_type(message: Column) -> Column:
    return first_kind([(k, message.contains(k)) for k in ("import", "module", "type", "function", "variable")], "undefined")


def is_reference(message: Column) -> Column:
    return any_contains(message, ("undefined", "not found", "cannot find", "unresolved", "import", "reference"))


def quoted_name(message: Column, fallback: Column) -> Column:
    """The first name between backticks, else between single quotes, else the fallback; an empty quote counts as a name."""
    return (
        F.when(message.rlike("`[^`]*`"), F.regexp_extract(message, "`([^`]*)`", 1))
        .when(message.rlike("'[^']*'"), F.regexp_extract(message, "'([^']*)'", 1))
        .otherwise(fallback)
    )


def project_of(path: Column) -> Column:
    """The folder under the first ``src/``, else the parent folder, else root."""
    return (
        F.when(path.rlike("src/[^/]*/"), F.regexp_extract(path, "src/([^/]*)/", 1))
        .when(path.rlike("[^/]+/[^/]*$"), F.regexp_extract(path, "([^/]+)/[^/]*$", 1))
        .otherwise("root")
    )


def identifiers(message: Column) -> Column:
    """The set of identifiers in single quotes or backticks."""
    return F.array_distinct(F.concat(F.regexp_extract_all(message, F.lit("'([a-zA-Z_][a-zA-Z0-9_]*)'"), 1), F.regexp_extract_all(message, F.lit("`([a-zA-Z_][a-zA-Z0-9_]*)`"), 1)))


def message_types(message: Column) -> Column:
    """Types named in a message, pattern by pattern."""
    patterns = ("expected `([^`]+)`", "found `([^`]+)`", "type `([^`]+)`", ": ([A-Z][a-zA-Z0-9_]*)")  # fixed values
    return F.concat(*(F.regexp_extract_all(message, F.lit(p), 1) for p in patterns))


def message_numbers(message: Column) -> Column:
    """Words that are whole numbers."""
    return F.transform(F.filter(F.split(message, r"\s+"), lambda w: w.rlike("^[0-9]{1,9}$")), lambda w: w.cast("bigint"))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def directory(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_extract(path, "^(.*)/[^/]*$", 1)).otherwise("")


# fixed values
LANGUAGE_OF = {"ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "rs": "rust", "py": "python", "go": "go"}


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)


def language_of(path: Column) -> Column:
    from glintflow.schema import by_value

    return by_value(extension(path), LANGUAGE_OF, "unknown")


def normal_message(message: Column) -> Column:
    """The first that applies: runs of spaces to one, trailing full stops off, a capital first letter."""
    return (
        F.when(message.contains("  "), F.trim(F.regexp_replace(message, r"[\s\p{Z}]+", " ")))
        .when(message.endswith("."), F.regexp_replace(message, r"\.+$", ""))
        .when(message.rlike("^[a-z]"), F.concat(F.upper(F.substring(message, 1, 1)), F.regexp_replace(message, "(?s)^.", "")))
        .otherwise(message)
    )


MASK_LIMIT = 8192


def mask_strings(text: Column, compat: bool = False) -> Column:
    """Quoted strings replaced by a mark; ``compat`` keeps the first 8192 characters only."""
    t = F.substring(text, 1, MASK_LIMIT) if compat else text
    t = F.regexp_replace(t, '"[^"]*"', '"[STRING]"')
    t = F.regexp_replace(t, "'[^']*'", "'[STRING]'")
    return F.regexp_replace(t, "`[^`]*`", "`[STRING]`")


def mask_comments(text: Column, compat: bool = False) -> Column:
    """Comments replaced by a mark: line comments at the end of the text, blocks anywhere, then hash comments; ``compat`` as above."""
    t = F.substring(text, 1, MASK_LIMIT) if compat else text
    t = F.regexp_replace(t, r"//[^\n]*\z", "// [COMMENT]")
    t = F.regexp_replace(t, r"/\*[\s\S]*?\*/", "/* [COMMENT] */")
    return F.regexp_replace(t, r"#[^\n]*\z", "# [COMMENT]")


def anonymous_path(path: Column) -> Column:
    """The directory by six digits of its SHA-256, and the file's name."""
    return F.when(path == "", path).otherwise(F.concat(F.lit("[DIR_"), F.substring(F.sha2(directory(path), 256), 1, 6), F.lit("]/"), file_name(path)))


def normal_uri(path: Column) -> Column:
    """Without ``file://``, with forward slashes."""
    return F.regexp_replace(F.regexp_replace(path, "^file://", ""), r"\\", "/")


def shared_words(a: Column, b: Column) -> Column:
    """Common words over the words of the larger set; null if both are empty."""
    x, y = (F.array_distinct(F.filter(F.split(c, r"\s+"), lambda w: w != "")) for c in (a, b))
    return F.try_divide(F.size(F.array_intersect(x, y)).cast("double"), F.greatest(F.size(x), F.size(y)))


def name_parts(name: Column) -> Column:
    """Parts of a camelCase or snake_case name."""
    return F.filter(F.split(F.regexp_replace(name, "(?<!^)([A-Z])", "_$1"), "_"), lambda p: p != "")


def name_similarity(name: Column, text: Column) -> Column:
    """1 exact, 0.9 but for case, 0.7 a word in part, 0.5 a part of the name, else 0."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    partly = F.exists(words, lambda w: w.contains(name) | name.contains(w))
    parts = F.exists(name_parts(name), lambda p: (F.length(p) > 3) & F.lower(text).contains(F.lower(p)))
    return F.when(text.contains(name), 1.0).when(F.lower(text).contains(F.lower(name)), 0.9).when(partly, 0.7).when(parts, 0.5).otherwise(0.0)
