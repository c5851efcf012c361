"""Globs, safe regular expressions and wildcards, prepared on the driver."""

from __future__ import annotations

import re

MAX_PATTERN = 1024
# fixed values: constructs that user patterns may not hold
BANNED = ("(?R)", "(?0)", "(?&", "(?P>", "(*", "(?{", "(??{", "\\g<", "\\k<", "(?<=", "(?<!", "(?#")


class UnsafePattern(ValueError):
    """A pattern that is refused."""


def checked_regex(pattern: str) -> str:
    """The pattern, if it is short, compiles and holds no banned construct or stacked quantifier."""
    if not pattern or len(pattern) > MAX_PATTERN:
        raise UnsafePattern("a pattern has 1 to 1024 characters")
    if any(b in pattern for b in BANNED):
        raise UnsafePattern("banned construct")
    if any(q in pattern for q in ("*+", "+*", "++", "**")):
        raise UnsafePattern("stacked quantifiers")
    for name in re.findall(r"\[:(\w*):?", pattern):
        if name not in {"alpha", "digit", "alnum", "upper", "lower", "space", "punct", "xdigit", "word", "blank", "cntrl", "graph", "print", "ascii"}:
            raise UnsafePattern(f"unknown class {name}")
    try:
        re.compile(pattern)
    except re.error as e:
        raise UnsafePattern(str(e)) from None
    return pattern


def checked_literal(text: str) -> str:
    if len(text) > MAX_PATTERN:
        raise UnsafePattern("a literal has at most 1024 characters")
    return text


def glob_regex(glob: str) -> str:
    """An anchored regular expression for a glob with ``**``, ``*``, ``?`` and classes; ``**/`` also stands for no folder."""
    out, i = ["^"], 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
        elif glob.startswith("**", i):
            out.append(".*")
            i += 2
        elif glob[i] == "*":
            out.append("[^/]*")
            i += 1
        elif glob[i] == "?":
            out.append("[^/]")
            i += 1
        elif glob[i] == "[" and "]" in glob[i + 2 :]:
            j = glob.index("]", i + 2)
            out.append("[" + ("^" if glob[i + 1] == "!" else glob[i + 1].replace("\\", "\\\\")) + glob[i + 2 : j].replace("\\", "\\\\") + "]")
            i = j + 1
        else:
            out.append(re.escape(glob[i]) if not glob[i].isalnum() and glob[i] not in "_/ -" else glob[i])
            i += 1
    return "".join([*out, "$"])


def gitignore_glob(pattern: str) -> str:
    """A gitignore line as a glob."""
    if pattern.endswith("/"):
        pattern += "**"
    if pattern.startswith("/"):
        pattern = pattern[1:]
    elif not pattern.startswith("**/"):
        pattern = "**/" + pattern
    return pattern.replace("**/**", "**")


def wildcard_condition(column, pattern: str):
    """A simplified wildcard as the cheapest predicate: all, suffix, prefix, infix, else contains."""
    from pyspark.sql import functions as F

    if pattern == "*":
        return F.lit(True)
    if pattern.startswith("*") and pattern.endswith("*") and len(pattern) > 1:
        return column.contains(pattern[1:-1])
    if pattern.startswith("*"):
        return column.endswith(pattern[1:])
    if pattern.endswith("*"):
        return column.startswith(pattern[:-1])
    if "*" in pattern:
        head, tail = pattern.split("*", 1)
        return column.startswith(head) & column.endswith(tail)
    return column.contains(pattern)
