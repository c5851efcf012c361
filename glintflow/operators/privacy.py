"""The privacy pipeline: what may leave a workspace, and in which form."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glintflow.functions.patterns import glob_regex, gitignore_glob
from glintflow.functions.text import anonymous_path, mask_comments, mask_strings
from glintflow.operators.dedupe import deduplicated, worst_per_file

_BASE = ("**/.env*", "**/secrets/**", "**/.git/**", "**/node_modules/**", "**/*.log", "**/dist/**", "**/build/**")  # fixed values


# fixed values: what a workspace always leaves out
DEFAULT_IGNORED = (
    "**/.git/**", "**/.svn/**", "**/.hg/**", "**/node_modules/**", "**/vendor/**", "**/target/**", "**/.cargo/**", "**/dist/**", "**/build/**", "**/out/**", "**/_build/**", "**/.idea/**", "**/.vscode/**", "**/Thumbs.db", "**/.DS_Store", "**/tmp/**",
    "**/temp/**", "**/*.tmp", "**/*.temp", "**/*.swp", "**/*.swo", "**/~*", "**/.cache/**", "**/__pycache__/**", "**/.pytest_cache/**", "**/coverage/**", "**/.coverage", "**/htmlcov/**", "**/.env*", "**/secrets/**", "**/credentials/**",
)


@dataclass(frozen=True)
class Policy:
    exclude: tuple[str, ...] = _BASE
    mask_strings: bool = True
    mask_comments: bool = False
    errors_only: bool = False
    per_file: int = 50
    anonymous_paths: bool = False
    compat: bool = False  # texts cut before they are masked

    # the globs and limits of both are fixed values

    @classmethod
    def strict(cls) -> Policy:
        return cls((*_BASE, "**/config/**", "**/.ssh/**", "**/credentials/**"), True, True, True, 20, True)

    @classmethod
    def permissive(cls) -> Policy:
        return cls(("**/.git/**", "**/node_modules/**"), False, False, False, 100, False)


def without(rows: DataFrame, globs: tuple[str, ...] | list[str], column: str = "file") -> DataFrame:
    """Rows whose path matches none of the globs: one pass of a joint pattern."""
    if not globs:
        return rows
    return rows.where(~F.coalesce(F.col(column).rlike("|".join(f"(?:{glob_regex(g)})" for g in globs)), F.lit(False)))


def ignored(rows: DataFrame, gitignore: list[str]) -> DataFrame:
    return without(rows, [gitignore_glob(p) for p in gitignore if p.strip() and not p.startswith("#")])


def workspace(rows: DataFrame, gitignore: list[str] | None = None, more: tuple[str, ...] = (), files: DataFrame | None = None) -> DataFrame:
    """Rows of files that belong to a workspace: not ignored by default, by its gitignore lines or by further globs, and there (files: file), if these are given."""
    rows = ignored(without(rows, (*DEFAULT_IGNORED, *more)), gitignore or [])
    return rows if files is None else rows.join(files.select("file").distinct(), "file", "left_semi")


def selected(rows: DataFrame, severities: list[str] | None = None, sources: list[str] | None = None, include: list[str] | None = None, exclude: list[str] | None = None, most: int | None = None) -> DataFrame:
    """Rows by lists of severities and sources and by globs; ``most`` rows by id."""
    if severities:
        rows = rows.where(F.col("severity").isin(severities))
    if sources:
        rows = rows.where(F.col("source").isin(sources))
    if include:
        rows = rows.where(reduce(lambda a, b: a | b, (F.col("file").rlike(glob_regex(g)) for g in include)))
    rows = without(rows, exclude or [])
    return rows if most is None else rows.orderBy("id").limit(most)


def sanitised(diagnostics: DataFrame, policy: Policy = Policy()) -> DataFrame:  # noqa: B008
    """Excluded files and lesser severities out, texts and paths masked, then the worst of each file."""
    rows = without(diagnostics, policy.exclude)
    if policy.errors_only:
        rows = rows.where("severity = 'Error'")
    m = F.col("message")
    if policy.mask_strings:
        m = mask_strings(m, policy.compat)
    if policy.mask_comments:
        m = mask_comments(m, policy.compat)
    rows = rows.withColumn("message", m)
    if "related" in rows.columns:  # the texts and places that a diagnostic refers to
        text = lambda r: mask_strings(r["message"], policy.compat) if policy.mask_strings else r["message"]
        place = lambda r: anonymous_path(r["file"]) if policy.anonymous_paths else r["file"]
        rows = rows.withColumn("related", F.transform("related", lambda r: F.struct(place(r).alias("file"), r["line"].alias("line"), text(r).alias("message"))))
    if policy.anonymous_paths:
        rows = rows.withColumn("file", anonymous_path(F.col("file")))
    return worst_per_file(rows, policy.per_file)


def captured(diagnostics: DataFrame, policy: Policy = Policy()) -> DataFrame:  # noqa: B008
    """The capture pipeline: privacy before deduplication, so that rows that differ in masked text alone are one."""
    return deduplicated(sanitised(diagnostics, policy))
