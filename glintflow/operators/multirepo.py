"""Diagnostics and dependencies across repositories, without ever pairing the rows of a group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glintflow.functions.text import any_contains, file_name
from glintflow.schema import by_value

SIBLING, LANGUAGE_FACTOR, LANGUAGE_WEIGHT = 0.8, 0.3, 0.3
LEAST_IMPACT = 0.1
BASE_IMPACT = {"Error": 0.5, "Warning": 0.3, "Information": 0.1, "Hint": 0.05}  # fixed values
RELATION_BONUS = {"same_pattern": 0.02, "type_mismatch": 0.1, "api_violation": 0.15, "similar_code": 0.02}  # fixed values


def type_issue(m: Column) -> Column:
    return any_contains(m, ("type", "Type", "interface", "Interface", "struct", "Struct")) & any_contains(m, ("mismatch", "incompatible", "expected", "found"))


def api_issue(m: Column) -> Column:
    return any_contains(m, ("api", "API", "endpoint", "route", "contract", "schema"))


def cross_repo_relations(diagnostics: DataFrame, repository: str) -> DataFrame:
    """For each diagnostic, how many diagnostics of other repositories relate to it, by the first relation that holds.

    Relations in order: the same code, type issues on both sides, an API issue on either side, the same file name.
    All are settled by equality of code, file name and two flags, so the numbers come from counts of these groups (all repositories less the own one),
    by inclusion and exclusion. Nothing is paired and a group of any size is one row.
    """
    from glintflow.session import checkpointed

    m = F.coalesce("message", F.lit(""))
    rows = diagnostics.select("id", "severity", F.col(repository).alias("repo"), F.col("code"), type_issue(m).alias("t"), api_issue(m).alias("a"), file_name(F.col("file")).alias("name"))
    flags = [f"{int(t)}{int(a)}" for t in (False, True) for a in (False, True)]
    each = [F.sum(((F.col("t") == bool(int(f[0]))) & (F.col("a") == bool(int(f[1])))).cast("bigint")).alias(f"rcf{f}") for f in flags]
    cell = checkpointed(rows.groupBy("repo", "code", "name").agg(*each))  # read by the groups and by what is joined with them
    # all coarser groups in one pass; 4, 2 and 1 stand for the keys that a group leaves out
    sets = {"c": ["code"], "rc": ["repo", "code"], "f": ["name"], "rf": ["repo", "name"], "cf": ["code", "name"], "r": ["repo"], "w": []}
    left_out = {p: sum(v for k, v in (("repo", 4), ("code", 2), ("name", 1)) if k not in keys) for p, keys in sets.items()}
    groups = checkpointed(cell.groupingSets([[F.col(k) for k in keys] for keys in sets.values()], "repo", "code", "name").agg(F.grouping_id().cast("int").alias("g"), *(F.sum(f"rcf{f}").alias(f"n{f}") for f in flags)))
    out = cell
    for p, keys in sets.items():
        g = groups.where(F.col("g") == left_out[p]).select(*(F.col(k).alias(f"_{k}") for k in keys), *(F.col(f"n{f}").alias(f"{p}{f}") for f in flags))
        if keys:
            out = out.join(g, reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys))).drop(*(f"_{k}" for k in keys))
        else:
            out = out.withColumn("_one", F.lit(1)).join(F.broadcast(g.withColumn("_one", F.lit(1))), "_one").drop("_one")  # one row
    out = out.select(*(F.col(k).alias(f"_{k}") for k in ("repo", "code", "name")), *(c for c in out.columns if c not in ("repo", "code", "name")))
    out = rows.join(out, reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in ("repo", "code", "name"))))

    def others(t: bool, a: bool, scope: str) -> Column:
        """Rows of other repositories with the flags, in all (w), of the code (c), of the name (f) or of both (cf); nulls equal nothing."""
        own = {"w": "r", "c": "rc", "f": "rf", "cf": "rcf"}[scope]
        n = F.col(f"{scope}{int(t)}{int(a)}") - F.col(f"{own}{int(t)}{int(a)}")
        unknown = F.lit(False)
        if scope.startswith("c"):
            unknown = unknown | F.col("code").isNull()
        if scope.endswith("f"):
            unknown = unknown | F.col("name").isNull()
        return F.when(unknown, 0).otherwise(n)

    four = [(t, a) for t in (False, True) for a in (False, True)]
    add = lambda cs: reduce(lambda x, y: x + y, cs, F.lit(0))
    same = add(others(t, a, "c") for t, a in four)
    typed = F.when(F.col("t"), add(others(True, a, "w") - others(True, a, "c") for a in (False, True))).otherwise(0)
    rest = lambda t, a, all_, coded: others(t, a, all_) - others(t, a, coded)
    open_ = lambda t: ~(F.col("t") & F.lit(t))
    api = add(F.when(open_(t) & (F.col("a") | F.lit(a)), rest(t, a, "w", "c")).otherwise(0) for t, a in four)
    named = add(F.when(open_(t) & ~(F.col("a") | F.lit(a)), rest(t, a, "f", "cf")).otherwise(0) for t, a in four)
    return out.select("id", "severity", "repo", same.cast("bigint").alias("same_pattern"), typed.cast("bigint").alias("type_mismatch"), api.cast("bigint").alias("api_violation"), named.cast("bigint").alias("similar_code"))


def cross_repo_impact(relations: DataFrame) -> DataFrame:
    """0 to 1: severity, number of relations and their kinds."""
    n = reduce(lambda x, y: x + y, (F.col(k) for k in RELATION_BONUS))
    bonus = reduce(lambda x, y: x + y, (F.col(k) * v for k, v in RELATION_BONUS.items()))
    score = by_value(F.col("severity"), BASE_IMPACT, 0.05) + F.least(n * 0.1, F.lit(0.3)) + bonus
    return relations.select("id", "repo", n.alias("related"), F.round(F.least(score, F.lit(1.0)), 6).alias("impact"))


def tags_of(repositories: DataFrame) -> DataFrame:
    """(repository_id, item) of the JSON list in tags."""
    return repositories.select(F.col("id").alias("repository_id"), F.explode(F.array_distinct(F.from_json("tags", "array<string>"))).alias("item"))


def shared_items(uses: DataFrame, scale: float = 10.0) -> DataFrame:
    """Items (repository_id, item) used in several repositories with their impact, √n over the scale; dependencies take 10, types 5."""
    n = uses.select("repository_id", "item").distinct().groupBy("item").agg(F.count(F.lit(1)).alias("repositories"))
    score = F.least(F.sqrt("repositories") / scale, F.lit(1.0))
    return n.where("repositories > 1").withColumn("impact", F.round(score, 9)).where(F.col("impact") >= LEAST_IMPACT)


def shared_counts(rows: DataFrame, column: str) -> DataFrame:
    """Values of a column that stand in more than one row, with their numbers."""
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def related_repositories(repositories: DataFrame) -> DataFrame:
    """(repository_id, kind, group_id, links, strength): members of a monorepo and repositories of one language, each with its number of partners.

    Partners are counted, not paired: of a language, those of the same monorepo are left out.
    """
    r = repositories.select(F.col("id").alias("repository_id"), "monorepo_id", F.col("primary_language").alias("language"))
    mono = r.where("monorepo_id IS NOT NULL").groupBy("monorepo_id").agg(F.count(F.lit(1)).alias("m"))
    lang = r.where("language IS NOT NULL").groupBy("language").agg(F.count(F.lit(1)).alias("l"))
    both = r.where("language IS NOT NULL AND monorepo_id IS NOT NULL").groupBy("language", "monorepo_id").agg(F.count(F.lit(1)).alias("b"))
    siblings = r.join(mono, "monorepo_id").where("m > 1").select("repository_id", F.lit("monorepo_sibling").alias("kind"), F.col("monorepo_id").alias("group_id"), (F.col("m") - 1).alias("links"), F.lit(SIBLING).alias("strength"))
    alike = r.join(lang, "language").join(both, ["language", "monorepo_id"], "left")
    links = F.col("l") - F.coalesce("b", F.lit(1))
    alike = alike.select("repository_id", F.lit("language_similarity").alias("kind"), F.col("language").alias("group_id"), links.alias("links"), F.lit(LANGUAGE_WEIGHT * LANGUAGE_FACTOR).alias("strength"))
    return siblings.unionByName(alike.where("links > 0"))


def repository_impact(repositories: DataFrame, relations: DataFrame, dependencies: DataFrame, types: DataFrame) -> DataFrame:
    """Weighted impact of each repository: relations 0.3, shared dependencies 0.4, shared types 0.3, each at most 1.

    dependencies and types: (repository_id, item).
    """
    rel = relations.groupBy("repository_id").agg(F.least(F.sum(F.col("links") * F.col("strength")), F.lit(1.0)).alias("relation_impact"))

    def shared(uses: DataFrame, scale: float, name: str) -> DataFrame:
        return uses.distinct().join(shared_items(uses, scale), "item").groupBy("repository_id").agg(F.least(F.sum("impact"), F.lit(1.0)).alias(name))

    out = repositories.select(F.col("id").alias("repository_id"))
    for part in (rel, shared(dependencies, 10.0, "dependency_impact"), shared(types, 5.0, "type_impact")):
        out = out.join(part, "repository_id", "left")
    parts = {c: F.round(F.coalesce(c, F.lit(0.0)), 6) for c in ("relation_impact", "dependency_impact", "type_impact")}
    total = parts["relation_impact"] * 0.3 + parts["dependency_impact"] * 0.4 + parts["type_impact"] * 0.3
    return out.select("repository_id", *(v.alias(k) for k, v in parts.items()), F.round(total, 6).alias("overall_impact"))


def foreign_uses(definitions: DataFrame, uses: DataFrame) -> DataFrame:
    """How often each defined type (repository_id, type_name) is used (repository_id, type_name) in other repositories."""
    used = uses.groupBy("type_name", "repository_id").agg(F.count(F.lit(1)).alias("n"))
    total = used.groupBy("type_name").agg(F.sum("n").alias("all_uses"))
    d = definitions.select("repository_id", "type_name").distinct()
    out = d.join(total, "type_name").join(used, ["type_name", "repository_id"], "left")
    return out.select("repository_id", "type_name", (F.col("all_uses") - F.coalesce("n", F.lit(0))).alias("uses_elsewhere")).where("uses_elsewhere > 0")


def lines_naming(lines: DataFrame, names: DataFrame) -> DataFrame:
    """Lines (line_id, text) that hold a known name (name) as a word, by an equality join on their distinct words."""
    words = lines.select("line_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"([A-Za-z_]\w*)"), 1))).alias("name"))
    return words.join(names.select("name").distinct(), "name")


def resolved_imports(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """Where each import (repository_id, workspace, module) leads: local, workspace or external, else unresolved.

    modules: (repository_id, workspace, module). Of several repositories the smallest id is taken.
    """
    local = modules.select("repository_id", "module").distinct().withColumn("_local", F.lit(True))
    sibling = modules.groupBy("workspace", "module").agg(F.min("repository_id").alias("_sibling"))
    outside = modules.groupBy("module").agg(F.min("repository_id").alias("_outside"))
    out = imports.join(local, ["repository_id", "module"], "left").join(sibling, ["workspace", "module"], "left").join(outside, "module", "left")
    target = F.when(F.col("_local"), F.col("repository_id")).otherwise(F.coalesce("_sibling", "_outside"))
    kind = F.when(F.col("_local"), "local").when(F.col("_sibling").isNotNull(), "workspace").when(F.col("_outside").isNotNull(), "external").otherwise("unresolved")
    return out.select("repository_id", "module", kind.alias("kind"), target.alias("target"))


def dependency_neighbours(diagnostics: DataFrame, edges: DataFrame) -> DataFrame:
    """Files that a diagnostic's file imports, and files that import it, whose symbols the diagnostic names.

    diagnostics: (id, file, symbols array); edges: (file, dependency, symbols array). Both sides meet by file and symbol, so that a file which
    many others import is as many keys as it has symbols, and no pair without a common symbol is made.
    """
    named = diagnostics.select("id", "file", F.explode("symbols").alias("s"))
    used = edges.select("file", "dependency", F.explode("symbols").alias("s"))
    out = named.join(used.withColumnRenamed("dependency", "neighbour"), ["file", "s"]).select("id", F.lit("imports").alias("direction"), "neighbour")
    back = named.join(used.select(F.col("dependency").alias("file"), "s", F.col("file").alias("neighbour")), ["file", "s"]).select("id", F.lit("imported_by").alias("direction"), "neighbour")
    return out.unionByName(back).distinct()


IMPORTS = {
    "typescript": r"(?:import\s+[^'\"]*|import\(|require\(|from\s+)['\"]([^'\"]+)['\"]", "javascript": r"(?:import\s+[^'\"]*|import\(|require\(|from\s+)['\"]([^'\"]+)['\"]", "python": r"^\s*(?:from\s+([\w.]+)\s+import|import\s+([\w.]+))",
    "rust": r"^\s*use\s+([\w:]+)", "go": r"^\s*(?:import\s+)?\"([^\"]+)\"",
}
TYPES = r"\b(?:class|struct|enum|trait|interface|type)\s+([A-Z]\w*)"


def code_lines(code: DataFrame) -> DataFrame:
    """(code_id, language, line_no, line) of (code_id, language, code)."""
    return code.select("code_id", "language", F.posexplode(F.split("code", "\n")).alias("line_no", "line"))


def imported_module() -> Column:
    """The module that a row's line imports, by the pattern of its language."""
    found = None
    for language, pattern in IMPORTS.items():
        group = F.regexp_extract("line", pattern, 1) if language != "python" else F.concat(F.regexp_extract("line", pattern, 1), F.regexp_extract("line", pattern, 2))
        found = F.when(F.col("language") == language, group) if found is None else found.when(F.col("language") == language, group)
    return found


def imports_of(code: DataFrame) -> DataFrame:
    """Modules imported on each line."""
    return code_lines(code).withColumn("module", imported_module()).where("module <> ''").select("code_id", "line_no", "module")


def types_of(code: DataFrame) -> DataFrame:
    """Types defined on each line."""
    return code_lines(code).select("code_id", "line_no", F.explode(F.regexp_extract_all("line", F.lit(TYPES), 1)).alias("type_name"))
