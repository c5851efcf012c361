"""Operators without SQL of their own, on small rows and against brute force."""

import json
import re

import pytest
from pyspark.sql import functions as F

from glintflow.functions import patterns, text
from glintflow.operators import dedupe, health, multirepo, privacy, scoring, training
from glintflow.schema import diagnostics_of
from glintflow.sinks import export
from glintflow.sources import readers
from glintflow.sources.tables import table

DIAG = "id string, file string, line bigint, column bigint, severity string, severity_rank int, message string, code string, source string"


def diag(spark, *rows):
    return spark.createDataFrame([(i, f, ln, c, s, {"Error": 1, "Warning": 2, "Information": 3, "Hint": 4}[s], m, None, src) for i, f, ln, c, s, m, src in rows], DIAG)


def test_groups_are_greedy_and_asymmetric(spark):
    d = diag(
        spark, ("1", "a", 1, 0, "Error", "`x` is undefined", "r"), ("2", "a", 9, 0, "Hint", "use 'x'", "r"), ("3", "a", 5, 0, "Error", "value assigned", "r"), ("4", "a", 7, 50, "Error", "never used", "r"),
        ("5", "b", 5, 0, "Error", "`x` again", "r"), ("6", "a", 30, 0, "Error", "borrow one", "rustc"), ("7", "a", 31, 50, "Error", "borrow two", "rustc"), ("8", "a", 1, 3, "Warning", "near", "r"), ("9", "a", 40, 0, "Hint", "used", "r"), ("10", None, 1, 0, "Hint", "no file", "r"),
    )
    got = {r.primary_id: (sorted(r.related), r.confidence) for r in dedupe.grouped(d).collect()}
    assert got == {"1": (["2", "8"], 0.6), "3": (["4", "9"], 0.85), "5": ([], 1.0), "6": (["7"], 0.75)}
    s = dedupe.group_summary(dedupe.grouped(d)).first()
    assert (s.total_groups, s.total_diagnostics, s.primary_errors, s.cascading_errors, s.average_group_size) == (4, 9, 4, 5, 2.25)
    assert dedupe.group_summary(dedupe.grouped(d.limit(0))).first().average_group_size == 0.0


def test_budget_skips_what_does_not_fit(spark):
    rows = [("k", "a", 0.9, 60), ("k", "b", 0.85, 50), ("k", "c", 0.5, 30), ("k", "d", 0.5, 30), ("k", "e", 0.1, 10), ("l", "a", 0.1, 101)]
    got = {(r.key, r.id): r.state for r in scoring.budgeted(spark.createDataFrame(rows, "key string, id string, priority double, tokens bigint"), "key", 100).collect()}
    assert got == {("k", "a"): "essential", ("k", "b"): "excluded", ("k", "c"): "supplementary", ("k", "d"): "excluded", ("k", "e"): "supplementary", ("l", "a"): "excluded"}


def test_capture_masks_before_it_deduplicates(spark):
    d = diag(spark, ("1", "a/x.rs", 1, 0, "Error", "no 'x'", "r"), ("2", "a/x.rs", 1, 0, "Error", "no 'y'", "r"), ("3", "a/.env", 1, 0, "Error", "m", "r"), ("4", "a/x.rs", 2, 0, "Hint", "h", "r"))
    assert [(r.id, r.message) for r in privacy.captured(d).orderBy("id").collect()] == [("1", "no '[STRING]'"), ("4", "h")]
    assert [r.id for r in privacy.captured(d, privacy.Policy.strict()).collect()] == ["1"]


def test_masks(spark):
    one = spark.createDataFrame([("a \"b\" 'c' `d` /* e\nf */ x # g // h",)], "m string")
    r = one.select(text.mask_strings(F.col("m")), text.mask_comments(F.col("m"))).first()
    assert r[0] == "a \"[STRING]\" '[STRING]' `[STRING]` /* e\nf */ x # g // h"
    assert r[1] == "a \"b\" 'c' `d` /* [COMMENT] */ x # [COMMENT]"


@pytest.mark.parametrize("bad", ["", "a" * 2000, "[unclosed", "(?R)", "(*SKIP)x", "a*+", "a+*", "a++", "[[:nope:]]"])
def test_unsafe_patterns(bad):
    with pytest.raises(patterns.UnsafePattern):
        patterns.checked_regex(bad)


def test_globs():
    ok = lambda g, p: re.match(patterns.glob_regex(g), p) is not None
    assert ok("**/*.rs", "a/b/c.rs") and ok("**/*.rs", "c.rs") and not ok("*.rs", "a/c.rs") and ok("a/?[bc]*.py", "a/xb1.py") and not ok("a/[!b].py", "a/b.py") and ok("**/.env*", "x/.env.local")
    assert patterns.gitignore_glob("target/") == "**/target/**" and patterns.gitignore_glob("/a.txt") == "a.txt"
    assert patterns.checked_regex(r"a.*b") and patterns.checked_literal("x")


def test_readers_of_odd_rows(spark):
    raw = spark.createDataFrame(
        [("t", "ts", '{"diagnostics":[{"fileName":"C:\\\\a.ts","start":{"line":1,"character":2},"category":0,"messageText":"m","code":2304,"relatedInformation":[{"file":{"fileName":"file:///b.ts"},"start":{"line":4,"character":0},"messageText":"see"}]}]}'),
         ("r", "rustc", '{"diagnostics":[{"spans":[],"message":"none"},{"spans":[{"file_name":"a.rs","line_start":0,"line_end":3,"column_start":1,"column_end":9}],"level":"note","message":"n","code":{"code":"E1"}}]}'),
         ("e", "eslint", '{"results":[{"filePath":"a.js","messages":[{"line":3,"column":1,"severity":2,"message":"x","ruleId":null}]}]}'), ("g", "other", '[{"uri":"file:///q.go","range":{"start":{"line":1,"character":1},"end":{"line":1,"character":5}},"severity":3,"message":"g"},{"message":"no range"}]'), ("b", "other", "{broken"), ("n", "other", None)],
        "record string, source string, data string",
    )
    got = {r.record: r for r in readers.normalised(raw).collect()}
    assert set(got) == {"t", "r", "e", "g"}
    assert (got["t"].file, got["t"].end_line, got["t"].severity, got["t"].code, got["t"].related[0].file) == ("C:/a.ts", 1, "Warning", "2304", "/b.ts")
    assert (got["r"].start_line, got["r"].severity, got["r"].code) == (0, "Information", "E1") and (got["e"].start_line, got["e"].severity) == (2, "Error") and (got["g"].file, got["g"].severity) == ("/q.go", "Information")
    assert {r.record for r in readers.broken(raw).collect()} == {"b", "n"}


def test_manifests_and_folders(spark, tmp_path):
    m = spark.createDataFrame([("p", json.dumps({"dependencies": {"a": "1"}, "devDependencies": {"b": "^2"}, "scripts": {"x": "turbo run"}}))], "record string, data string")
    assert {(r.name, r.version, r.kind) for r in readers.dependencies(m).collect()} == {("a", "1", "dependencies"), ("b", "^2", "devDependencies")}
    assert m.select(readers.build_system(F.col("data"))).first()[0] == "turbo"
    assert readers.cargo_dependencies('[dependencies]\nserde = "1"\nx = { version = "2" }\ny = { path = "." }') == {"serde": "1", "x": "2", "y": "*"}
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.rs").write_text("x")
    (tmp_path / "src/b.log").write_text("y")
    rows = readers.files_under(spark, str(tmp_path), ignored=["**/*.log"]).collect()
    assert [(r.file.rsplit("/", 1)[1], r.size, r.language) for r in rows] == [("a.rs", 1, "rust")]


def test_cross_repo_relations_as_by_pairs(spark, tiny):
    d = diagnostics_of(table(spark, tiny, "sample_diagnostics")).withColumn("repository", text.project_of(F.col("file"))).orderBy("id").limit(120)
    rows = d.select("id", "repository", "code", "message", "file").collect()
    typed = lambda m: any(k in m for k in ("type", "Type", "interface", "Interface", "struct", "Struct")) and any(k in m for k in ("mismatch", "incompatible", "expected", "found"))
    api = lambda m: any(k in m for k in ("api", "API", "endpoint", "route", "contract", "schema"))
    want = {}
    for x in rows:
        n = [0, 0, 0, 0]
        for o in rows:
            if o.repository == x.repository:
                continue
            if x.code is not None and x.code == o.code:
                n[0] += 1
            elif typed(x.message) and typed(o.message):
                n[1] += 1
            elif api(x.message) or api(o.message):
                n[2] += 1
            elif x.file and o.file and x.file.split("/")[-1] == o.file.split("/")[-1]:
                n[3] += 1
        want[x.id] = n
    got = {r.id: [r.same_pattern, r.type_mismatch, r.api_violation, r.similar_code] for r in multirepo.cross_repo_relations(d, "repository").collect()}
    assert got == want


def test_code(spark):
    c = spark.createDataFrame([(1, "typescript", "import x from 'lib';\nclass Foo {}"), (2, "python", "from a.b import c\nimport d"), (3, "rust", "let mut a = f()?;\nstruct Bar;"), (4, "cobol", "x")], "code_id int, language string, code string")
    assert {(r.code_id, r.module) for r in multirepo.imports_of(c).collect()} == {(1, "lib"), (2, "a.b"), (2, "d")}
    assert {(r.code_id, r.type_name) for r in multirepo.types_of(c).collect()} == {(1, "Foo"), (3, "Bar")}
    made = {r.code_id: r for r in training.injected(c).collect()}
    assert set(made) == {1, 3} and made[1].broken == "import x from 'lib'\nclass Foo {}" and made[1].line == 1 and made[3].error in ("immutable", "missing_question_mark")


def test_health_of_nothing(spark):
    empty = spark.createDataFrame([], "component string, hit_rate double, error_rate double, breaker_open boolean, available boolean")
    assert health.overall(health.component_scores(empty)).first().health == "Unknown"
    old = spark.createDataFrame([("a", 1, False), ("b", 1, True)], "id string, ts bigint, resolved boolean")
    new = spark.createDataFrame([("a", 2), ("b", 2)], "id string, ts bigint")
    assert sorted((r.id, r.ts) for r in health.merged_alerts(old, new).collect()) == [("a", 1), ("b", 1), ("b", 2)]


def test_exports(spark, tmp_path):
    d = spark.createDataFrame([("a,b", 1, None), ('q"x', 2, "l\nm")], "s string, n int, t string")
    assert [r.line for r in export.csv_lines(d).collect()] == ['"a,b",1,null', '"q""x",2,"l\nm"']
    assert json.loads(export.to_format(d, "json").first().line) == {"s": "a,b", "n": 1}
    assert export.to_format(d, "markdown").first().line == "| a,b | 1 | null |" and len(export.to_format(d, "table").first().line) == 156
    export.written(export.to_format(d, "csv"), str(tmp_path / "out"))
    export.appended(d, str(tmp_path / "p"), "n")
    export.appended(d, str(tmp_path / "p"), "n")
    assert spark.read.parquet(str(tmp_path / "p")).count() == 4
    c = export.series_chart(spark.createDataFrame([(1, 2), (0, 5)], "x int, e int"), "x", ["e"], "t")
    assert json.loads(export.chart_document(c, "line", "plotly"))["data"][0]["y"] == [5.0, 2.0]
    for w in ("plain", "chartjs", "vega", "html"):
        assert "5.0" in export.chart_document(c, "line", w)


@pytest.mark.parametrize(
    "place, new, want",
    [((0, 0, 0, 0), "X", "Xab\ncd\nef"), ((0, 1, 1, 1), "-", "a-d\nef"), ((2, 2, 2, 2), "!", "ab\ncd\nef!"), ((1, 0, 2, 0), "", "ab\nef"), ((0, 0, 2, 2), "q", "q"), ((0, 3, 0, 3), "X", "ab\ncd\nef"), ((2, 0, 3, 0), "X", "ab\ncd\nef"), ((1, 1, 1, 0), "X", "ab\ncd\nef")],
)
def test_edits(spark, place, new, want):
    from glintflow.functions.code import applied_edit

    df = spark.createDataFrame([("ab\ncd\nef", *place, new)], "t string, a int, b int, c int, d int, n string")
    assert df.select(applied_edit(*(F.col(c) for c in "tabcdn"))).first()[0] == want


def test_training_texts_of_both_formats(spark):
    two = "See\n```go\na := 1\n```\nand\n```c++\nb = 2\n``` or\n```\nc"
    x = "example_id bigint, prompt string, completion string, messages array<struct<role:string,content:string>>"
    rows = [(1, "p", two, None), (2, None, None, [("system", "s"), ("user", "q"), ("assistant", two)]), (3, "p", None, None), (4, None, None, [("user", "q")]), (5, None, None, None)]
    e = spark.createDataFrame(rows, x)
    assert sorted(tuple(r) for r in training.as_labelled(e).collect()) == [(1, "p", two), (2, "q", two)]
    assert {r.example_id: json.loads(r.line) for r in training.as_lines(e).collect()} == {1: {"prompt": "p", "completion": two}, 2: {"prompt": "q", "completion": two}}
    assert {r.example_id: [m["content"] for m in json.loads(r.line)["messages"]] for r in training.as_chat(e, "s").collect()} == {1: ["s", "p", two], 2: ["s", "q", two]}
    assert training.pairs(e).where("example_id = 2").select(training.code_blocks(F.col("answer"))).first()[0] == ["a := 1\n", "b = 2\n", "c"]


def test_masks_take_whole_texts(spark):
    one = spark.createDataFrame([("x" * 9000 + ' "b" /* c */ end',)], "m string")
    r = one.select(text.mask_strings(F.col("m")), text.mask_comments(F.col("m")), text.mask_strings(F.col("m"), compat=True)).first()
    assert r[0].endswith('x "[STRING]" /* c */ end') and r[1].endswith('"b" /* [COMMENT] */ end') and r[2] == "x" * 8192


def test_groups_equal_the_plain_fold(spark):
    """The indexed fold against every pair of every file, in order."""
    import random

    rng = random.Random(5)
    words = ["type", "Type", "import", "module", "undefined", "initialized", "assigned", "used", "initializer", "before", "borrow", "moved", "lifetime", "Cannot find", "x", "y"]
    rows = []
    for n in range(400):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(4))) + rng.choice(["", " 'a'", " `b`", " 'c' `d`"])
        rows.append((f"{n:03}", f"f{n % 8}", rng.randrange(30), rng.randrange(40), rng.choice(["Error", "Error", "Warning", "Hint"]), text, rng.choice(["rustc", "tsc"])))
    d = diag(spark, *rows)
    want = []
    by_file: dict = {}
    for r in sorted(d.collect(), key=lambda r: (r.file, r.line, r.severity_rank, r.id)):
        by_file.setdefault(r.file, []).append(dedupe._Facts(r))
    for facts in by_file.values():
        taken = set()
        for a in facts:
            if a.id in taken:
                continue
            hits = [(b.id, rule) for b in facts if b is not a and b.id not in taken and (rule := dedupe._match(a, b))]
            taken |= {a.id, *(i for i, _ in hits)}
            want.append((a.id, tuple(i for i, _ in hits), min([1.0, *(dedupe.CONFIDENCE[r] for _, r in hits)])))
    assert sorted((r.primary_id, tuple(r.related), r.confidence) for r in dedupe.grouped(d).collect()) == sorted(want)


def test_related_texts_are_masked(spark):
    d = spark.createDataFrame([("1", "a/b.rs", 1, 1, "m 'x'", [("a/secret.rs", 3, 'says "key"')]), ("2", "a/b.rs", 2, 1, "m", None)], "id string, file string, line int, severity_rank int, message string, related array<struct<file:string,line:int,message:string>>")
    got = {r.id: r for r in privacy.sanitised(d, privacy.Policy(anonymous_paths=True)).collect()}
    assert got["1"].related[0].message == 'says "[STRING]"' and got["1"].related[0].file.endswith("]/secret.rs") and got["1"].related[0].line == 3 and got["2"].related is None


def test_workspace_defaults(spark):
    files = ["src/a.rs", "x/.git/config", "node_modules/p/i.js", "src/t.tmp", ".env.local", "a/target/x.rs", "gone.rs", "src/b.log"]
    d = spark.createDataFrame([(f,) for f in files], "file string")
    there = d.where("file <> 'gone.rs'")
    assert sorted(r.file for r in privacy.workspace(d, ["*.log"], files=there).collect()) == ["src/a.rs"]
    assert sorted(r.file for r in privacy.workspace(d).collect()) == ["gone.rs", "src/a.rs", "src/b.log"]


def test_one_limit_over_all(spark):
    from glintflow.operators import summary

    r = spark.createDataFrame([(i, t) for i, t in enumerate([1, 1, 1, 2, 3, 5, 5, 6])], "id int, ts bigint")
    assert {x.id: x.allowed for x in summary.globally_limited(r, 2, 4).collect()} == {0: True, 1: True, 2: False, 3: False, 4: False, 5: True, 6: True, 7: False}
    assert summary.globally_limited(r.limit(0)).count() == 0


def test_default_error_patterns(spark):
    code = spark.createDataFrame([(1, "typescript", 'const x: string = "hello";\nconsole.log(x);'), (2, "rust", "fn f() {\n    let mut x = 5;\n}"), (3, "python", "def f(x, y):\n    result = x + y\n    return x"), (4, "go", "x")], "code_id int, language string, code string")
    got = {r.code_id: r for r in training.injected(code, training.PATTERNS).collect()}
    assert set(got) == {1, 2, 3} and got[2].error == "missing_mut" and got[2].line == 2 and "let x = 5;" in got[2].broken and got[3].error in ("indentation_error", "undefined_variable")


def test_imports_and_elements(spark):
    from glintflow.functions.code import elements

    code = spark.createDataFrame(
        [(1, "typescript", "import { a } from './a';\nconst b = require('b');\nexport class K {}\nlet c = await import('c');"), (2, "python", "import os\nfrom x.y import z\nclass K:\n    def f(self):\n        v = g(1) == 2"), (3, "rust", "use std::io;\nfn main() { let mut q = h(); }"), (4, "go", 'import "fmt"\nfunc (s *T) f() { v := g() }'), (5, "cobol", "MOVE A TO B(1)"), (6, None, None)],
        "code_id int, language string, code string",
    )
    assert {(r.code_id, r.module) for r in multirepo.imports_of(code).collect()} == {(1, "./a"), (1, "b"), (1, "c"), (2, "os"), (2, "x.y"), (3, "std::io"), (4, "fmt")}
    got = {(r.code_id, r.kind, r.name) for r in elements(code).collect()}
    assert got >= {(1, "class", "K"), (1, "variable", "b"), (1, "variable", "c"), (1, "call", "require"), (2, "function", "f"), (2, "class", "K"), (2, "variable", "v"), (2, "call", "g"), (3, "function", "main"), (3, "variable", "q"), (3, "call", "h"), (4, "function", "f"), (4, "variable", "v"), (4, "call", "g")}
    assert not any(c >= 5 for c, _, _ in got) and (2, "call", "f") not in got


def test_git_states_and_positions(spark):
    from glintflow.operators.incremental import git_state

    s = spark.createDataFrame([(a, b) for a, b in ("M ", " M", "A ", " D", "R ", "C ", "??", "!!", "UU", "T ", "  ")], "a string, b string").select(git_state(F.col("a"), F.col("b")).alias("s"))
    assert [r.s for r in s.collect()] == ["modified", "modified", "added", "deleted", "renamed", "copied", "untracked", "ignored", "conflict", "staged", "modified"]
    raw = spark.createDataFrame([("r", json.dumps({"results": [{"filePath": "a", "messages": [{"line": 1, "message": "m"}] * 2}, {"filePath": "b", "messages": [{"line": 1, "message": "m"}]}]}))], "record string, data string")
    p = [r.position for r in readers.eslint(raw).collect()]
    assert len(set(p)) == 3


def test_merged_metrics(spark):
    from glintflow.operators import team

    m = "member_id string, repository_id string, resolved_count bigint, avg_resolution_time double"
    got = team.merged_metrics(spark.createDataFrame([("a", "r", 2, 10.0)], m), spark.createDataFrame([("a", "r", 1, 40.0), ("b", "r", 1, 5.0)], m)).collect()
    assert {(r.member_id, r.resolved_count, r.avg_resolution_time) for r in got} == {("a", 3, 20.0), ("b", 1, 5.0)}


def test_written_and_appended(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "k string, n int")
    export.written(export.json_lines(rows), str(tmp_path / "lines"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "lines")).collect()) == ['{"k":"a","n":1}', '{"k":"b","n":2}']
    for _ in range(2):
        export.appended(rows, str(tmp_path / "table"), by="k")
    back = spark.read.parquet(str(tmp_path / "table"))
    assert back.count() == 4 and back.where("k = 'a'").agg(F.sum("n")).first()[0] == 2
    with pytest.raises(Exception, match="exists"):
        export.written(export.csv_lines(rows), str(tmp_path / "lines"))


def test_duplicates_by_whole_messages(spark):
    long = "x" * 150
    d = diag(spark, ("1", "a", 1, 0, "Error", long + "1", "r"), ("2", "a", 1, 0, "Error", long + "2", "r"))
    assert dedupe.deduplicated(d).count() == 1 and dedupe.deduplicated(d, None).count() == 2
