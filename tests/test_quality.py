"""The general data quality operators on small rows with every kind of dirt."""

import random

import pytest
from pyspark.sql import functions as F

from glintflow.operators import changefeed, orphans, snapshots

A = "id string, repository_id string, assignee_id string, assigned_by string, assigned_at bigint, table_name string, _key string"
H = "id bigint, member_id string, timestamp bigint, period string"
P = "id string, created_at bigint, name string"
D = "table_name string, key_id string, deleted_at bigint"


def test_orphans(spark):
    a = spark.createDataFrame(
        [("a1", "R1 ", "m1", "gone", 100, "x", "y"), ("a1", "R1 ", "m1", "gone", 100, "x", "y"), ("a2", "r9", "late", "N/A", 100, None, None), ("a3", None, " ", "none", 100, "", ""), ("a4", "r1", "late", None, None, "", "")], A
    )
    h = spark.createDataFrame([(7, "ghost", None, ""), (8, "late", 500_000_000_000_000, ""), (9, "again", 5, ""), (10, "late", 100, "")], H)
    repos = spark.createDataFrame([("r1", 1, "x")], P)
    members = spark.createDataFrame([("m1", 1, None), ("LATE", 5000, None), ("again", 1, None), (None, 3, None)], P)
    deleted = spark.createDataFrame([("team_members", "Gone", 9), ("team_members", "again", 2), ("repositories", "m1", 1)], D)
    found = orphans.diagnostics_orphans(a, h, repos, members, deleted)
    rows = sorted(tuple(r) for r in found.collect())
    assert rows == [
        ("assignment_history", "member_id", "10", "late", "1970-01"), ("assignment_history", "member_id", "7", "missing", "unknown"), ("diagnostic_assignments", "assigned_by", "a1", "deleted", "1970-01"),
        ("diagnostic_assignments", "assignee_id", "a2", "late", "1970-01"), ("diagnostic_assignments", "repository_id", "a2", "missing", "1970-01"),
    ]
    assert orphans.orphan_counts(found).agg(F.sum("n_references")).first()[0] == 5


def test_orphans_of_empty_tables(spark):
    none = lambda s: spark.createDataFrame([], s)
    assert orphans.diagnostics_orphans(none(A), none(H), none(P), none(P), none(D)).count() == 0
    a = spark.createDataFrame([("a", "r", None, None, 1, None, None)], A)
    assert orphans.diagnostics_orphans(a, none(H), none(P), none(P), none(D)).first().reason == "missing"


F_ = "id bigint, assignment_id string, action string, new_value string, timestamp bigint, seq bigint, status string, _pos string"


def replayed(rows):
    """The feed applied row by row in order."""
    seen, state = set(), {}
    one = lambda v, allowed: next((a for a in allowed if a.replace("_", "") == "".join(c for c in v.lower() if c not in " _-")), None)
    member = lambda v: v[12:].strip() if v.lower().startswith("assigned to ") else v.strip()
    rows = [(t // 1000 if t and t >= 10**11 else t, s, a, act, v) for _, a, act, v, t, s, *_ in rows if t is not None and a is not None]
    for _t, s, a, act, v in sorted(rows, key=lambda r: (r[0], r[1])):
        act = act.lower().replace("-", "").replace("_", "")
        if v is None and act != "deleted" or s in seen:
            continue
        seen.add(s)
        if act == "created":
            state[a] = ["open", member(v), "medium"]
        elif act == "deleted":
            state.pop(a, None)
        elif a in state and act == "statuschanged" and one(v, changefeed.STATUSES):
            state[a][0] = one(v, changefeed.STATUSES)
        elif a in state and act == "reassigned":
            state[a][1] = member(v)
        elif a in state and act == "prioritychanged" and one(v, changefeed.PRIORITIES):
            state[a][2] = one(v, changefeed.PRIORITIES)
    return sorted((a, *v) for a, v in state.items())


@pytest.mark.parametrize("seed", range(4))
def test_feed_as_replayed(spark, seed):
    rng = random.Random(seed)
    rows = []
    for seq in range(300):
        act = rng.choice(["created", "Created", "status_changed", "STATUS-CHANGED", "reassigned", "priority_changed", "deleted"])
        v = {"c": "Assigned to m1", "s": rng.choice(["open", " In Progress", "CLOSED", "odd"]), "r": rng.choice(["m7", "Assigned to m8"]), "p": rng.choice(["low", "HIGH", "?"]), "d": None}[act[0].lower()]
        v = None if rng.random() < 0.1 else v
        t = None if rng.random() < 0.05 else rng.randrange(40) + 10**9
        row = (seq, f"a{rng.randrange(8)}", act, v, t * 1000 if t and rng.random() < 0.1 else t, seq, "x", "y")
        rows += [row] * rng.choice([1, 1, 1, 2])
    rng.shuffle(rows)
    got = sorted(tuple(r) for r in changefeed.current_state(spark.createDataFrame(rows, F_)).collect())
    assert got == replayed(rows)


def test_feed_of_json_and_nothing(spark):
    rows = [(1, "a", "created", '{"priority": "HIGH", "assignee_id": " m3 ", "status": "in progress"}', 5, 1, None, None), (2, "b", "status_changed", "open", 6, 2, None, None), (3, None, "created", "m", 6, 3, None, None)]
    assert [tuple(r) for r in changefeed.current_state(spark.createDataFrame(rows, F_)).collect()] == [("a", "in_progress", "m3", "high")]
    assert changefeed.current_state(spark.createDataFrame([], F_)).count() == 0


S = "id bigint, timestamp bigint, file_path string, diagnostics_json string, change string, ts string"


def test_snapshots(spark):
    j = lambda *x: "[" + ", ".join(x) + "]"
    d = lambda i, m="m", extra="": f'{{"id":"{i}","message":"{m}"{extra}}}'
    rows = [
        (1, 10, "./src\\a.py", j(d("x"), d("y"), d("z")), "", ""),
        (2, 20, "src/a.py", '[ {"message": "m", "code": null, "id": "x"}, {"id":"y","message":"M"}]', "", ""),  # y changed, z removed
        (3, 20, "src/a.py", "[{", "", ""), (4, 25, "src/a.py", None, "", ""), (5, 26, "src/a.py", "[] []", "", ""), (6, 27, "src/a.py", '{"id":1}', "", ""),
        (7, 20, "src/a.py", j(d("x"), d("y", "M"), d("w")), "", ""),  # corrects the second: w added
        (8, 10 + 86_400 * 3, "src/a.py", "[]", "", ""), (9, 5, "b", j(d("q")), "", ""), (10, None, "b", j(d("q")), "", ""), (11, 7, None, j(d("q")), "", ""),
    ]
    got = sorted(tuple(r) for r in snapshots.changed_rows(spark.createDataFrame(rows, S)).collect())
    later = 10 + 86_400 * 3
    assert got == sorted([("src/a.py", 20, "y", "changed"), ("src/a.py", 20, "z", "removed"), ("src/a.py", 20, "w", "added"), *(("src/a.py", later, k, "removed") for k in "wxy")])
    assert snapshots.changed_rows(spark.createDataFrame([], S)).count() == 0


def test_snapshots_by_chunks_as_by_rows(spark):
    rng = random.Random(3)
    rows, state = [], {}
    want = set()
    for k in range(12):
        new = {f"d{i}": rng.choice("abc") for i in range(60) if rng.random() < 0.7}
        if k:
            for i in new.keys() | state.keys():
                if new.get(i) != state.get(i):
                    want.add(("f", k * 50_000, i, "added" if i not in state else "removed" if i not in new else "changed"))
        state = new
        items = [f'{{"id":"{i}","code":"{c}"}}' for i, c in new.items()]
        rng.shuffle(items)
        rows.append((k, k * 50_000, "f", f"[{','.join(items)}]", "", ""))
    assert {tuple(r) for r in snapshots.changed_rows(spark.createDataFrame(rows, S)).collect()} == want


def test_hot_keys_are_salted(spark, monkeypatch):
    """Keys spread over many tasks give the rows that they give in one."""
    rng = random.Random(3)
    a = spark.createDataFrame([(f"a{i}", rng.choice(["gone", "gone", "gone", "r1", "late", "none"]), None, None, i, "", "") for i in range(300)], A)
    h = spark.createDataFrame([], H)
    repos = spark.createDataFrame([("r1", 1, "x"), ("late", 150, "x")], P)
    found = lambda: sorted(tuple(r) for r in orphans.diagnostics_orphans(a, h, repos, spark.createDataFrame([], P), spark.createDataFrame([("repositories", "gone", 1)], D)).collect())
    plain = found()
    monkeypatch.setattr(orphans, "HOT", 7)
    assert found() == plain and {r[3] for r in plain} == {"deleted", "late"} and len(plain) > 100
