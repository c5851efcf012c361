import random

from glintflow.llm import formatdup

S = "k string, m string, c string, s string, id string, root string"
ARGS = ("t", "k", "m", "c", "s")


def test_spellings(spark):
    rows = [
        ("b", "Cannot  find 'x'.", "E1", "rustc", "", ""), ("a", "cannot find x", "[e1]", "RustC ", None, None), ("c", '{"CODE":"E1","Source":"rustc","message":"Cannot\\u00a0find `x`"}', None, None, "", ""), ("d", "source = rustc |\nmessage: cannot find x | Code=E1", None, None, "", ""),
        ("d", "source = rustc |\nmessage: cannot find x | Code=E1", None, None, "", ""), ("e", "cannot find y", "E1", "rustc", "", ""), ("f", "cannot find x", "E1", None, "", ""), ("g", "message: cannot find x", None, None, "", ""), ("h", None, None, None, "", ""), ("i", " .", "", "-", "", ""), (None, "cannot find x", "E1", "rustc", "", ""),
        ("j", "code: |message: q|source: r", None, None, "", ""), ("k", "q", None, "r", "", ""), ("l", "{broken", None, None, "", ""), ("m", "NAÏVE", None, "x", "", ""), ("n", "naïve", None, "x", "", ""),
    ]
    df = spark.createDataFrame(rows, S)
    assert sorted((r.first_id, r.copy_id) for r in formatdup.copies(df, *ARGS).collect()) == [("a", "b"), ("a", "c"), ("a", "d"), ("h", "i"), ("j", "k"), ("m", "n")]
    n = {r.first_id: r.copies for r in formatdup.collapsed(df, *ARGS).collect()}
    assert n == {"a": 4, "e": 1, "f": 1, "g": 1, "h": 2, "j": 2, "l": 1, "m": 2}
    assert formatdup.copies(df.limit(0), *ARGS).count() == 0 == formatdup.collapsed(df.limit(0), *ARGS).count()


def test_hot_groups_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(formatdup, "HOT", 1)
    rng = random.Random(1)
    rows = [(f"{i:04d}", "hot" if i % 3 == 0 else f"text {i % 50}" if i % 3 == 1 else "é" * 20_000 + str(i % 2), "c", "s", "", "") for i in range(600)]
    rng.shuffle(rows)
    got = {(r.first_id, r.copy_id) for r in formatdup.copies(spark.createDataFrame(rows, S), *ARGS).collect()}
    first: dict = {}
    for k, m, *_ in sorted(rows):
        first.setdefault(m, k)
    assert got == {(first[m], k) for k, m, *_ in rows if first[m] != k}


NESTED = "id string, record struct<kind:string, spans:array<struct<file:string, line:int>>, notes:map<string,struct<text:string, tags:array<string>>>, extra:string>"


def _nested(spark):
    note = lambda text, *tags: (text, list(tags))
    a = ("Type  mismatch!", [("src/a.rs", 3), ("b.rs", 4)], {"Why": note("Expected `u8`", "x", "Y"), "how": note("cast it")}, None)
    rows = [
        ("2", a), ("1", ("type mismatch", [("SRC a.rs", 3), ("b rs", 4)], {"HOW": note("Cast it."), "why": note("expected u8", "y", "X")}, "")),  # children permuted at two levels, other spellings
        ("3", ("type mismatch", [("b.rs", 4), ("src/a.rs", 3)], {"how": note("cast it"), "why": note("expected u8", "x", "y")}, None)),  # spans have an order
        ("4", ("type mismatch", [("src/a.rs", 3), ("b.rs", 4)], {"how": note("expected u8", "x", "y"), "why": note("cast it")}, None)),  # other labels
        ("5", ("type mismatch", [("src/a.rs", 3)], {}, "b.rs 4")), ("6", (None, None, None, None)), ("7", ("", [], {}, " .")), ("8", None), ("8", None), (None, a),
    ]
    return spark.createDataFrame(rows, NESTED)


def test_nested_records(spark, monkeypatch):
    df = _nested(spark)
    want = {("1", "2"), ("6", "7"), ("6", "8")}
    for hot in (1 << 20, 1):
        monkeypatch.setattr(formatdup, "HOT", hot)
        assert sorted(tuple(r) for r in formatdup.record_copies(df, ("tags",)).collect()) == sorted(want)
        assert {tuple(r) for r in formatdup.record_groups(df, ("tags",)).collect()} == {("1", 2), ("3", 1), ("4", 1), ("5", 1), ("6", 3)}
    assert {tuple(r) for r in formatdup.record_copies(df).collect()} == want - {("1", "2")}  # tags have an order now


def test_a_collision_joins_nothing(spark, monkeypatch):
    real = formatdup.rooted
    monkeypatch.setattr(formatdup, "rooted", lambda r, u=(): real(r, u).withColumn("root", formatdup.F.unhex(formatdup.F.lit("00" * 16))))
    for hot in (1 << 20, 2):
        monkeypatch.setattr(formatdup, "HOT", hot)
        assert {tuple(r) for r in formatdup.record_copies(_nested(spark), ("tags",)).collect()} == {("1", "2"), ("6", "7"), ("6", "8")}
        assert {tuple(r) for r in formatdup.record_groups(_nested(spark), ("tags",)).collect()} == {("1", 2), ("3", 1), ("4", 1), ("5", 1), ("6", 3)}


def test_flat_records_have_the_digests_of_nested_ones(spark):
    r = spark.createDataFrame([("1", ("A b", "c", None))], "id string, record struct<message:string,code:string,source:string>")
    kind = r.schema["record"].dataType
    one = formatdup.rooted(r).select(formatdup.F.lower(formatdup.F.hex("root")).alias("root"), "whole").first()
    two = r.select(formatdup.root_digest(formatdup.F.col("record"), kind).alias("root"), formatdup.structure(formatdup.F.col("record"), kind).alias("whole")).first()
    assert tuple(one) == tuple(two)
