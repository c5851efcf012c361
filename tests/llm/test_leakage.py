import random

import numpy as np
import pyarrow as pa

from glintflow.llm import bytetext, leakage

W = [f"w{i}" for i in range(200)]
RNG = random.Random(4)
PASSAGES = {i: [RNG.choice(W) for _ in range(60)] for i in range(30)}
FILL = lambda n: [f"z{RNG.randrange(500)}" for _ in range(n)]


def leaking(kind, p):
    if kind == "whole":
        return p
    if kind == "part":
        return p[20:44]
    if kind == "typos":
        return [w + "x" if i % 8 == 5 else w for i, w in enumerate(p)]
    if kind == "inserted":
        return [x for i, w in enumerate(p) for x in ([w, "(sic)"] if i % 9 == 4 else [w])]
    if kind == "broken":
        return p[:14] + FILL(40) + p[14:30]
    if kind == "short":
        return p[:10]
    if kind == "shuffled":
        q = [p[i : i + 3] for i in range(0, len(p), 3)]
        RNG.shuffle(q)
        return [w for x in q for w in x]
    return FILL(60)


def test_kinds(spark):
    docs, want = [], set()
    for d, kind in enumerate(["whole", "part", "typos", "inserted", "broken", "short", "shuffled", "none"] * 4):
        i = d % 30
        body = leaking(kind, PASSAGES[i])
        docs.append((d, " ".join(FILL(30)) + "\n\n> **" + "** ,\n> ".join(" ".join(body[k : k + 7]).upper() for k in range(0, len(body), 7)) + "! " + " ".join(FILL(30)), "x"))
        if kind in ("whole", "part", "typos", "inserted", "broken"):
            want.add((d, i))
    docs += [(100, docs[0][1], "x"), (100, docs[0][1], "x"), (101, None, "x"), (102, "", "x"), (103, "  ", "x"), (None, docs[0][1], "x"), (104, " ".join(FILL(300_000) + PASSAGES[3]), "x"), (105, "​".join(PASSAGES[4][0]) + " " + " ".join(PASSAGES[4][1:]), "x")]
    want |= {(100, 0), (104, 3), (105, 4)}
    items = spark.createDataFrame([(i, " ".join(p), "y") for i, p in PASSAGES.items()] + [(77, None, ""), (78, "", ""), (79, "too short", ""), (None, "x", "")], "item_id bigint, passage string, doc_id string")
    df = spark.createDataFrame(docs, "doc_id bigint, text string, item_id string")
    found = lambda: leakage.leaks(df, items)
    assert {tuple(r) for r in found().collect()} == want and found().count() == len(want)
    old, leakage.BITS = leakage.BITS, 64  # a filter that passes nearly all terms
    try:
        assert {tuple(r) for r in found().collect()} == want
    finally:
        leakage.BITS = old
    assert leakage.leaks(df.limit(0), items).count() == 0 == leakage.leaks(df, items.limit(0)).count()


def test_index_loses_nothing_against_all_pairs(spark, tiny):
    """Every document against every passage, by the exact chain alone."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{tiny}/documents.parquet").where("text IS NOT NULL").collect()]
    items = [(r.item_id, r.passage) for r in spark.read.parquet(f"{tiny}/eval_items.parquet").collect()]
    h, before = bytetext.words(*bytetext.plain(pa.array([t for _, t in docs])))
    asked = [(i, bytetext.hashed([p])[0], np.array([w.isdigit() for w in bytetext.split(p)])) for i, p in items]
    want = set()
    for d in range(len(docs)):
        mine = h[before[d] : before[d + 1]]
        for i, passage, numeric in asked:
            if len(np.intersect1d(mine, passage)) >= 10 and leakage.confirmed(mine, passage, numeric):
                want.add((docs[d][0], i))
    got = leakage.leaks(spark.read.parquet(f"{tiny}/documents.parquet"), spark.read.parquet(f"{tiny}/eval_items.parquet"))
    assert {tuple(r) for r in got.collect()} == want and want


def test_words():
    texts = ["Hello, World_x 9", None, "", "a—b​c d e", "É"]
    h, before = bytetext.words(*bytetext.plain(pa.array(texts)))
    assert np.diff(before).tolist() == [4, 0, 0, 4, 1]
    assert bytetext.hashed(["hello world x 9"])[0].tolist() == h[:4].tolist() and bytetext.hashed(["é"])[0][0] == h[-1] and bytetext.hashed(["bc"])[0][0] == h[5]
    bytetext.WINDOW, old = 5, bytetext.WINDOW
    try:
        assert bytetext.words(*bytetext.plain(pa.array(texts)))[0].tolist() == h.tolist()
    finally:
        bytetext.WINDOW = old


def test_small_changes_in_a_short_leak_and_long_interruptions():
    passage = " ".join(PASSAGES[0][:20] + ["84"] + PASSAGES[0][21:55])
    words = passage.split()
    asked = bytetext.hashed([passage])[0]

    def found(body):
        h = bytetext.hashed([" ".join(FILL(30) + body + FILL(30))])[0]
        return leakage.confirmed(h, asked, np.array([w.isdigit() for w in words]))

    assert found(words[15:20] + ["other"] + words[21:31] + ["other"] + words[32:38])  # 21 of 55 words
    assert found(words[4:20] + ["97"] + words[21:27])  # another number
    assert found(words[:12] + FILL(400) + words[12:24])  # one interruption of any length
    assert not found(words[:8] + FILL(100) + words[8:14] + FILL(100) + words[14:22])  # two of them
    assert not found([w for k in range(0, 45, 4) for w in [*words[k : k + 2], "a", "b"]])  # scattered


def test_many_items_with_a_common_term(spark):
    """One scan answers more items than documents; terms that every document and item holds lose no match and join nothing else."""
    stop = "as it is said in the".split()
    made = {i: stop + [f"v{i}x{j}" for j in range(40)] for i in range(3000)}
    docs = spark.createDataFrame([(d, " ".join(stop * 3 + (made[d][3:30] if d % 2 else [f"q{d}y{j}" for j in range(40)]))) for d in range(200)], "doc_id bigint, text string")
    items = spark.createDataFrame([(i, " ".join(w)) for i, w in made.items()], "item_id bigint, passage string")
    assert {tuple(r) for r in leakage.leaks(docs, items).collect()} == {(d, d) for d in range(1, 200, 2)}
