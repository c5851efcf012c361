import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from glintflow.llm import tokens

ENCODER = tokens.Encoder(open(tokens.VOCABULARY, "rb").read())
PIECES = st.sampled_from(["a", "the ", " ", "\n", "  ", "\t", "é", "日本", " ", "'s", "12", "\x1c", "!", "<|endoftext|>", "ab" * 40, "語" * 30, "​", "🙂", " word", "\r\n"])


def same(texts):
    ids, where = ENCODER.encode(*tokens.text_buffers(pa.array(texts, pa.string())))
    assert [ids[where[i] : where[i + 1]].tolist() for i in range(len(texts))] == [ENCODER.plain.encode_ordinary(t or "") for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(PIECES, max_size=40).map("".join)), max_size=12), st.sampled_from([16, 64, 1 << 20]))
def test_exact(texts, window):
    tokens.WINDOW, old = window, tokens.WINDOW
    try:
        same(texts)
    finally:
        tokens.WINDOW = old


def test_corpus(spark, tiny):
    texts = [r.text for r in spark.read.parquet(f"{tiny}/documents.parquet").select("text").collect()]
    same(texts)


def test_collisions_are_repaired(monkeypatch):
    e = tokens.Encoder(open(tokens.VOCABULARY, "rb").read())
    monkeypatch.setattr(e, "bytes64", e.bytes64 * 0)  # every chunk of a length now has one hash
    t = ["one two three four", "six ten seven nine"]
    ids, where = e.encode(*tokens.text_buffers(pa.array(t)))
    assert [ids[where[i] : where[i + 1]].tolist() for i in range(2)] == [e.plain.encode_ordinary(x) for x in t]


def test_forgets_beyond_its_bound(monkeypatch):
    monkeypatch.setattr(tokens, "KEEP", 10)
    e = tokens.Encoder(open(tokens.VOCABULARY, "rb").read())
    for k in range(5):
        t = " ".join(f"w{k}{i}" for i in range(300))
        ids, _ = e.encode(*tokens.text_buffers(pa.array([t])))
        assert len(e.slot) < 200 and ids.tolist() == e.plain.encode_ordinary(t)


PATTERNS = [
    tokens.PATTERN, r"'re|'r|\w+|\s+|[^\w\s]{1,2}", r" ?\p{L}{1,3}|\p{N}{1,3}|[^\p{L}\p{N}]",
    r"[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+", r"\p{N}{1,3}(?=(?:\p{N}{3})*(?:\P{N}|$))|\p{L}+ ?|\s|.", r"(?:\w+\s)*\w+|\s+|\W", r"[a-z]+|[A-Z]+ ?|(?s:.)",
]
ENCODERS = {p: tokens.Encoder(open(tokens.VOCABULARY, "rb").read(), p) for p in PATTERNS}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(PIECES, max_size=60).map("".join)), max_size=8), st.sampled_from([16, 64, 1 << 20]), st.sampled_from([(1, 0), (3, 0), (63, 24)]))
def test_any_pattern_is_repaired_at_joins(texts, window, anywhere):
    """Cuts at every second place, at every fourth one and at few ones."""
    old = tokens.WINDOW, tokens.ANYWHERE, tokens.RUN
    tokens.WINDOW, (tokens.ANYWHERE, tokens.RUN) = window, anywhere
    try:
        for p, e in ENCODERS.items():
            e._forget()
            ids, where = e.encode(*tokens.text_buffers(pa.array(texts, pa.string())))
            assert [ids[where[i] : where[i + 1]].tolist() for i in range(len(texts))] == [e.plain.encode_ordinary(t or "") for t in texts], p
    finally:
        tokens.WINDOW, tokens.ANYWHERE, tokens.RUN = old


def test_a_corpus_without_spaces_and_reuse(monkeypatch):
    monkeypatch.setattr(tokens, "ANYWHERE", 15)
    e = tokens.Encoder(open(tokens.VOCABULARY, "rb").read())
    stretch = "語の長い文章をここに繰り返し書く" * 40 + "12345678901234567890" * 20
    texts = [f"{k}{stretch}{k}" for k in range(200)]
    ids, where = e.encode(*tokens.text_buffers(pa.array(texts)))
    assert [ids[where[i] : where[i + 1]].tolist() for i in range(200)] == [e.plain.encode_ordinary(t) for t in texts]
    e.anew = e.seen = 0
    same(["once more a passage of some length that has been seen in another text before, word for word"] * 3)


def test_rows(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "hi there", "c"), (3, "hi there", "c"), (None, " ", "d")], "doc_id bigint, text string, ids string")
    got = sorted(((r.doc_id, list(r.ids)) for r in tokens.encoded(df).collect()), key=str)
    hi = ENCODER.plain.encode_ordinary("hi there")
    assert got == sorted([(1, []), (2, []), (3, hi), (3, hi), (None, ENCODER.plain.encode_ordinary(" "))], key=str)
    assert tokens.encoded(df.limit(0)).count() == 0 and tokens.encoded(df).dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
    with pytest.raises(OSError):
        tokens.encoded(df, vocabulary="/nowhere")
