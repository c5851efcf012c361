"""Evaluation passages that leaked into a corpus, by a distributed positional inverted index.

Terms are words with their two successors, which makes the lists short. The corpus is read once, in a narrow pass, whatever the number of
passages: a Bloom filter of the passages' terms (``BITS`` bits, of a fixed size) tells which of a document's terms can be asked for, and the
documents that hold so many of them that a match is possible are stored with their words and the positions of these terms (a written
table, which the rest reads). Its postings (term, document) are joined with those of the passages, from the rarest terms on: a
match needs so many terms (``needed``), so half as many of a passage's most frequent places are left out and the rest of the hits on the
others are necessary. That rule loses no match, whatever is frequent; a false hit of the filter only costs its join.

Each surviving pair is confirmed by position: offsets in the passage are subtracted from those in the document, equal words on one
diagonal are an exact phrase, phrases on near diagonals in order are proximity matches. Runs of equal words are
chained in the order of both texts; a small change costs one and its width (a changed number one more), one interruption of
any length costs four. A document leaks an item if the best chain holds ``SHARE`` of the passage's words and ``LEAST`` words, and its costs
are at most ``COSTS`` of its words, which text made of the same phrases with other words between them exceeds. A run looks back
over the document no further than the passage is long, so chaining costs the number of runs times that of those in such a stretch.

Defined results
---------------
* Case, punctuation, markup, layout and zero-width marks are no part of words.
* Null, empty and blank texts and passages match nothing; passages of fewer than ``LEAST`` words can't match.
* Repeated documents give a row each; equal rows are given once. Empty tables give an empty result. Extra columns are ignored.
* Any number of items, also repeated ids: each row of the items is a passage of its own.
* Texts of any length are searched whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glintflow.llm import bytetext

SHARE, LEAST = 0.32, 15
SMALL, CUT, OTHER_NUMBER = 4, 4, 1
COSTS = 0.4
BITS = 1 << 26  # of the filter: 8 MB, and at most two million words of 32 bits when it is put together
SHARD = 4 << 20  # bytes of text in a shard


def terms(h: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and 64-bit terms of all words that have two successors in their text."""
    doc = np.repeat(np.arange(len(before) - 1), np.diff(before))
    at = np.flatnonzero(doc[:-2] == doc[2:]) if len(h) > 2 else np.zeros(0, np.int64)
    mixed = (h[at] * np.uint64(0x9E3779B97F4A7C15) ^ h[at + 1]) * np.uint64(0xC2B2AE3D27D4EB4F) ^ h[at + 2]
    return at, (mixed * np.uint64(0x165667B19E3779F9)).view(np.int64)


def _place(term: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """A term's bit in the filter: its highest bits."""
    return (term.view(np.uint64) >> np.uint64(65 - (32 * len(bits)).bit_length())).astype(np.int64)


def chain(doc: np.ndarray, passage: np.ndarray, numeric: np.ndarray) -> tuple[int, float]:
    """(matched words, matched words less costs) of the best chain of runs of equal words."""
    numbers = np.concatenate([[0], np.cumsum(numeric)]).tolist()
    order = np.argsort(passage, kind="stable")
    sorted_passage = passage[order]
    lo, hi = np.searchsorted(sorted_passage, doc, "left"), np.searchsorted(sorted_passage, doc, "right")
    n = hi - lo
    p = np.repeat(np.arange(len(doc)), n)
    k = order[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
    diagonal = p - k
    by = np.lexsort((p, diagonal))
    p, k, diagonal = p[by], k[by], diagonal[by]
    new = np.ones(len(p), bool)
    new[1:] = (diagonal[1:] != diagonal[:-1]) | (p[1:] != p[:-1] + 1)
    s = np.flatnonzero(new)
    size = np.diff(np.append(s, len(p)))
    keep = size >= 2
    runs = sorted(zip(p[s][keep].tolist(), k[s][keep].tolist(), size[keep].tolist(), strict=True))
    best: list[tuple[tuple[float, int], tuple[float, int]]] = []
    ends: dict[int, tuple[float, int, int]] = {}  # the best unbroken chain up to each word of the passage, and where it ends in the document
    top = (0.0, 0)
    oldest = 0
    reach = len(passage) + SMALL
    for a, b, size_j in runs:
        whole, broken = (float(size_j), size_j), (-1e9, 0)
        while runs[oldest][0] < a - reach:
            oldest += 1
        for i in range(oldest, len(best)):
            a2, b2, size_i = runs[i]
            gap_d, gap_p = a - a2 - size_i, b - b2 - size_i
            shared = max(0, -gap_d, -gap_p)
            if shared >= size_j:
                continue
            gap_d, gap_p, more = gap_d + shared, gap_p + shared, size_j - shared
            if gap_d <= SMALL and gap_p <= SMALL:
                wide = max(gap_d, gap_p)
                cost = 1 + (2 * wide if gap_d and gap_p and wide > 1 else wide) + (OTHER_NUMBER if gap_d and numbers[b + shared] > numbers[b2 + size_i] else 0)
                (w, wn), (x, xn) = best[i]
                whole = max(whole, (w + more - cost, wn + more))
                broken = max(broken, (x + more - cost, xn + more))
        for e in range(b - SMALL, b + size_j):
            if e in ends:
                w, wn, end = ends[e]
                shared = max(0, e - b, end - a)
                if shared < size_j and b + shared - e <= SMALL:
                    broken = max(broken, (w + size_j - shared - CUT - (b + shared - e), wn + size_j - shared))
        best.append((whole, broken))
        ends[b + size_j] = max(ends.get(b + size_j, (-1e9, 0, 0)), (*whole, a + size_j))
        top = max(top, whole, broken)
    return top[1], top[0]


def _lists(values: np.ndarray, before: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(before.astype(np.int32)), pa.array(values))


def passages(items: DataFrame, item_id: str = "item_id", passage: str = "passage") -> DataFrame:
    """(k, item_id, words, numeric, terms, needed): the passages that can match, a row each."""
    from glintflow.session import checkpointed

    asked = items.select(F.col(item_id).cast("bigint").alias("item_id"), F.col(passage).alias("p")).where("item_id IS NOT NULL AND length(trim(p)) > 0").withColumn("k", F.monotonically_increasing_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1)
            for lo, hi in shards(texts):
                part = texts.slice(lo, hi - lo)
                h, before = bytetext.words(*bytetext.plain(part))
                at, t = terms(h, before)
                numeric = np.array([w.isdigit() for p in part.to_pylist() for w in bytetext.split(p)], bool)
                yield pa.record_batch([b.column(2).slice(lo, hi - lo), b.column(0).slice(lo, hi - lo), _lists(h.view(np.int64), before), _lists(numeric, before), _lists(t, np.searchsorted(at, before))], ["k", "item_id", "words", "numeric", "terms"])

    rows = asked.mapInArrow(run, "k bigint, item_id bigint, words array<bigint>, numeric array<boolean>, terms array<bigint>")
    # a break costs two or more and takes two terms, as the end does
    least = F.ceil(F.greatest(F.lit(float(LEAST)), SHARE * F.size("words")))
    return checkpointed(rows.where(F.size("words") >= LEAST).withColumn("needed", F.ceil((1 - COSTS) * least - 2 - 1e-9).cast("int")))


def term_filter(asked: DataFrame) -> np.ndarray:
    """The bits of all terms of the passages, of a fixed size; put together where the passages are."""
    shift = 64 - (BITS.bit_length() - 1)
    words = asked.select(F.explode("terms").alias("t")).select(F.shiftrightunsigned("t", shift).alias("b")).groupBy(F.shiftright("b", 5).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 31 as int))")).alias("v")).toArrow()  # at most BITS / 32 rows
    out = np.zeros(max(1, BITS // 32), np.uint32)
    out[words.column("w").to_numpy()] = words.column("v").to_numpy().astype(np.uint32)
    return out


def index(docs: DataFrame, bits: np.ndarray, least: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(u, doc_id, words, terms) of the documents with ``least`` terms in the filter or more: the stored index, a row each."""
    from glintflow.session import checkpointed

    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for lo, hi in shards(texts):
                h, before = bytetext.words(*bytetext.plain(texts.slice(lo, hi - lo)))
                at, t = terms(h, before)
                b = _place(t, shared.value)
                held = np.flatnonzero(shared.value[b >> 5] >> (b & 31).astype(np.uint32) & np.uint32(1))
                edges = np.searchsorted(at[held], before)
                kept = np.flatnonzero(np.diff(edges) >= least)
                if len(kept):
                    of_doc = np.isin(np.repeat(np.arange(hi - lo), np.diff(before)), kept)
                    of_term = np.isin(np.repeat(np.arange(hi - lo), np.diff(edges)), kept)
                    sizes = lambda x, kept=kept: np.concatenate([[0], np.cumsum(np.diff(x)[kept])])
                    yield pa.record_batch([ids.take(pa.array(lo + kept)), _lists(h.view(np.int64)[of_doc], sizes(before)), _lists(t[held][of_term], sizes(edges))], ["doc_id", "words", "terms"])

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where("doc_id IS NOT NULL AND length(text) > 0")
    return checkpointed(rows.mapInArrow(run, "doc_id bigint, words array<bigint>, terms array<bigint>").withColumn("u", F.monotonically_increasing_id()))


def candidates(asked: DataFrame, stored: DataFrame) -> DataFrame:
    """(u, k): the documents and passages that share as many of the passage's rarer terms as a match needs."""
    postings = stored.select("u", F.explode("terms").alias("term"))
    frequency = postings.groupBy("term").agg(F.count(F.lit(1)).alias("f"))
    entries = asked.select("k", "needed", F.explode("terms").alias("term")).join(frequency, "term", "left")
    skipped = F.floor(F.col("needed") / 2)
    rarer = entries.withColumn("rank", F.row_number().over(Window.partitionBy("k").orderBy(F.desc_nulls_last("f"), "term"))).where((F.col("rank") > skipped) & F.col("f").isNotNull())
    shared = postings.join(rarer.select("k", "term"), "term").groupBy("u", "k").agg(F.count(F.lit(1)).alias("n"))
    return shared.join(asked.select("k", "needed"), "k").where(F.col("n") >= F.col("needed") - skipped).select("u", "k")


def confirmed(words: np.ndarray, passage: np.ndarray, numeric: np.ndarray) -> bool:
    """Whether a document's words hold a stretch of the passage that is a leak."""
    matched, score = chain(words, passage, numeric)
    return matched >= max(LEAST, SHARE * len(passage)) and score >= (1 - COSTS) * matched


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", passage: str = "passage") -> DataFrame:
    """(doc_id, item_id): the documents that hold a stretch of an item's passage."""
    asked = passages(items, item_id, passage)
    least = asked.agg(F.min("needed")).first()[0]
    if least is None:
        return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.lit(0).cast("bigint").alias("item_id")).limit(0)
    stored = index(docs, term_filter(asked), least, doc_id, text)
    pairs = candidates(asked, stored).join(stored.select("u", "doc_id", "words"), "u").join(asked.select("k", "item_id", F.col("words").alias("passage"), "numeric"), "k").select("doc_id", "item_id", "words", "passage", "numeric")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, asked_words, numeric = (b.column(i) for i in (2, 3, 4))
            ok = [confirmed(words[i].values.to_numpy(), asked_words[i].values.to_numpy(), numeric[i].values.to_numpy(zero_copy_only=False)) for i in range(b.num_rows)]
            yield pa.record_batch([b.column(0), b.column(1)], ["doc_id", "item_id"]).filter(pa.array(ok, pa.bool_()))

    return pairs.mapInArrow(run, "doc_id bigint, item_id bigint").distinct()


def shards(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``SHARD`` bytes."""
    _, off = bytetext.buffers(texts)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + SHARD, "right")) - 1)
        yield lo, min(hi, len(texts))
        lo = hi
