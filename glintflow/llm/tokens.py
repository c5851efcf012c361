"""Encoding of a corpus by a public byte-level BPE tokenizer, by content-defined chunk reuse.

A rolling hash over the last eight bytes cuts all texts of a batch into chunks of some tens of bytes, so that equal passages of different
documents fall into equal chunks: before white space, and in long runs without any at one in sixty characters wherever they stand, so that
scripts without spaces are cut too. Each distinct chunk is encoded once in a Python worker and kept (the last
``KEEP`` to two times ``KEEP`` chunks); all others are looked up by their hash, without a loop over chunks in Python.

Joins are then repaired. A cut may split a pre-token or change where white space goes. For each distinct last pre-token of a chunk and first
one of the next, both are split anew together: if the first comes out as it was, the cut is a boundary and both chunks' ids hold, since
pre-tokenisation depends on nothing before a boundary. For each other pair of chunks the
last pre-tokens of the one and the first of the other are encoded anew together, over a window that grows until both of its ends agree with
what the chunks have by themselves, and the ids in between are replaced by those of the window. A text in which no window agrees, or in
which the repairs of a chunk's two ends meet, or run through a chunk of one pre-token, is encoded anew as a whole. The last pre-token of a
window touches its end and counts as open. This holds for patterns whose pre-tokens are settled by the next one: sequences of classes and
words, with no look-around but ``(?!\\S)`` and no groups that repeat. With any other pattern every text is encoded as a whole.
At last the ids of every text are decoded and compared with its bytes, which shows collisions of hashes.

Pre-tokens are found by a Python engine, which knows the classes of letters, numbers and white space as the tokenizer's own does for
characters up to ``COMMON``; with others in it, the pre-tokens of a chunk must give the tokenizer's ids, else its texts are encoded anew.

The job is one narrow pass: nothing is shuffled, and a hot text costs one lookup.

Defined results
---------------
* Null and empty texts have an empty list; blank texts are encoded like others. Null ids are kept.
* No special tokens: their spellings in a text are ordinary text.
* Rows are kept as they are, repeated ones too. An empty table gives an empty table. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed value: the vocabulary's pre-tokenisation
MASK = 3  # of the rolling hash: a cut at every fourth place before white space on average
ANYWHERE, RUN = 63, 24  # and at one in so many other characters that follow so many bytes without white space
WINDOW = 1 << 21
KEEP = 1 << 18
PIECES = 1 << 19  # pre-tokens whose ids are kept
AROUND = (2, 4, 8)  # pre-tokens on both sides of a join that are split anew
COMMON = 0x24F  # up to the Latin letters
MAX_VOCABULARY_BYTES = 64 << 20


class Encoder:
    """Encodes byte buffers; keeps the ids of the chunks it has seen."""

    def __init__(self, vocabulary: bytes, pattern: str = PATTERN) -> None:
        import regex
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        self.plain = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        compiled = regex.compile(pattern)
        self.split = lambda text: [m.group() for m in compiled.finditer(text)] if compiled.groups else compiled.findall(text)
        self.first = compiled.match
        self.far = re.search(r"\(\?[=!<]|\)[*+?{]", pattern.replace(r"(?!\S)", "")) is not None
        self.rare = regex.compile(rf"[^\x00-\x1b\x20-\x84\x86-{chr(COMMON)}]")
        rng = np.random.default_rng(20240229)
        self.table = rng.integers(0, 1 << 32, 256, dtype=np.uint32)
        self.bytes64 = rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self._powers(0)
        width = max(ranks.values()) + 1
        words = [b""] * width
        for b, i in ranks.items():
            words[i] = b
        self.words = words
        self.length = np.array([len(w) for w in words], np.int64)
        self.offset = np.concatenate([[0], np.cumsum(self.length)[:-1]])
        self.flat = np.frombuffer(b"".join(words), np.uint8)
        self.piece: dict[str, list[int]] = {}
        self.anew = self.seen = 0  # bytes encoded and bytes seen
        self._forget()

    def _powers(self, n: int) -> None:
        """Powers of an odd base and of its inverse modulo 2**64: a chunk's hash is a difference of prefix sums brought to a common place."""
        n = max(n, WINDOW + 4096)
        base = 0xD6E8FEB86659FD93
        up, down = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        self.up, self.down = np.cumprod(up), np.cumprod(down)

    def _forget(self) -> None:
        self.slot: dict[int, int] = {}
        self.start = np.zeros(1024, np.int64)
        self.count = np.zeros(1024, np.int64)  # -1: the engines differ on the chunk
        self.pool = np.zeros(1 << 16, np.int32)
        self.used = 0
        self.head, self.tail = np.zeros(1024, np.int64), np.zeros(1024, np.int64)  # numbers of each chunk's first and last pre-token
        self.single = np.zeros(1024, bool)  # whether they are one
        self.slots = 0
        self.number: dict[str, int] = {}  # of the first and last pre-tokens
        self.named: list[str] = []
        self.meets: dict[int, bool] = {}  # whether a cut between two pre-tokens is a boundary
        self.joins: dict[int, int] = {}
        self.repairs: list[tuple[int, int, int]] = [(0, 0, 0)]  # ids to drop at the end and at the start, and the slot of those in between
        self.context = [0]  # ids of the first chunk that the repair relies on

    def ids_of(self, piece: str) -> list[int]:
        known = self.piece.get(piece)
        if known is None:
            if len(self.piece) >= PIECES:
                self.piece.clear()
            known = self.piece[piece] = self.plain._core_bpe.encode_single_piece(piece.encode())
        return known

    def _keep(self, ids: list[list[int]]) -> np.ndarray:
        """Slots of new lists of ids."""
        k, counts = self.slots, np.fromiter(map(len, ids), np.int64, len(ids))
        n = int(counts.sum())
        while k + len(ids) > len(self.start):
            self.start, self.count, self.head, self.tail, self.single = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.count, self.head, self.tail, self.single))
        while self.used + n > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + n] = np.fromiter(chain.from_iterable(ids), np.int32, n)
        self.start[k : k + len(ids)], self.count[k : k + len(ids)] = self.used + np.cumsum(counts) - counts, counts
        self.used += n
        self.slots += len(ids)
        return np.arange(k, k + len(ids))

    def _number(self, piece: str) -> int:
        n = self.number.get(piece)
        if n is None:
            n = self.number[piece] = len(self.named)
            self.named.append(piece)
        return n

    def _new_chunks(self, keys: list[int], texts: list[str], uncommon: np.ndarray) -> np.ndarray:
        split, encode, number = self.split, self.plain._core_bpe.encode_ordinary, self._number
        all_ids = list(map(encode, texts))
        pieces = list(map(split, texts))
        differing = [k for k in uncommon.tolist() if list(chain.from_iterable(map(self.ids_of, pieces[k]))) != all_ids[k]]
        slots = self._keep(all_ids)
        self.head[slots] = [number(p[0]) for p in pieces]
        self.tail[slots] = [number(p[-1]) for p in pieces]
        self.single[slots] = [len(p) == 1 for p in pieces]
        self.count[slots[differing]] = -1
        self.slot.update(zip(keys, slots.tolist(), strict=True))
        return slots

    def _boundary(self, last: int, first: int) -> bool:
        """Whether a cut between two pre-tokens is a boundary in their joint text."""
        a, b = self.named[last], self.named[first]
        m = self.first(a + b)
        return m is not None and m.end() == len(a) and not self.rare.search(a + b)

    def _pieces(self, slot: int) -> list[str]:
        return self.split(b"".join(self.words[i] for i in self.pool[self.start[slot] : self.start[slot] + self.count[slot]].tolist()).decode("utf-8", "replace"))

    def _join(self, left: int, right: int) -> int:
        """The repair of a join: its place in ``repairs``, 0 if both sides agree as they are, -1 if no window agrees."""
        if self.count[left] < 0 or self.count[right] < 0:
            return -1
        tail, head = self._pieces(left), self._pieces(right)
        for around in AROUND:
            begin = max(0, len(tail) - around)
            a, b = tail[begin:], head[:around]
            both = "".join(a) + "".join(b)
            got = self.split(both)
            if self.rare.search(both) and [i for x in got for i in self.ids_of(x)] != self.plain.encode_ordinary(both):
                return -1
            got = got[:-1]
            if begin and got[:1] != a[:1]:
                continue
            first = 1 if begin else 0
            at = cut = sum(map(len, a))
            theirs = {}  # boundaries of the second chunk: how many of its pre-tokens lie before
            for k, x in enumerate(b):
                theirs[at] = k
                at += len(x)
            if len(b) < len(head):
                theirs[at] = len(b)
            at = 0
            for n, x in enumerate([*got, ""]):
                if at >= cut and at in theirs:
                    break
                at += len(x)
            else:
                continue
            mid, dropped, skipped = got[first:n], a[first:], b[: theirs[at]]
            size = lambda pieces: sum(len(self.ids_of(x)) for x in pieces)
            if mid == dropped + skipped:
                return 0
            slot = int(self._keep([[i for x in mid for i in self.ids_of(x)]])[0])
            self.anew += sum(len(x.encode()) for x in mid)
            self.repairs.append((size(dropped), size(skipped), slot))
            self.context.append(size(a))
            return len(self.repairs) - 1
        return -1

    def cuts(self, a: np.ndarray) -> np.ndarray:
        """Where chunks may begin by the rolling hash of the bytes before."""
        h = self.table[a]
        for step, factor in ((1, 0x9E3779B1), (2, 0x85EBCA77), (4, 0xC2B2AE3D)):
            moved = h.copy()
            moved[step:] += h[:-step] * np.uint32(factor)
            h = moved
        h = h[:-1] >> np.uint32(16)
        space = ((a[1:] == 32) | (a[1:] == 10)) & (a[:-1] > 32)
        begins = (a[1:] & 0xC0) != 0x80  # no byte inside a character
        at = np.arange(len(a) - 1)
        run = at - np.maximum.accumulate(np.where(a[:-1] <= 32, at, -1)) >= RUN
        return np.flatnonzero(space & (h & np.uint32(MASK) == 0) | begins & run & (h & np.uint32(ANYWHERE) == 1)) + 1

    def _slots(self, a: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the chunks of a window, and their slots."""
        begins = np.zeros(len(a) + 1, bool)
        begins[0] = begins[self.cuts(a)] = begins[edges] = True
        starts = np.flatnonzero(begins[: len(a)])
        ends = np.append(starts[1:], len(a))
        size = ends - starts
        if len(a) > len(self.up):
            self._powers(len(a))
        upto = np.concatenate([[np.uint64(0)], np.cumsum(self.bytes64[a] * self.up[: len(a)])])
        keys = (upto[ends] - upto[starts]) * self.down[starts] + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        distinct, first, back = np.unique(keys, return_index=True, return_inverse=True)
        raw, get = a.tobytes(), self.slot.get
        slots = np.fromiter((get(k, -1) for k in distinct.tolist()), np.int64, len(distinct))
        new = np.flatnonzero(slots < 0)
        if len(new):
            f = first[new]
            self.anew += int(size[f].sum())
            odd = np.concatenate([[0], np.cumsum((a >= 0xC9) | (a >= 0x1C) & (a < 0x20) | (a == 0x85))])  # bytes of uncommon characters, and some others
            slots[new] = self._new_chunks(distinct[new].tolist(), [raw[b:e].decode("utf-8", "replace") for b, e in zip(starts[f].tolist(), ends[f].tolist(), strict=True)], np.flatnonzero(odd[ends[f]] > odd[starts[f]]))
        return starts, slots[back]

    def agrees(self, ids: np.ndarray, a: np.ndarray) -> bool:
        n = self.length[ids]
        if n.sum() != len(a):
            return False
        before = np.cumsum(n) - n
        return bool((self.flat[np.repeat(self.offset[ids] - before, n) + np.arange(len(a))] == a).all())

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and each text's offsets in it. offsets: of the texts in data, one more than texts."""
        if self.slots > KEEP:
            self._forget()
        base, total = int(offsets[0]), int(offsets[-1])
        self.seen += total - base
        n_texts = len(offsets) - 1
        if total == base:
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        if self.far:
            self.anew += total - base
            each = [self.plain.encode_ordinary(data[a:b].tobytes().decode("utf-8", "replace")) for a, b in zip(offsets.tolist(), offsets.tolist()[1:], strict=False)]
            return np.fromiter(chain.from_iterable(each), np.int32), np.cumsum([0, *map(len, each)])
        starts, slots, lo = [], [], base
        while lo < total:
            hi = min(lo + WINDOW, total)
            if hi < total:  # to the next start of a text, or to a cut that is one wherever windows end
                nxt = int(offsets[np.searchsorted(offsets, hi, "left")])
                while hi < nxt:  # stretch by stretch
                    cut = self.cuts(data[max(hi - 8, 0) : min(hi + (1 << 16), nxt)])
                    cut = cut[cut >= 8]
                    if len(cut):
                        hi = max(hi - 8, 0) + int(cut[0])
                        break
                    hi = min(hi + (1 << 16), nxt)
            edges = offsets[np.searchsorted(offsets, lo, "left") : np.searchsorted(offsets, hi, "left")] - lo
            s, k = self._slots(data[lo:hi], edges)
            starts.append(s + lo)
            slots.append(k)
            lo = hi
        start, slot = np.concatenate(starts), np.concatenate(slots)
        text = np.searchsorted(offsets, start, "right") - 1
        # joins inside texts
        inner = np.flatnonzero(text[1:] == text[:-1]) + 1
        met = _looked_up(self.tail[slot[inner - 1]] << np.int64(32) | self.head[slot[inner]], self.meets, self._boundary)
        inner = inner[(met == 0) | (self.count[slot[inner - 1]] < 0) | (self.count[slot[inner]] < 0)]
        repair = np.zeros(len(start), np.int64)
        repair[inner] = _looked_up(slot[inner - 1] << np.int64(32) | slot[inner], self.joins, self._join)
        table, context = np.array(self.repairs, np.int64), np.array(self.context, np.int64)
        count = self.count[slot]
        bad = (repair < 0) | (count < 0)
        repair, count = np.maximum(repair, 0), np.maximum(count, 0)
        head = table[repair, 1]
        tail, needs = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        tail[:-1], needs[:-1] = table[repair[1:], 0], context[repair[1:]]
        bad |= (head > 0) & (head + needs > count) | (head + tail > count)  # the repairs of a chunk's ends meet
        bad |= (head > 0) & (head >= count) & np.append(text[1:] == text[:-1], False)
        bad[:-1] |= (repair[1:] > 0) & self.single[slot[:-1]] & (np.append(-1, text[:-2]) == text[:-1])[: len(text) - 1]  # a pre-token that goes on at its end may have been another at its start
        # in between, then the chunk
        seg_start = np.stack([self.start[table[repair, 2]], self.start[slot] + head], 1).ravel()
        seg_len = np.stack([np.where(repair > 0, self.count[table[repair, 2]], 0), count - head - tail], 1).ravel()
        doubtful = np.unique(text[bad])
        if len(doubtful):
            seg_len[np.repeat(np.isin(text, doubtful), 2)] = 0
        before = np.concatenate([[0], np.cumsum(seg_len)])
        ids = self.pool[np.repeat(seg_start - before[:-1], seg_len) + np.arange(before[-1])]
        where = before[2 * np.searchsorted(text, np.arange(n_texts + 1), "left")]
        each = data[base:total] if not len(doubtful) else data[base:total][np.repeat(~np.isin(np.arange(n_texts), doubtful), np.diff(offsets))]
        if not self.agrees(ids, each):  # two chunks of one hash somewhere: every text by itself
            doubtful = np.array([t for t in range(n_texts) if offsets[t + 1] > offsets[t] and not self.agrees(ids[where[t] : where[t + 1]], data[offsets[t] : offsets[t + 1]])], np.int64)
        if not len(doubtful):
            return ids, where
        parts, at, more = [], 0, np.zeros(n_texts + 1, np.int64)
        for t in doubtful.tolist():
            a = data[offsets[t] : offsets[t + 1]]
            self.anew += len(a)
            mine = self.plain.encode_ordinary(a.tobytes().decode("utf-8", "replace"))
            parts += [ids[at : where[t]], np.array(mine, np.int32)]
            more[t + 1] = len(mine) - (where[t + 1] - where[t])
            at = where[t + 1]
        return np.concatenate([*parts, ids[at:]]), where + np.cumsum(more)


def _looked_up(keys: np.ndarray, known: dict[int, int], ask) -> np.ndarray:
    """The known answer for each key, which is two numbers; those that aren't known yet are asked for once."""
    distinct, back = np.unique(keys, return_inverse=True)
    got = []
    for x in distinct.tolist():
        r = known.get(x)
        if r is None:
            r = known[x] = ask(x >> 32, x & 0xFFFFFFFF)
        got.append(r)
    return np.array(got, np.int64)[back] if len(keys) else np.zeros(0, np.int64)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string column; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]] if len(off) else raw, off - off[0] if len(off) else np.zeros(1, np.int64)


def encoded(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, ids) of each document."""
    content = Path(vocabulary).read_bytes()
    if len(content) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"the vocabulary has more than {MAX_VOCABULARY_BYTES} bytes")
    shared = docs.sparkSession.sparkContext.broadcast(content)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for b in batches:
            encoder = encoder or Encoder(shared.value, pattern)
            ids, where = encoder.encode(*text_buffers(b.column(1)))
            yield pa.record_batch([b.column(0), pa.ListArray.from_arrays(pa.array(where.astype(np.int32)), pa.array(ids, pa.int32()))], ["doc_id", "ids"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, ids array<int>")
