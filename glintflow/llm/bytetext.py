"""Words of whole Arrow columns by numpy, without a loop over words in Python."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WINDOW = 1 << 20
_RNG = np.random.default_rng(7)
_BYTE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _RNG.integers(0, 1 << 63, 1024, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LETTER = np.zeros(256, bool)  # ASCII letters and digits; bytes of other scripts
_LETTER[[*range(48, 58), *range(97, 123)]] = True
_LETTER[128:] = True


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return (raw[off[0] : off[-1]], off - off[0]) if len(column) else (raw[:0], np.zeros(1, np.int64))


def plain(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes with other than ASCII spaces and punctuation blanked and zero-width marks taken out."""
    a, off = buffers(pc.utf8_lower(column.cast(pa.large_string())))
    if not len(a) or int(a.max()) < 128:
        return a, off
    a = np.append(a, np.zeros(2, np.uint8))
    b, c = a[1:-1], a[2:]
    a = a[:-2].copy()
    gone = np.zeros(len(a), bool)
    e2 = (a == 0xE2) & (b == 0x80)
    zero = e2 & (c >= 0x8B) & (c <= 0x8F) | (a == 0xE2) & (b == 0x81) & (c == 0xA0) | (a == 0xEF) & (b == 0xBB) & (c == 0xBF)
    blank3 = (e2 | (a == 0xE3) & (b == 0x80) & (c <= 0x91) | (a == 0xEF) & (b == 0xBC) & (c <= 0x8F)) & ~zero
    soft = (a == 0xC2) & (b == 0xAD)
    blank2 = (a == 0xC2) & (b < 0xC0) & ~soft
    for at, width, target in ((zero, 3, gone), (soft, 2, gone)):
        for k in np.flatnonzero(at):
            target[k : k + width] = True
    for at, width in ((blank3, 3), (blank2, 2)):
        k = np.flatnonzero(at)
        for i in range(width):
            a[k + i] = 32
    if gone.any():
        before = np.concatenate([[0], np.cumsum(gone)])
        return a[~gone], off - before[off]
    return a, off


def words(a: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words in order, and for each text the number of words before it (one more entry than texts)."""
    parts, starts_all = [], []
    lo, total = 0, int(off[-1])
    edge = np.zeros(total + 1, bool)
    edge[off] = True
    while lo < total:
        hi = min(lo + WINDOW, total)
        while hi < total and _LETTER[a[hi]] and not edge[hi]:  # to the end of the word
            hi += 1
        w = a[lo:hi]
        letter = _LETTER[w]
        begin = letter.copy()
        begin[1:] &= ~letter[:-1] | edge[lo + 1 : hi]
        s = np.flatnonzero(begin)
        if len(s):
            # a word ends before the next byte that is no letter, or before the next word
            ends = np.minimum(np.append(s[1:], len(w)), _next_false(letter, s))
            n = ends - s
            flat = np.repeat(s - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            inside = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
            parts.append(np.add.reduceat(_BYTE[w[flat]] * _PLACE[inside % 1024], np.cumsum(n) - n) + n.astype(np.uint64))
            starts_all.append(s + lo)
        lo = hi
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    return np.concatenate(parts), np.searchsorted(np.concatenate(starts_all), off, "left")


def _next_false(letter: np.ndarray, s: np.ndarray) -> np.ndarray:
    gaps = np.append(np.flatnonzero(~letter), len(letter))
    return gaps[np.searchsorted(gaps, s)]


def hashed(texts: list[str]) -> list[np.ndarray]:
    """Word hashes of each text of a short list."""
    h, before = words(*plain(pa.array(texts, pa.large_string())))
    return [h[before[i] : before[i + 1]] for i in range(len(texts))]


def split(text: str) -> list[str]:
    """The words of one text as ``words`` cuts them."""
    a, _ = plain(pa.array([text], pa.large_string()))
    out, word = [], bytearray()
    for b in a.tolist():
        if _LETTER[b]:
            word.append(b)
        elif word:
            out.append(word.decode("utf-8", "replace"))
            word = bytearray()
    return [*out, word.decode("utf-8", "replace")] if word else out
