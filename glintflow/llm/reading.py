"""Reading level of each document, from 1 (everyday words) to 5 (scholarly prose).

Each word's acquisition grade is estimated from the graded texts that hold it: its rate among the labelled documents of
each level gives the level at which it is at home. A document's level is predicted from the quantiles of its known words'
grades; a linear discriminant calibrates them on labelled documents that were left out when the grades they are
seen by were estimated (two halves, each graded by the other). Words that tell levels apart count, evenly spread ones do
not; code, lists and boilerplate move the quantiles little.

The labels' sample is bounded: at most ``MAX_LABELLED`` documents, those with the lowest hash of their id, are used to fit, and of these the ones
of at most ``MAX_WORDS`` distinct words, so that at most 8 bytes times both reach the driver. All
documents are then read once, in a narrow pass without a shuffle.

Defined results
---------------
* A row for each document in English by its text, of at least ``LEAST_WORDS`` words at white space, whose type isn't ``log``.
* Null, empty and blank texts have no row; null types are like any other; repeated documents have a row each.
* A document's label is the median of its raters, halves up. Labels outside 1 to 5 or null are passed over. Of several labelled texts of one id the one whose word digests come first is used.
* A document without enough known words gets the middle of the levels. Levels without any label are never given;
  without any label no document is given one. Ties go to the lower level. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glintflow.llm import bytetext
from glintflow.llm.leakage import shards

MAX_LABELLED, MAX_WORDS = 10_000, 2_000
LEAST_WORDS = 40
LEVELS = 5
ENGLISH = 0.62  # least share of English function words among those of English and the next language
LEAST_ENGLISH = 0.1  # and among all words; English prose has 0.2 to 0.4, with code and lists hardly less
LEAST_DOCS = 3  # labelled documents that must hold a word before it has a grade
SPREAD = 0.2  # words less telling than this don't count
QUANTILES = np.array([0.05, 0.1, 0.25, 0.4, 0.5, 0.6, 0.75, 0.9, 0.95])

# fixed values: frequent words that tell languages apart
FUNCTION_WORDS = {
    "en": "the of and to is it that in for with you this are be not can when which from if as by an was has do your",
    "de": "der die das und ist nicht ein eine zu den mit von auf für wird dem im sich auch werden wenn diese oder nach über so vor",
    "fr": "le la les des et est une du que pour dans pas ce sur qui avec il au par ne cette ou plus votre sont être d l",
    "es": "el los las y es una del que para en se por con no lo al como su este esta más ya si cuando o antes así hay",
    "pt": "o os as e é uma do da que para em se por com não ao como seu este esta mais já dos das no na quando ou um",
    "it": "il gli e è una del della che per in si con non al come questo questa più i di un da sono nel ma",
    "nl": "de het een en is van niet dat te op met voor zijn die er aan ook als wordt bij of naar deze om",
}


class Model:
    """Grades of words and the discriminant over their quantiles."""

    def __init__(self, texts: list[np.ndarray], levels: np.ndarray) -> None:
        self.known = len(texts) > 0
        if not self.known:
            return
        half = np.arange(len(texts)) % 2 == 0
        x = np.zeros((len(texts), len(QUANTILES) + 1))
        for side in (half, ~half):
            if (~side).any() and side.any():
                words, grade = self._grades([t for t, s in zip(texts, side, strict=True) if not s], levels[~side])
                x[side] = self._features(*_flat([t for t, s in zip(texts, side, strict=True) if s]), words, grade)
        self.words, self.grade = self._grades(texts, levels)
        self.levels = np.unique(levels)
        mean = np.array([x[levels == k].mean(0) for k in self.levels])
        centred = x - mean[np.searchsorted(self.levels, levels)]
        inverse = np.linalg.inv(centred.T @ centred / len(x) + 1e-3 * np.eye(x.shape[1]))
        share = np.array([(levels == k).mean() for k in self.levels])
        self.weight = inverse @ mean.T
        self.bias = np.log(share) - 0.5 * np.einsum("ij,jk,ik->i", mean, inverse, mean)

    @staticmethod
    def _grades(texts: list[np.ndarray], levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        held = np.concatenate([*texts, np.zeros(0, np.uint64)])
        of = np.repeat(levels, [len(t) for t in texts])
        words, back = np.unique(held, return_inverse=True)
        count = np.zeros((len(words), LEVELS + 1))
        np.add.at(count, (back, of), 1)
        rate = (count / np.maximum(1, np.bincount(levels, minlength=LEVELS + 1)))[:, 1:]
        kept = count.sum(1) >= LEAST_DOCS
        words, rate = words[kept], rate[kept]
        share = rate / rate.sum(1, keepdims=True)
        telling = 1 + (share * np.log(share + 1e-12)).sum(1) / np.log(LEVELS) > SPREAD
        return words[telling], (share * np.arange(1, LEVELS + 1)).sum(1)[telling]

    @staticmethod
    def _features(held: np.ndarray, before: np.ndarray, words: np.ndarray, grade: np.ndarray) -> np.ndarray:
        """Quantiles and mean of the grades of each text's distinct words."""
        n = len(before) - 1
        out = np.full((n, len(QUANTILES) + 1), (LEVELS + 1) / 2)
        if not len(words) or not len(held):
            return out
        at = np.minimum(np.searchsorted(words, held), len(words) - 1)
        ok = words[at] == held
        doc = np.repeat(np.arange(n), np.diff(before))[ok]
        g = grade[at[ok]]
        order = np.lexsort((g, doc))
        g, doc = g[order], doc[order]
        size = np.bincount(doc, minlength=n)
        has = size > 0
        start = np.cumsum(size) - size
        place = start[has, None] + np.rint(QUANTILES * (size[has, None] - 1)).astype(np.int64)
        out[has, :-1] = g[place]
        out[has, -1] = np.bincount(doc, weights=g, minlength=n)[has] / size[has]
        return out

    def predict(self, held: np.ndarray, before: np.ndarray) -> np.ndarray:
        x = self._features(held, before, self.words, self.grade)
        return self.levels[np.argmax(x @ self.weight + self.bias, axis=1)]


def _flat(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([*texts, np.zeros(0, np.uint64)]), np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])


def distinct_words(h: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct words of each text, in order of their hashes."""
    doc = np.repeat(np.arange(len(before) - 1), np.diff(before))
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.concatenate([[0], np.cumsum(np.bincount(doc[new], minlength=len(before) - 1))])


class Languages:
    """Tells English texts by their function words."""

    def __init__(self) -> None:
        names = list(FUNCTION_WORDS)
        words: dict[int, set[int]] = {}
        for k, n in enumerate(names):
            for h in bytetext.hashed([FUNCTION_WORDS[n]])[0].tolist():
                words.setdefault(h, set()).add(k)
        self.words = np.array(sorted(words), np.uint64)
        self.of = np.zeros((len(words), len(names)))
        for i, h in enumerate(self.words.tolist()):
            self.of[i, list(words[h])] = 1

    def english(self, h: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Whether English function words are common in a text and clearly outnumber those of the next language."""
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        ok = self.words[at] == h
        doc = np.repeat(np.arange(len(before) - 1), np.diff(before))[ok]
        votes = np.zeros((len(before) - 1, self.of.shape[1]))
        np.add.at(votes, doc, self.of[at[ok]])
        return (votes[:, 0] > ENGLISH * (votes[:, 0] + votes[:, 1:].max(1))) & (votes[:, 0] >= LEAST_ENGLISH * np.diff(before))


def fitted(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", level: str = "level") -> Model:
    """The model from at most MAX_LABELLED labelled documents."""
    votes = labels.select(F.col(doc_id).alias("_i"), F.col(level).cast("int").alias("_l")).where(f"_i IS NOT NULL AND _l BETWEEN 1 AND {LEVELS}")
    sample = votes.groupBy("_i").agg(F.floor(F.percentile("_l", 0.5) + 0.5).cast("int").alias("_l")).orderBy(F.xxhash64("_i"), "_i").limit(MAX_LABELLED)
    rows = docs.select(F.col(doc_id).alias("_i"), F.col(text).alias("_t")).where("length(_t) > 0").join(F.broadcast(sample), "_i").select("_l", "_t", "_i")  # at most MAX_LABELLED rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in shards(b.column(1)):
                h, before = distinct_words(*bytetext.words(*bytetext.plain(b.column(1).slice(lo, hi - lo))))
                kept = np.flatnonzero(np.diff(before) <= MAX_WORDS)
                words = [h[before[i] : before[i + 1]].tobytes() for i in kept.tolist()]
                yield pa.record_batch([b.column(0).take(pa.array(lo + kept)), pa.array(words, pa.binary()), b.column(2).take(pa.array(lo + kept))], ["level", "words", "i"])

    each = rows.mapInArrow(run, f"level int, words binary, i {dict(rows.dtypes)['_i']}").groupBy("i", "level").agg(F.min("words").alias("words"))  # one text an id
    got = sorted((r[0], bytes(r[1])) for r in each.select("level", "words").collect())
    # sorted by level, so that alternating halves hold all levels
    return Model([np.frombuffer(w, np.uint64) for _, w in got], np.array([k for k, _ in got], np.int64))


def levels(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", doc_type: str = "doc_type") -> DataFrame:
    """(doc_id, level) of each English document that is long enough and no log."""
    model = fitted(docs, labels, doc_id, text)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of at most MAX_LABELLED documents' words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages = Languages()
        known = shared.value
        for b in batches:
            ids, texts = b.column(0), b.column(1)
            for lo, hi in shards(texts):
                part = texts.slice(lo, hi - lo)
                h, before = bytetext.words(*bytetext.plain(part))
                take = languages.english(h, before) & np.array([len(t.split()) >= LEAST_WORDS for t in part.to_pylist()], bool)
                level = known.predict(*distinct_words(h, before)) if known.known else np.zeros(hi - lo, np.int64)
                take &= level > 0
                rows = pa.array(np.flatnonzero(take))
                yield pa.record_batch([ids.slice(lo, hi - lo).take(rows), pa.array(level[take], pa.int32())], ["doc_id", "level"])

    rows = docs.where(f"({doc_type} IS NULL OR lower(trim({doc_type})) <> 'log') AND length({text}) > {LEAST_WORDS}").select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, level int")
