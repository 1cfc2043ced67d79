"""Licence scans by a positional rare-token index.

Templates are licence notices with mandatory key phrases. The index has a posting (phrase, place) under every word of a
phrase, and document frequencies of all template words are counted over all documents. In a file, the licence words it
has are looked up, the highest IDF first: a phrase stays a candidate while each of its words, taken in that order, is in
the file, so most phrases fall with their rarest word. For a candidate, the postings of its two words that the file has
fewest of (the higher IDF of equals) are intersected by relative position: both must give the same start. What is left
is compared word by word. A template's label needs all of its phrases, as far apart as in the template give or take
`SLACK` of their distance; its score is the IDF-weighted share of template words found at their places, give or
take two, and must reach `MIN_SCORE`. No shuffle of texts; the driver gets one count per template word.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z. A null text counts as empty: no words, no
labels, score 0. Of several notices the best score is told; a phrase at several places counts at each. Long texts are
scanned whole, and notices are scored some at a time, so memory grows with a text's words only. Repeated rows get equal
results; extra columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm import text as tx
from logweave.llm.licence_texts import NOTICES

#: (label, phrase): found wherever the words stand consecutively.
BASE = [("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")]

SLACK, SPREAD, MIN_SCORE = 0.25, 2, 0.5
#: Template words that are looked for at once when notices are scored.
AT_ONCE = 1 << 20

_BREAK = np.ones(256, dtype=bool)
_BREAK[0x30:0x3A] = _BREAK[0x61:0x7B] = _BREAK[0x80:] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32

SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def words_of(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words, and the rows' offsets into them."""
    buf = _LOWER[buf]
    starts, ends, at = tx.segments(buf, offsets, _BREAK)
    return tx.segment_hashes(buf, starts, ends), at


def hash_phrase(phrase: str) -> np.ndarray:
    buf = np.frombuffer(phrase.encode(), dtype=np.uint8)
    return words_of(buf, np.array([0, len(buf)]))[0]


def plain(phrase: str) -> list[str]:
    """The words of a phrase, lower-cased."""
    return re.findall("[0-9a-z]+", phrase.lower())


#: (label, notice, key phrases)
TEMPLATES = NOTICES
VOCABULARY = sorted({w for _, notice, _ in TEMPLATES for w in plain(notice)} | {w for _, p in BASE for w in plain(p)})


class Lookup:
    """Which of a few sorted hashes a hash is; most are ruled out by one table look-up."""

    def __init__(self, keys: np.ndarray, bits: int = 16):
        self.keys, self.shift = keys, np.uint64(64 - bits)
        self.maybe = np.zeros(1 << bits, dtype=bool)
        self.maybe[(keys >> self.shift).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in hashes, and indexes of their keys."""
        at = np.flatnonzero(self.maybe[(hashes >> self.shift).astype(np.int64)]) if len(self.keys) else np.zeros(0, dtype=np.int64)
        key = np.minimum(np.searchsorted(self.keys, hashes[at]), max(0, len(self.keys) - 1))
        same = self.keys[key] == hashes[at] if len(at) else np.zeros(0, dtype=bool)
        return at[same], key[same]


@dataclass
class Phrase:
    words: list[int]  # numbers in the vocabulary
    by_idf: list[int]  # its places, the highest IDF first
    place: int = 0  # its first word in the template


@dataclass
class Template:
    label: str
    words: np.ndarray
    weight: np.ndarray
    phrases: list[Phrase]


class Occurrences:
    """Where the licence words of a chunk's rows stand: ascending places of each (row, word)."""

    def __init__(self, rows: np.ndarray, words: np.ndarray, places: np.ndarray, n_words: int):
        key = rows * n_words + words
        order = np.argsort(key, kind="stable")
        self.places, key = places[order], key[order]
        self.keys, self.first = np.unique(key, return_index=True)
        self.end, self.n_words = np.append(self.first[1:], len(key)), n_words
        by_word = np.argsort(self.keys % n_words, kind="stable")
        self.rows_by_word, at = self.keys[by_word] // n_words, np.searchsorted(self.keys[by_word] % n_words, np.arange(n_words + 1))
        self.word_at = at

    def rows_with(self, word: int) -> np.ndarray:
        return self.rows_by_word[self.word_at[word] : self.word_at[word + 1]]

    def of(self, row: int, word: int) -> np.ndarray:
        i = np.searchsorted(self.keys, row * self.n_words + word)
        return self.places[self.first[i] : self.end[i]]


class PositionalIndex:
    """Postings of all phrases under all their words."""

    def __init__(self, idf: dict[str, float]):
        self.idf = idf
        number = {w: i for i, w in enumerate(VOCABULARY)}
        hashes = np.concatenate([hash_phrase(w) for w in VOCABULARY])
        order = np.argsort(hashes)
        self.lookup, self.number = Lookup(hashes[order]), order
        self.base = [(label, self._phrase(plain(p), number)) for label, p in BASE]
        self.templates = []
        for label, notice, keys in TEMPLATES:
            words, place, phrases = plain(notice), 0, []
            for key in map(plain, keys):
                place = next(i for i in range(place, len(words)) if words[i : i + len(key)] == key)
                phrases.append(self._phrase(key, number, place))
            weight = np.array([max(idf.get(w, 0.0), 1e-3) for w in words])
            self.templates.append(Template(label, np.array([number[w] for w in words]), weight / weight.sum(), phrases))

    def _phrase(self, words: list[str], number: dict[str, int], place: int = 0) -> Phrase:
        order = sorted(range(len(words)), key=lambda i: (-self.idf.get(words[i], 0.0), i))
        return Phrase([number[w] for w in words], order, place)

    def _candidates(self, phrases: list[Phrase], found: Occurrences) -> np.ndarray:
        """Rows that have all words of all phrases, looked up by falling IDF."""
        rows, seen = None, set()
        for p in phrases:
            for i in p.by_idf:
                if p.words[i] not in seen:
                    seen.add(p.words[i])
                    have = found.rows_with(p.words[i])
                    rows = have if rows is None else np.intersect1d(rows, have, assume_unique=True)
                    if not len(rows):
                        return rows
        return rows

    def _starts(self, p: Phrase, row: int, found: Occurrences, at: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        """Where the phrase stands in a row: the postings of its two rarest words there, intersected, then verified."""
        few = sorted(p.by_idf, key=lambda i: len(found.of(row, p.words[i])))
        start = found.of(row, p.words[few[0]]) - few[0]
        start = start[(start >= at[row]) & (start + len(p.words) <= at[row + 1])]
        if len(few) > 1:
            other = found.of(row, p.words[few[1]]) - few[1]
            i = np.minimum(np.searchsorted(other, start), len(other) - 1)
            start = start[other[i] == start]
        for i in few[2:]:
            start = start[numbers[start + i] == p.words[i]]
        return start

    def _notices(self, t: Template, row: int, found: Occurrences, at: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        """Starts of the template's first phrase after which its other phrases follow."""
        first, *others = t.phrases
        start = self._starts(first, row, found, at, numbers)
        want, before = start, first
        for p in others:
            if not len(start):
                break
            gap = p.place - before.place
            slack = max(1, round(SLACK * gap))
            there = self._starts(p, row, found, at, numbers)
            if not len(there):
                return there
            want = want + gap
            i = np.searchsorted(there, want - slack)
            near = (i < len(there)) & (there[np.minimum(i, len(there) - 1)] <= want + slack)
            start, want, before = start[near], there[i[near]], p
        return start

    def _score(self, t: Template, starts: np.ndarray, lo: int, hi: int, numbers: np.ndarray) -> float:
        """The best weighted share of the template's words at their places, of all notices of a row."""
        best, step = 0.0, max(1, AT_ONCE // len(t.words))
        for a in range(0, len(starts), step):
            place = (starts[a : a + step] - t.phrases[0].place)[:, None] + np.arange(len(t.words))[None, :]
            found = np.zeros(place.shape, dtype=bool)
            for shift in range(-SPREAD, SPREAD + 1):
                i = place + shift
                found |= (i >= lo) & (i < hi) & (numbers[np.clip(i, 0, len(numbers) - 1)] == t.words[None, :])
            best = max(best, float((found @ t.weight).max()))
        return min(best, 1.0)

    def scan(self, column: pa.Array) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")}
        for _, _, buf, offsets in tx.chunks(column):
            words, at = words_of(buf, offsets)
            n, rows = len(at) - 1, tx.row_of(at)
            hits, kinds = self.lookup.find(words)
            kinds = self.number[kinds]
            numbers = np.full(len(words), -1, dtype=np.int32)
            numbers[hits] = kinds
            found = Occurrences(rows[hits], kinds, hits, len(VOCABULARY))
            n_base, score = np.zeros(n, dtype=np.int64), np.zeros(n)
            first, last = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
            base_labels: dict[int, set[str]] = {}
            labels: dict[int, set[str]] = {}
            for label, p in self.base:
                for row in self._candidates([p], found).tolist():
                    start = self._starts(p, row, found, at, numbers)
                    if len(start):
                        n_base[row] += len(start)
                        first[row], last[row] = min(first[row], start[0] - at[row]), max(last[row], start[-1] - at[row])
                        score[row] = 1.0
                        base_labels.setdefault(row, set()).add(label)
                        labels.setdefault(row, set()).add(label)
            for t in self.templates:
                for row in self._candidates(t.phrases, found).tolist():
                    start = self._notices(t, row, found, at, numbers)
                    s = self._score(t, start, at[row], at[row + 1], numbers) if len(start) else 0.0
                    if s >= MIN_SCORE:
                        labels.setdefault(row, set()).add(t.label)
                        score[row] = max(score[row], s)
            out["n_words"] += np.diff(at).tolist()
            out["n_base"] += n_base.tolist()
            out["first_word"] += [x if c else None for x, c in zip(first.tolist(), n_base.tolist())]
            out["last_word"] += [x if c else None for x, c in zip(last.tolist(), n_base.tolist())]
            out["base_labels"] += [",".join(sorted(base_labels.get(d, ()))) for d in range(n)]
            out["labels"] += [",".join(sorted(labels.get(d, ()))) for d in range(n)]
            out["score"] += score.tolist()
        return out


def word_idf(documents: DataFrame) -> dict[str, float]:
    """IDF of each template word, from its document frequency over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = np.concatenate([hash_phrase(w) for w in VOCABULARY])
        order = np.argsort(hashed)
        lookup, total, found = Lookup(hashed[order]), 0, np.zeros(len(hashed), dtype=np.int64)
        for batch in batches:
            for _, _, buf, offsets in tx.chunks(batch["text"]):
                words, at = words_of(buf, offsets)
                total += len(at) - 1
                hits, kinds = lookup.find(words)
                pair = np.unique(np.searchsorted(at, hits, side="right") * len(hashed) + kinds)
                found += np.bincount(pair % len(hashed), minlength=len(hashed))
        yield pa.record_batch([pa.array([*order.tolist(), -1]), pa.array([*found.tolist(), total])], names=["word", "n"])

    rows = documents.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    n = {r["word"]: r["n"] for r in rows}
    return {w: math.log((n.get(-1, 0) + 1) / (n.get(i, 0) + 1)) for i, w in enumerate(VOCABULARY)}


def scan(documents: DataFrame) -> DataFrame:
    """One row per document: base places, labels and score."""
    idf = documents.sparkSession.sparkContext.broadcast(word_idf(documents))  # one number per template word

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = PositionalIndex(idf.value)  # a few thousand words
        kinds = {"base_labels": pa.string(), "labels": pa.string(), "score": pa.float64()}
        for batch in batches:
            if batch.num_rows:
                out = index.scan(batch["text"])
                yield pa.record_batch([batch["doc_id"].cast(pa.int64()), *(pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items())], names=["doc_id", *out])

    return documents.select("doc_id", "text").mapInArrow(run, SCHEMA)
