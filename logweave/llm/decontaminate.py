"""Benchmark decontamination: SimHash over item-sized windows, multi-index Hamming search, exact verification.

Each item has a 128-bit SimHash of its word shingles (five words; all words of a shorter item), weighted by their
IDF over the items. Documents are read in windows of as many words as an item has; a document shorter than an item is
one window, compared as a whole. The eight 16-bit blocks of the
items' fingerprints are indexed with all values at up to three flipped bits, so that a window within Hamming
distance 31 of an item agrees in at least one block. Candidates are then compared exactly: the weighted multiset
Jaccard similarity of the shingles must be 0.8 or more.

Windows without any shingle of an item of their size have similarity 0 and are not fingerprinted; that leaves out
no window that the exact comparison could accept. The items are read in blocks of at most `BLOCK_ITEMS`. If there are
several, one pass over the documents keeps those that have a shingle of any item, by a Bloom filter of at most
2 ** `BITMAP_BITS` bits, and only these few are stored and compared with each block. Weights do not depend
on the blocks: document frequencies are counted over all items first, and the shingles of two or more items go along
with each block, 12 bytes each (all others have a frequency of 1). Only that count is shuffled.

Null or empty texts, and items without words, match nothing. An item with a null id is an item like any other; its
matches have a null item_id. Of equally similar windows the first is told. Repeated rows are reported once each; texts
and items of any length are compared whole, in blocks of 4,096 shingles. Extra columns are not read by `leaks` and
passed through by `clean`.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm import text as tx
from logweave.llm.licences import Lookup
from logweave.llm.session import stored

SHINGLE, SIMILARITY = 5, 0.8
BLOCKS, BLOCK_BITS, FLIPS = 8, 16, 3
RADIUS = BLOCKS * (FLIPS + 1) - 1
#: Items of one pass over the documents; 5,576 index entries each.
BLOCK_ITEMS = 2000
#: Bits of the bitmap of all shingles, at most: 64 MB.
BITMAP_BITS = 29
#: Shingles whose signs are summed at once, 1 KB each.
AT_ONCE = 4096

SCHEMA = "doc_id long, item_id long, first_word long, n_words long, hamming int, similarity double"

MASKS = np.array([sum(1 << b for b in bits) for k in range(FLIPS + 1) for bits in combinations(range(BLOCK_BITS), k)], dtype=np.uint16)


def hashed_words(texts: list[str | None]) -> list[np.ndarray]:
    out = []
    for _, _, buf, offsets in tx.chunks(pa.array(texts, pa.string())):
        starts, ends, at = tx.segments(buf, offsets, tx.SPACE)
        words = tx.segment_hashes(buf, starts, ends)
        out += [words[a:b] for a, b in zip(at, at[1:])]
    return out


def signs(shingles: np.ndarray) -> np.ndarray:
    both = np.stack([shingles, tx.mix64(shingles ^ np.uint64(0x5851F42D4C957F2D))], axis=1)
    return np.unpackbits(both.view(np.uint8), axis=1).astype(np.int8) * 2 - 1


def packed(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1).view(np.uint64)


class Index:
    """The items of one block: shingles by item size, weights, and fingerprints in a multi-index.

    `common` is the number of all items with words, and the shingles of two or more of them in order with their
    document frequencies; without it, the block's items are all."""

    def __init__(self, items: list[tuple[int | None, str | None]], common: tuple[int, np.ndarray, np.ndarray] | None = None):
        words = hashed_words([t for _, t in items])
        self.ids, self.sizes, self.bags = [], [], []
        for (item, _), w in zip(items, words):
            if len(w):
                grams = tx.ngrams(w, np.array([0, len(w)]), min(SHINGLE, len(w)))[0]
                self.ids.append(item)
                self.sizes.append(len(w))
                self.bags.append(Counter(grams.tolist()))
        if common is None:
            df = Counter(g for bag in self.bags for g in bag)
            keys = np.array(sorted(g for g, n in df.items() if n > 1), dtype=np.uint64)
            common = len(self.bags), keys, np.array([df[g] for g in keys.tolist()], dtype=np.int32)
        self.n_items, self.keys, counts = common
        # whole numbers, so that sums are exact in any order; what no two items have weighs as much as the unknown
        self.other = self._weight(1)
        known, at = np.unique(counts, return_inverse=True)
        self.key_weights = np.array([self._weight(n) for n in known.tolist()], dtype=np.int64)[at]
        own = np.array(sorted({g for bag in self.bags for g in bag}), dtype=np.uint64)
        self.weight = dict(zip(own.tolist(), self._weights(own).tolist()))
        self.weights = [sum(c * self.weight[g] for g, c in bag.items()) for bag in self.bags]
        self.by_size: dict[int, Lookup] = {}
        grams_of = defaultdict(set)
        for size, bag in zip(self.sizes, self.bags):
            grams_of[size].update(bag)
        for size, grams in grams_of.items():
            self.by_size[size] = Lookup(np.array(sorted(grams), dtype=np.uint64))
        self.any = {n: Lookup(np.unique(np.concatenate([x.keys for s, x in self.by_size.items() if min(SHINGLE, s) == n])), 20) for n in {min(SHINGLE, s) for s in self.by_size}}
        self.prints = packed(np.stack([self._whole(np.repeat(np.array(list(bag), dtype=np.uint64), list(bag.values()))) for bag in self.bags])) if self.bags else np.zeros((0, 2), dtype=np.uint64)
        self.size_of = np.array(self.sizes, dtype=np.int64)
        self.tables = []
        blocks = self.prints.view(np.uint16).reshape(-1, BLOCKS) if self.bags else np.zeros((0, BLOCKS), dtype=np.uint16)
        for b in range(BLOCKS):
            values = (blocks[:, b][:, None] ^ MASKS[None, :]).ravel()
            order = np.argsort(values, kind="stable")
            self.tables.append((np.searchsorted(values[order], np.arange((1 << BLOCK_BITS) + 1)), (order // len(MASKS)).astype(np.int32)))

    def _weight(self, df: int) -> int:
        return max(1, round(1000 * math.log(1 + self.n_items / df)))

    def _weights(self, grams: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(grams), self.other, dtype=np.int64)
        key = np.minimum(np.searchsorted(self.keys, grams), len(self.keys) - 1)
        return np.where(self.keys[key] == grams, self.key_weights[key], self.other)

    def near(self, prints: np.ndarray, size: int | np.ndarray, clipped: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All (window, item, distance) within RADIUS: items of the windows' size, or longer ones if they are clipped."""
        size = np.broadcast_to(size, len(prints))
        windows, items = [], []
        for b in range(BLOCKS):
            at, entries = self.tables[b]
            value = prints.view(np.uint16).reshape(-1, BLOCKS)[:, b].astype(np.int64)
            lo, count = at[value], at[value + 1] - at[value]
            w = np.repeat(np.arange(len(prints)), count)
            e = entries[np.repeat(lo - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(len(w))]
            ok = self.size_of[e] > size[w] if clipped else self.size_of[e] == size[w]
            windows.append(w[ok])
            items.append(e[ok])
        pair = np.unique(np.concatenate(windows).astype(np.int64) * len(self.ids) + np.concatenate(items))
        w, e = pair // len(self.ids), pair % len(self.ids)
        distance = np.bitwise_count(prints[w] ^ self.prints[e]).sum(axis=1).astype(np.int32)
        ok = distance <= RADIUS
        return w[ok], e[ok], distance[ok]

    def similarity(self, window: np.ndarray, item: int) -> float:
        """Weighted multiset Jaccard similarity of a window's shingles and an item's."""
        bag, mine = self.bags[item], Counter(window.tolist())
        both = sum(self.weight[g] * min(c, bag[g]) for g, c in mine.items() if g in bag)
        total = int(self._weights(window).sum())
        return both / (total + self.weights[item] - both)

    def matches(self, words: np.ndarray, at: np.ndarray) -> dict[tuple[int, int], tuple[float, int, int, int]]:
        """The best window of each (row, item): similarity, first word, words, distance."""
        best: dict[tuple[int, int], tuple[float, int, int, int]] = {}
        rows = tx.row_of(at)
        for n, lookup in self.any.items():
            grams, first, gram_at = tx.ngrams(words, at, n)
            hits, _ = lookup.find(grams)
            if not len(hits):
                continue
            if n == SHINGLE:
                short = np.unique(rows[first[hits]])
                self._clipped(grams, gram_at, short[np.diff(at)[short] < self.size_of.max()], at, best)
            for size, own in self.by_size.items():
                if min(SHINGLE, size) != n:
                    continue
                mine = hits[own.find(grams[hits])[0]]
                if not len(mine):
                    continue
                doc = rows[first[mine]]
                lo, hi = np.maximum(first[mine] - (size - n), at[doc]), np.minimum(first[mine], at[doc + 1] - size)
                lo, hi = lo[hi >= lo], hi[hi >= lo]
                if not len(lo):
                    continue
                # windows as runs of neighbouring starts: hits are in order, so overlapping ranges join up
                new = np.concatenate(([True], lo[1:] > np.maximum.accumulate(hi)[:-1] + 1))
                for a, b in zip(lo[new], np.maximum.reduceat(hi, np.flatnonzero(new))):
                    for a2 in range(int(a), int(b) + 1, 4096):
                        b2 = min(int(b), a2 + 4095)
                        self._run(grams, int(np.searchsorted(first, a2)), a2, b2, size, n, at, rows, best)
        return best

    def _whole(self, part: np.ndarray) -> np.ndarray:
        """The sum of the weighted signs of all shingles."""
        total = np.zeros(128, dtype=np.int64)
        for a in range(0, len(part), AT_ONCE):
            some = part[a : a + AT_ONCE]
            total += self._weights(some) @ signs(some)
        return total

    def _windows(self, part: np.ndarray, span: int) -> np.ndarray:
        """That sum for each window of `span` shingles: running sums, of which only those at windows' ends are held."""
        n = len(part) - span + 1
        low, high, carry = np.zeros((n, 128), dtype=np.int64), np.zeros((n, 128), dtype=np.int64), np.zeros(128, dtype=np.int64)
        for a in range(0, len(part), AT_ONCE):
            some = part[a : a + AT_ONCE]
            sums = carry + np.cumsum(signs(some) * self._weights(some)[:, None], axis=0, dtype=np.int64)  # up to a + 1, a + 2, ...
            b, carry = a + len(some), sums[-1]
            lo, hi = max(a + 1, 1), min(b + 1, n)
            if lo < hi:
                low[lo:hi] = sums[lo - a - 1 : hi - a - 1]
            lo, hi = max(a + 1, span), min(b + 1, span + n)
            if lo < hi:
                high[lo - span : hi - span] = sums[lo - a - 1 : hi - a - 1]
        return high - low

    def _clipped(self, grams, gram_at, docs, at, best) -> None:
        """Whole documents against all items that are longer."""
        turn = np.cumsum(gram_at[docs + 1] - gram_at[docs]) // AT_ONCE
        for some in np.split(docs, np.flatnonzero(np.diff(turn)) + 1) if len(docs) else []:
            parts = [grams[gram_at[d] : gram_at[d + 1]] for d in some]
            size = at[some + 1] - at[some]
            w, e, distance = self.near(packed(np.stack([self._whole(part) for part in parts])), size, clipped=True)
            for i, item, d in zip(w.tolist(), e.tolist(), distance.tolist()):
                s = self.similarity(parts[i], item)
                if s >= SIMILARITY:
                    best[int(some[i]), item] = (s, 0, int(size[i]), d)

    def _run(self, grams, g, a, b, size, n, at, rows, best) -> None:
        part = grams[g : g + (b - a) + size - n + 1]
        span = size - n + 1
        w, e, distance = self.near(packed(self._windows(part, span)), size)
        for i, item, d in zip(w.tolist(), e.tolist(), distance.tolist()):
            s = self.similarity(part[i : i + span], item)
            if s >= SIMILARITY:
                doc = int(rows[a + i])
                found = (s, -(a + i - int(at[doc])), size, d)
                if found > best.get((doc, item), (0.0, 0, 0, 0)):
                    best[doc, item] = found

    def search(self, column: pa.Array) -> Iterator[tuple[int, int | None, int, int, int, float]]:
        """(row, item id, first word, words, distance, similarity) of each match of a column of texts."""
        for lo, _, buf, offsets in tx.chunks(column):
            starts, ends, at = tx.segments(buf, offsets, tx.SPACE)
            found = self.matches(tx.segment_hashes(buf, starts, ends), at)
            for (doc, item), (s, first, size, d) in sorted(found.items()):
                yield lo + doc, self.ids[item], -first, size, d, s


_built: dict[str, Index] = {}
#: A block of items, and what `frequencies` gives of all of them if there are several blocks.
Block = tuple[Broadcast, Broadcast | None]


def _index(items: Block) -> Index:
    """The index of a broadcast block, built once in each Python worker."""
    name, rows = items[0].value
    if name not in _built:
        _built.clear()
        _built[name] = Index(rows, items[1] and items[1].value)
    return _built[name]


def frequencies(items: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """The number of items with words, and the shingles of two or more items in order with their frequencies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in hashed_words(batch["text"].to_pylist()):
                if len(words):
                    grams = np.unique(tx.ngrams(words, np.array([0, len(words)]), min(SHINGLE, len(words)))[0])
                    # a row without a shingle counts the item
                    yield pa.record_batch([pa.array([None, *grams.view(np.int64).tolist()], pa.int64())], names=["gram"])

    found = items.select("text").mapInArrow(run, "gram long").groupBy("gram").agg(F.count(F.lit(1)).cast("int").alias("n"))
    got = found.where("gram is null or n > 1").toArrow()
    gram, n = got["gram"].combine_chunks(), got["n"].to_numpy()
    none = gram.is_null().to_numpy(zero_copy_only=False)
    keys = gram.fill_null(0).to_numpy().view(np.uint64)[~none]
    order = np.argsort(keys)
    return int(n[none].sum()), keys[order], n[~none][order].astype(np.int32)


def item_blocks(benchmark: DataFrame) -> list[Block]:
    """The items in broadcast blocks of at most BLOCK_ITEMS rows."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    blocks = max(1, -(-items.count() // BLOCK_ITEMS))
    context, out, block = benchmark.sparkSession.sparkContext, [], []
    common = context.broadcast(frequencies(items)) if blocks > 1 else None
    for row in items.orderBy("item_id", "text").toLocalIterator() if blocks > 1 else sorted(items.collect(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        block.append((row["item_id"], row["text"]))
        if len(block) == BLOCK_ITEMS:
            out.append((context.broadcast((uuid.uuid4().hex, block)), common))
            block = []
    return [*out, (context.broadcast((uuid.uuid4().hex, block)), common)] if block or not out else out


#: A filter of all items' shingles: its bits, how far places are shifted into them, and the shingles' lengths.
Bitmap = tuple[np.ndarray, int, list[int]]
#: Bits a shingle and places a shingle: of 10**5 other shingles one passes, as long as the bitmap may grow.
BITS_EACH, PROBES = 24, 8


def _probe(hashes: np.ndarray, k: int, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """The byte and the bit of each hash's k-th place."""
    with np.errstate(over="ignore"):
        place = tx.mix64(hashes + np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)) >> np.uint64(shift)
    return (place >> np.uint64(3)).astype(np.int64), (place & np.uint64(7)).astype(np.uint8)


def shingle_bitmap(blocks: list[Block]) -> Bitmap:
    """The filter over the shingles of all items."""
    hashes, lengths = [], set()
    for block, _ in blocks:
        for words in hashed_words([t for _, t in block.value[1]]):
            if len(words):
                lengths.add(min(SHINGLE, len(words)))
                hashes.append(np.unique(tx.ngrams(words, np.array([0, len(words)]), min(SHINGLE, len(words)))[0]))
    bits = min(BITMAP_BITS, max(10, (BITS_EACH * sum(map(len, hashes))).bit_length()))
    bitmap, shift = np.zeros(1 << (bits - 3), dtype=np.uint8), 64 - bits
    for h in hashes:
        for k in range(PROBES):
            byte, bit = _probe(h, k, shift)
            np.bitwise_or.at(bitmap, byte, np.uint8(1) << bit)
    return bitmap, shift, sorted(lengths)


def suspects(column: pa.Array, bitmap: Bitmap) -> np.ndarray:
    """Whether each text may have a shingle of an item; where this is false, it has none."""
    bits, shift, lengths = bitmap
    out = np.zeros(len(column), dtype=bool)
    for lo, _, buf, offsets in tx.chunks(column):
        starts, ends, at = tx.segments(buf, offsets, tx.SPACE)
        words = tx.segment_hashes(buf, starts, ends)
        for n in lengths:
            grams, _, gram_at = tx.ngrams(words, at, n)
            left = np.arange(len(grams))
            for k in range(PROBES):  # few are left after the first
                byte, bit = _probe(grams[left], k, shift)
                left = left[(bits[byte] >> bit & 1).astype(bool)]
            out[lo + np.searchsorted(gram_at, left, side="right") - 1] = True
    return out


def _split(documents: DataFrame, bitmap: Broadcast, suspected: bool) -> DataFrame:
    """The documents that may have a shingle of an item, or all others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(suspects(batch["text"], bitmap.value) == suspected))

    return documents.mapInArrow(run, documents.schema)


def _leaks(documents: DataFrame, items: Block) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(items)
        for batch in batches:
            found = list(index.search(batch["text"])) if batch.num_rows else []
            if found:
                row, *rest = zip(*found)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.float64())
                yield pa.record_batch([batch["doc_id"].cast(pa.int64()).take(pa.array(row)), *(pa.array(v, k) for v, k in zip(rest, kinds))], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return documents.mapInArrow(run, SCHEMA)


def _clean(documents: DataFrame, items: Block) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(items)
        for batch in batches:
            if batch.num_rows:
                drop = np.ones(batch.num_rows, dtype=bool)
                drop[[x[0] for x in index.search(batch["text"])]] = False
                yield batch.filter(pa.array(drop))

    return documents.mapInArrow(run, documents.schema)


def leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document row and item that it has a window of: the most similar window, the first of equals.

    n_words are the window's: fewer than the item's if the document is shorter than the item."""
    blocks, documents = item_blocks(benchmark), documents.select("doc_id", "text")
    if len(blocks) > 1:
        bitmap = documents.sparkSession.sparkContext.broadcast(shingle_bitmap(blocks))
        documents = stored(_split(documents, bitmap, True), "decontaminate-suspects")
    return reduce(DataFrame.unionAll, [_leaks(documents, b) for b in blocks])


def clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without any match, with all their columns."""
    blocks = item_blocks(benchmark)
    if len(blocks) == 1:
        return _clean(documents, blocks[0])
    bitmap = documents.sparkSession.sparkContext.broadcast(shingle_bitmap(blocks))
    rest = _split(documents, bitmap, True)
    for block in blocks:
        rest = _clean(stored(rest, "decontaminate-suspects"), block)
    return _split(documents, bitmap, False).unionAll(rest)
