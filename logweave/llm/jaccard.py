"""N-gram Jaccard join: all documents whose sets of five-word shingles have a similarity of 0.8 or more.

Chosen-path search. Equal sets are one class from the start, so exact copies cost nothing further. A class's set is
embedded in `TOKENS` min-wise tokens. Each of `RUNS` runs splits all classes on one sampled token: classes that share
it share a bucket. A bucket above `SMALL` is split again on two more tokens, chosen by its path, unless more than half
of it would stay together anyway (copies of one text); what is left after `DEPTH` levels stays. Buckets are brute-forced,
in tiles of two blocks where they are large, so no task holds more than two blocks. A pair of similarity 0.8 is missed by
a run with probability 0.2 if its bucket is small, by all ten runs with 1e-7; after one more split the ten runs miss it
with 6e-7 (target recall: 0.9999 at the threshold, more above it).

Brute force has two steps: sizes and tokens rule out pairs (estimates below `MAYBE`, five standard deviations under
0.8), then the texts of what is left are read once more and compared by their whole sets. A pair that meets in several
buckets counts in the one with the smallest name only, so links are exact sums without any list of all pairs; tiles
report, for each class, its links and the smallest class it is connected to. Components follow by rounds of smallest
labels with pointer jumping over these edges, each round stored.

Texts under five words have one shingle, all their words; texts without words (null, empty) have no set: they link to
nothing and are classes of their own; long texts are compared by all their shingles. Repeated rows are copies. A null doc_id is a row like others, but can't be a
class id unless all of the class are null. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweave.llm import text as tx
from logweave.llm.session import partitions, scratch, stored

SHINGLE, SIMILARITY = 5, 0.8
TOKENS, RUNS, SMALL, DEPTH, BRANCHES = 64, 10, 128, 3, 2
#: Agreeing tokens from which a pair is compared by its sets.
MAYBE = 35
#: Classes and shingles of a block, about; a tile has one or two blocks.
BLOCK, BLOCK_SHINGLES = 512, 1 << 20

_ODD = tx.mix64(np.arange(1, TOKENS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).astype(np.uint32) | np.uint32(1)
_XOR = (tx.mix64(np.arange(1, TOKENS + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(32)).astype(np.uint32)


def shingle_sets(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows' sets of shingle hashes, sorted, and the rows' offsets into them."""
    starts, ends, at = tx.segments(buf, offsets, tx.SPACE)
    words = tx.segment_hashes(buf, starts, ends)
    grams, _, gram_at = tx.ngrams(words, at, SHINGLE)
    n_words = np.diff(at)
    short = np.flatnonzero((n_words > 0) & (n_words < SHINGLE))
    if len(short):
        parts, counts = [], np.diff(gram_at)
        extra = {int(i): tx.ngrams(words[at[i] : at[i + 1]], np.array([0, n_words[i]]), int(n_words[i]))[0] for i in short}
        for i in range(len(counts)):
            parts.append(extra[i] if i in extra else grams[gram_at[i] : gram_at[i + 1]])
        counts[short] = 1
        grams, gram_at = np.concatenate(parts), np.concatenate(([0], np.cumsum(counts)))
    for a, b in zip(gram_at[:-1].tolist(), gram_at[1:].tolist()):
        grams[a:b].sort()
    rows = tx.row_of(gram_at)
    new = np.ones(len(grams), dtype=bool)
    new[1:] = (grams[1:] != grams[:-1]) | (rows[1:] != rows[:-1])
    return grams[new], np.concatenate(([0], np.cumsum(tx.range_sum(new, gram_at[:-1], gram_at[1:]))))


def set_digests(sets: np.ndarray, at: np.ndarray) -> list[bytes]:
    """16 bytes for each set: two sums of mixed hashes."""
    with np.errstate(over="ignore"):
        a = tx.range_sum(tx.mix64(sets), at[:-1], at[1:], np.uint64)
        b = tx.range_sum(tx.mix64(sets ^ np.uint64(0x94D049BB133111EB)), at[:-1], at[1:], np.uint64)
    both = np.stack([a, b], axis=1)
    return [x.tobytes() for x in both]


def min_tokens(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each (nonempty) set the smallest value of each of TOKENS hash functions."""
    low, out = (sets >> np.uint64(32)).astype(np.uint32), np.empty((len(at) - 1, TOKENS), dtype=np.uint32)
    for i in range(TOKENS):
        out[:, i] = np.minimum.reduceat((low ^ _XOR[i]) * _ODD[i], at[:-1])
    return out.view(np.int32)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, buf, offsets in tx.chunks(batch["text"]):
            sets, at = shingle_sets(buf, offsets)
            n = np.diff(at)
            full = np.flatnonzero(n)
            tokens = min_tokens(sets, np.append(at[:-1][full], len(sets))) if len(full) else np.zeros((0, TOKENS), dtype=np.int32)
            digests = set_digests(sets, at)
            place = np.full(hi - lo, -1)
            place[full] = np.arange(len(full))
            list_at = np.concatenate(([0], np.cumsum(np.where(n > 0, TOKENS, 0)))).astype(np.int32)
            yield pa.record_batch(
                [
                    batch["doc_id"][lo:hi].cast(pa.int64()),
                    batch["rid"][lo:hi],
                    batch["text_hash"][lo:hi],
                    pa.array([d if k else None for d, k in zip(digests, n.tolist())], pa.binary()),
                    pa.array(n, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(list_at), pa.array(tokens.ravel())),
                ],
                names=["doc_id", "rid", "text_hash", "digest", "n", "tokens"],
            )


def _rid() -> Column:
    """What a document's text is found again by."""
    return F.coalesce("doc_id", F.xxhash64("text")).cast("long")


def describe(documents: DataFrame) -> DataFrame:
    """(doc_id, rid, text_hash, digest, n, tokens) of every document; digest is null without words."""
    narrow = documents.select("doc_id", _rid().alias("rid"), F.xxhash64("text").alias("text_hash"), "text")
    return narrow.mapInArrow(_describe, "doc_id long, rid long, text_hash long, digest binary, n long, tokens array<int>")


def _children(rows: DataFrame, level: int) -> DataFrame:
    """rows (key, digest, n, tokens) split on BRANCHES tokens that the path chooses."""
    branch = rows.withColumn("branch", F.explode(F.array(*[F.lit(b) for b in range(BRANCHES)])))
    pick = (F.pmod(F.xxhash64("key", "branch", F.lit(level)), F.lit(TOKENS)) + 1).cast("int")
    return branch.select("digest", "n", F.col("key").alias("parent"), "branch", F.xxhash64("key", "branch", F.element_at("tokens", pick)).alias("key"))


def buckets(classes: DataFrame) -> DataFrame:
    """(key, digest, size, total): the buckets of all runs that are to be brute-forced, each with two classes at
    least; total counts their shingles."""
    runs = F.explode(F.array(*[F.struct(F.lit(r).alias("run"), F.element_at("tokens", r + 1).alias("token")) for r in range(RUNS)]))
    rows = classes.select("digest", "n", runs.alias("x")).select("digest", "n", F.xxhash64("x.run", "x.token").alias("key"))
    done, level = [], 0
    while True:
        sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("total")).where("size > 1")
        sized = stored(rows.join(sizes, "key").select("key", "digest", "size", "total"), f"jaccard-level{level}")
        level += 1
        large = sized.where(F.col("size") > SMALL)
        if level == DEPTH or large.isEmpty():
            return reduce(DataFrame.unionByName, [*done, sized])
        children = stored(_children(large.join(classes.select("digest", "n", "tokens"), "digest"), level), f"jaccard-children{level}")
        counts = children.groupBy("parent", "branch", "key").agg(F.count(F.lit(1)).alias("k"))
        whole = counts.groupBy("parent").agg(F.max("k").alias("most")).join(large.select(F.col("key").alias("parent"), "size").distinct(), "parent").where("2 * most > size").select("parent")
        done += [sized.where(F.col("size") <= SMALL), large.join(whole.withColumnRenamed("parent", "key"), "key", "left_semi")]
        rows = children.join(whole, "parent", "left_anti").select("digest", "n", "key")


def tiles(members: DataFrame) -> DataFrame:
    """members (key, size, total, digest, ...) with tile, block and `both`: a tile pairs two blocks of a bucket, or one with itself."""
    blocks = F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("total") / BLOCK_SHINGLES))
    m = members.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("digest"), F.col("blocks")))
    m = m.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    tile = F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other"))
    return m.withColumn("tile", tile).withColumn("side", (F.col("block") > F.col("other")).cast("int")).withColumn("both", (F.col("block") != F.col("other"))).drop("blocks", "block", "other")


def _whole_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole tiles, from rows sorted by tile."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        tile = batch["tile"].to_numpy()
        if tile[0] == tile[-1]:
            if held and held[-1]["tile"][-1].as_py() != tile[0]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch)
            continue
        cut = int(np.flatnonzero(tile != tile[-1])[-1]) + 1
        yield pa.Table.from_batches([*held, batch.slice(0, cut)])
        held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    array = column.combine_chunks()
    array = array.chunk(0) if isinstance(array, pa.ChunkedArray) else array
    offsets = array.offsets.to_numpy()
    return array.flatten().to_numpy(zero_copy_only=False), offsets - offsets[0]


def _pairs(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one tile that may be similar and whose first common bucket this is."""
    tile, n = table["tile"].to_numpy(), table["n"].to_numpy()
    side, both = table["side"].to_numpy(), table["both"].to_numpy(zero_copy_only=False).astype(bool)
    key = table["key"].to_numpy()
    tokens = _lists(table["tokens"])[0].reshape(-1, TOKENS)
    names, name_at = _lists(table["names"])
    starts = np.flatnonzero(np.concatenate(([True], tile[1:] != tile[:-1])))
    sizes = np.diff(np.append(starts, len(tile)))
    first, second = [], []

    def consider(i: np.ndarray, j: np.ndarray) -> None:
        ok = (n[i] >= SIMILARITY * n[j]) & (n[j] >= SIMILARITY * n[i]) & (~both[i] | (side[i] != side[j]))
        i, j = i[ok], j[ok]
        for a in range(0, len(i), 1 << 16):
            p, q = i[a : a + (1 << 16)], j[a : a + (1 << 16)]
            ok = (tokens[p] == tokens[q]).sum(axis=1) >= MAYBE
            first.append(p[ok])
            second.append(q[ok])

    few = sizes <= 32
    small_tile = np.repeat(few, sizes)
    position = np.arange(len(tile)) - np.repeat(starts, sizes)
    left = np.repeat(sizes, sizes) - position - 1
    for d in range(1, int(sizes[few].max(initial=1))):
        i = np.flatnonzero(small_tile & (left >= d))
        consider(i, i + d)
    for s, size in zip(starts[~few].tolist(), sizes[~few].tolist()):
        for i in range(size - 1):
            consider(np.full(size - 1 - i, s + i), np.arange(s + i + 1, s + size))
    i, j = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (first, second))
    keep = np.ones(len(i), dtype=bool)
    owner = tx.row_of(name_at)
    lower = names < key[owner]
    name_at = np.concatenate(([0], np.cumsum(tx.range_sum(lower, name_at[:-1], name_at[1:]))))
    kinds, ids = np.unique(names[lower], return_inverse=True)
    held = owner[lower] * np.int64(len(kinds)) + ids  # ascending: names are sorted in each row
    for lo in range(0, len(i) if len(held) else 0, 1 << 16):
        a, b = i[lo : lo + (1 << 16)], j[lo : lo + (1 << 16)]
        count = name_at[a + 1] - name_at[a]
        pair = np.repeat(np.arange(len(a)), count)
        at = np.repeat(name_at[a] - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(len(pair))
        want = b[pair] * np.int64(len(kinds)) + ids[at]
        found = held[np.minimum(np.searchsorted(held, want), len(held) - 1)] == want
        keep[lo + pair[found]] = False
    return i[keep], j[keep]


_CARRIED = "tile long, key long, side int, both boolean, digest binary, n long, copies long, tokens array<int>, names array<long>"


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in _whole_tiles(batches):
        i, j = _pairs(table)
        if len(i):
            yield from table.take(pa.array(np.unique(np.concatenate((i, j))))).combine_chunks().to_batches()


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in _whole_tiles(batches):
        i, j = _pairs(table)
        if not len(i):
            continue
        flat = [np.frombuffer(x, dtype=np.uint64) for x in table["set"].to_pylist()]
        both = np.empty(len(i), dtype=np.int64)
        order = np.argsort(i, kind="stable")
        i, j = i[order], j[order]
        at = np.flatnonzero(np.concatenate(([True], i[1:] != i[:-1])))
        for a, b in zip(at.tolist(), np.append(at[1:], len(i)).tolist()):
            mine = flat[i[a]]
            others = [flat[x] for x in j[a:b].tolist()]
            joined, ends = np.concatenate(others), np.cumsum([len(x) for x in others])
            found = mine[np.minimum(np.searchsorted(mine, joined), len(mine) - 1)] == joined
            both[a:b] = tx.range_sum(found, np.concatenate(([0], ends[:-1])), ends)
        n, copies, digest = table["n"].to_numpy(), table["copies"].to_numpy(), table["digest"].to_pylist()
        # exact: both / (n + n' - both) >= 4 / 5
        ok = 9 * both >= 4 * (n[i] + n[j])
        i, j = i[ok], j[ok]
        if not len(i):
            continue
        links, parent = np.zeros(len(n), dtype=np.int64), list(range(len(n)))
        np.add.at(links, i, copies[j])
        np.add.at(links, j, copies[i])

        def root(x: int, parent=parent) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for a, b in zip(i.tolist(), j.tolist()):
            a, b = root(a), root(b)
            if a != b:
                a, b = (a, b) if digest[a] < digest[b] else (b, a)
                parent[b] = a
        rows = np.unique(np.concatenate((i, j))).tolist()
        yield pa.record_batch([pa.array([digest[x] for x in rows], pa.binary()), pa.array(links[rows]), pa.array([digest[root(x)] for x in rows], pa.binary())], names=["digest", "links", "root"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, buf, offsets in tx.chunks(batch["text"]):
            sets, at = shingle_sets(buf, offsets)
            yield pa.record_batch([pa.array(set_digests(sets, at), pa.binary()), pa.array([sets[a:b].tobytes() for a, b in zip(at, at[1:])], pa.binary())], names=["digest", "set"])


def _by_tile(rows: DataFrame) -> DataFrame:
    return rows.repartition(partitions(rows.sparkSession), "tile").sortWithinPartitions("tile")


def links(documents: DataFrame, classes: DataFrame) -> DataFrame:
    """(digest, links, root): a class's links in each tile, and the smallest class of the tile it is connected to."""
    found = buckets(classes)
    names = found.groupBy("digest").agg(F.array_sort(F.collect_list("key")).alias("names"))  # at most RUNS * BRANCHES ** (DEPTH - 1)
    described = classes.join(names, "digest").select("digest", "n", "copies", "tokens", "names")
    members = tiles(found.join(described, "digest")).select(*[x.split()[0] for x in _CARRIED.split(", ")])
    maybe = stored(_by_tile(members).mapInArrow(_candidates, _CARRIED), "jaccard-candidates")
    wanted = classes.join(maybe.select("digest").distinct(), "digest", "left_semi").select("rid")
    texts = documents.select(_rid().alias("rid"), "text").join(wanted, "rid", "left_semi").select("text")
    sets = texts.mapInArrow(_sets, "digest binary, set binary").groupBy("digest").agg(F.first("set").alias("set"))
    return _by_tile(maybe.join(sets, "digest").select(*maybe.columns, "set")).mapInArrow(_verify, "digest binary, links long, root binary")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for edges (a, b): label is the smallest node of the component."""
    both = edges.select("a", "b").union(edges.select("b", "a")).where("a != b").distinct()
    both = stored(both, "components-edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "components")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("seen"))
        least = labels.join(near, "node").select("node", "label", F.least("label", "seen").alias("next"))
        ahead = labels.select(F.col("node").alias("next"), F.col("label").alias("jump"))
        moved = least.join(ahead, "next").select("node", F.least("next", "jump").alias("label"), (F.least("next", "jump") != F.col("label")).alias("changed"))
        moved = stored(moved, "components")
        labels = moved.select("node", "label")
        if moved.where("changed").isEmpty():
            return labels


def classify(documents: DataFrame) -> DataFrame:
    """(doc_id, rid, text_hash, label, n_links, class_id) of every document; label names its component, null without words."""
    with scratch(documents.sparkSession):
        return stored(_classified(documents), "jaccard-rows", keep=True)


def _classified(documents: DataFrame) -> DataFrame:
    described = stored(describe(documents), "jaccard-documents")
    worded = described.where("digest is not null")
    classes = stored(worded.groupBy("digest").agg(F.min("rid").alias("rid"), F.min("doc_id").alias("low"), F.first("n").alias("n"), F.first("tokens").alias("tokens"), F.count(F.lit(1)).alias("copies")), "jaccard-classes")
    found = stored(links(documents, classes), "jaccard-links")
    summed = found.groupBy("digest").agg(F.sum("links").alias("links"))
    labels = components(found.select(F.col("digest").alias("a"), F.col("root").alias("b")))
    known = classes.select("digest", "copies", "low").join(summed, "digest", "left").join(labels.withColumnRenamed("node", "digest"), "digest", "left")
    known = stored(known.select("digest", "low", F.coalesce("label", "digest").alias("label"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "jaccard-known")
    # the ids of components are joined to classes, of which a hot text has one; both tables are stored, so that the
    # adaptive skew join can split a hot component here and a hot text below
    ids = stored(known.groupBy("label").agg(F.min("low").alias("class_id")), "jaccard-ids")
    known = stored(known.drop("low").join(ids, "label"), "jaccard-named")
    row = ["doc_id", "rid", "text_hash", "label", "n_links", "class_id"]
    alone = described.where("digest is null").select("doc_id", "rid", "text_hash", F.lit(None).cast("binary").alias("label"), F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("class_id"))
    return worded.select("doc_id", "rid", "text_hash", "digest").join(known, "digest").select(*row).unionByName(alone)


def join(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, class_id (the smallest doc_id of its connected component) and n_links (the other
    documents at a similarity of 0.8 or more)."""
    return classify(documents).select("doc_id", "class_id", "n_links")


def keep_one(documents: DataFrame) -> DataFrame:
    """One document of each component, that with the smallest doc_id, with all its columns; all documents without words."""
    rows = classify(documents)
    best = F.min(F.struct(F.col("doc_id").isNull(), "rid", "text_hash")).alias("best")
    chosen = rows.where("label is not null").groupBy("label").agg(best).select("best.rid", "best.text_hash", F.lit(False).alias("each"))
    chosen = chosen.unionByName(rows.where("label is null").select("rid", "text_hash", F.lit(True).alias("each")).distinct())
    # the wide rows keep their own columns apart, so that no name can clash
    wide = documents.select(F.struct("*").alias("row"), _rid().alias("rid"), F.xxhash64("text").alias("text_hash"))
    joined = wide.join(chosen, ["rid", "text_hash"])
    own = F.when(F.col("each"), F.monotonically_increasing_id()).otherwise(F.lit(0))
    no = F.row_number().over(Window.partitionBy("rid", "text_hash", "own").orderBy("rid"))
    return joined.withColumn("own", own).withColumn("no", no).where("no = 1").select("row.*")
