"""Token ids in training order: a keyed Feistel permutation gives every sequence a global slot.

A document's tokens and an end mark are cut into sequences of `LENGTH` ids; the last is filled up with the end
mark. A text of b bytes has at most ceil((b + 1) / LENGTH) sequences. The greatest sum of that bound over an input
partition, times the number of partitions, is a range in which every possible sequence has a number of its own (its
partition's part of the range, and its place there) before anything is tokenised. A balanced Feistel network over the
next even number of bits, walked until it falls below the range, permutes the numbers. Equal ranges of permuted numbers
are the shards: one shuffle sends each sequence to its shard, where records of one fixed stride are written in permuted
order. Slots count the records from 0 without gaps, in shard order and in a shard by position; so a reader finds any
slot from the shards' counts and can stop and resume anywhere. (Numbering only the sequences that exist would need
exact counts first, that is tokenising twice or keeping all ids twice.)

The first pass gives the driver two numbers, the second a row for each `PAGE` shards; the shards' first slots are files
of their own, a page of shards each. Both passes must see the same rows in each partition for a rerun to give the same
order; a partition that outgrows its part of the range fails. Shard files appear whole or not at all, and a repeated
task writes the same bytes.

A null or empty text is one sequence with the end mark only. Repeated rows get sequences of their own. An empty
table gives no sequences and no shards. Invalid UTF-8 is read with replacement characters; columns other than doc_id
and text are not read; a null doc_id is written as -1 in the records. Very long texts and runs of white space of any
length are tokenised like all others, in memory proportional to one text.
"""

from __future__ import annotations

import base64
import json
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweave.llm import text as tx
from logweave.llm.files import opened, seekable, written
from logweave.llm.session import new_folder, stored

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END = 50256
LENGTH, ROUNDS = 512, 6
#: Possible sequences of a shard; about two fifths of them are there.
PER_SHARD = 1 << 17
#: Shards of a page of the layout.
PAGE = 4096
#: Tasks that write shards, at most; each writes a run of neighbouring ones.
MAX_WRITERS = 1 << 14
KEY = 0x5EED
#: doc_id, number of the sequence in its document, number of ids that count.
HEAD = "<qII"
STRIDE = struct.calcsize(HEAD) + 2 * LENGTH

SCHEMA = "doc_id long, seq int, shard int, place long, n_tokens int, token_crc32 long"


#: White space as the pattern has it. The pattern's look-ahead keeps a state for each character of a run of it, so a
#: long run is cut out: it is one piece up to its last character, which belongs to what follows.
_LONG_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{4096,}")


class Tokenizer:
    """Byte-level BPE of a file of ranks, given as its path or its bytes."""

    def __init__(self, vocabulary: str | bytes = VOCABULARY):
        import tiktoken

        if isinstance(vocabulary, str):
            vocabulary = vocabulary_bytes(vocabulary)
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        self.encoding = tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: bytes | None) -> list[int]:
        if not text:
            return []
        whole, out, at = text.decode("utf-8", "replace"), [], 0
        for run in _LONG_SPACE.finditer(whole) if len(whole) >= 4096 else ():
            end = run.end() if run.end() == len(whole) else run.end() - 1
            out += self.encoding.encode_ordinary(whole[at : run.start()])
            out += self.encoding._encode_single_piece(whole[run.start() : end])
            at = end
        return out + self.encoding.encode_ordinary(whole[at:])

    def decode(self, ids: np.ndarray) -> str:
        return self.encoding.decode(ids.tolist())


def vocabulary_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


_tokenizers: dict[str | int, Tokenizer] = {}


def tokenizer(vocabulary: str | bytes = VOCABULARY) -> Tokenizer:
    """One for each Python worker."""
    key = vocabulary if isinstance(vocabulary, str) else zlib.crc32(vocabulary)
    if key not in _tokenizers:
        _tokenizers[key] = Tokenizer(vocabulary)
    return _tokenizers[key]


def _round(x: np.ndarray, key: int, r: int, mask: np.uint64) -> np.ndarray:
    return tx.mix64(x + np.uint64((key * 0x9E3779B97F4A7C15 + (r + 1) * 0xD1B54A32D192ED03) % 2**64)) & mask


def permute(x: np.ndarray, n: int, key: int = KEY, back: bool = False) -> np.ndarray:
    """The keyed permutation of 0 .. n-1 (or its inverse), by cycle-walking a Feistel network."""
    half = max(1, -(-max(1, (n - 1).bit_length()) // 2))
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    out, todo = np.asarray(x).astype(np.uint64), np.arange(len(x))
    with np.errstate(over="ignore"):
        while len(todo):
            left, right = out[todo] >> shift, out[todo] & mask
            for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
                if back:
                    left, right = right ^ _round(left, key, r, mask), left
                else:
                    left, right = right, left ^ _round(right, key, r, mask)
            out[todo] = left << shift | right
            todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def _bound(size: Column) -> Column:
    return F.ceil((size + 1) / LENGTH)


def number_range(documents: DataFrame) -> tuple[int, int, int]:
    """The number of input partitions up to the last one with rows, the possible sequences of the largest, and of all."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    by_part = documents.select("text").groupBy(F.spark_partition_id().alias("part")).agg(F.sum(_bound(size)).cast("long").alias("n"))
    row = by_part.agg(F.coalesce(F.max("part") + 1, F.lit(0)).alias("parts"), F.coalesce(F.max("n"), F.lit(0)).alias("most"), F.coalesce(F.sum("n"), F.lit(0)).alias("all")).first()
    return row["parts"], row["most"], row["all"]


def sequences(documents: DataFrame, parts: int, most: int, key: int = KEY, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, seq, place, n_tokens, ids) of all sequences: place is the permuted number; ids are compressed."""
    n = parts * most
    shared = documents.sparkSession.sparkContext.broadcast(vocabulary_bytes(vocabulary))  # about 1 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, tok, pack = TaskContext.get().partitionId(), tokenizer(shared.value), zstandard.ZstdCompressor(level=1)
        number, end = part * most, (part + 1) * most
        for batch in batches:
            doc_ids, texts = batch["doc_id"].cast(pa.int64()), batch["text"].cast(pa.large_string()).cast(pa.large_binary())
            for lo in range(0, batch.num_rows, 256):
                rows, seqs, sizes, packed, numbers = [], [], [], [], []
                for i in range(lo, min(lo + 256, batch.num_rows)):
                    text = texts[i].as_py()
                    ids = tok.encode(text)
                    ids.append(END)
                    for seq in range(-(-len(ids) // LENGTH)):
                        part_ids = ids[seq * LENGTH : (seq + 1) * LENGTH]
                        full = np.full(LENGTH, END, dtype=np.uint16)
                        full[: len(part_ids)] = part_ids
                        rows.append(i)
                        seqs.append(seq)
                        sizes.append(len(part_ids))
                        packed.append(pack.compress(full.tobytes()))
                        numbers.append(number + seq)
                    number += -(-(len(text or b"") + 1) // LENGTH)
                if number > end:
                    raise ValueError("an input partition grew between the passes; store the input first")
                place = permute(np.array(numbers, dtype=np.int64), n, key)
                yield pa.record_batch(
                    [doc_ids.take(pa.array(rows, pa.int64())), pa.array(seqs, pa.int32()), pa.array(place), pa.array(sizes, pa.int32()), pa.array(packed, pa.binary())],
                    names=["doc_id", "seq", "place", "n_tokens", "ids"],
                )

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, seq int, place long, n_tokens int, ids binary")


def shard_name(folder: str, shard: int) -> str:
    return f"{folder}/shard-{shard:08d}.bin"


def page_name(folder: str, page: int) -> str:
    return f"{folder}/layout-{page:08d}.json"


def _first_slots(index: DataFrame, folder: str) -> tuple[DataFrame, list[dict[str, int]]]:
    """(shard, first) of all shards, which are also written as files of `PAGE` shards, and a row for each file."""
    counts = index.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).withColumn("page", F.floor(F.col("shard") / PAGE).cast("int"))
    ahead = Window.orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    pages = counts.groupBy("page").agg(F.sum("n").alias("n")).select("page", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))  # a row a page
    inner = F.coalesce(F.sum("n").over(Window.partitionBy("page").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    firsts = stored(counts.withColumn("inner", inner).join(pages, "page").select("page", "shard", (F.col("ahead") + F.col("inner")).alias("first"), "n"), "token-shards", keep=True)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("shard")
        page = table["page"][0].as_py()
        with written(page_name(folder, page)) as f:
            f.write(json.dumps([list(x) for x in zip(table["shard"].to_pylist(), table["first"].to_pylist())]).encode())
        return pa.table({"page": pa.array([page], pa.int32()), "first": pa.array([table["first"][0].as_py()], pa.int64()), "n": pa.array([sum(table["n"].to_pylist())], pa.int64())})

    written_pages = firsts.groupBy("page").applyInArrow(run, "page int, first long, n long").orderBy("page").collect()  # a row for each PAGE shards
    return firsts.select("shard", "first"), [r.asDict() for r in written_pages]


def materialise(documents: DataFrame, folder: str | None = None, key: int = KEY, vocabulary: str = VOCABULARY) -> DataFrame:
    """Write all shards, and return one row per sequence: whose it is, its slot, and where its record stands."""
    spark = documents.sparkSession
    folder = folder or new_folder(spark, "tokens")
    parts, most, bound = number_range(documents)
    shards = max(1, -(-bound // PER_SHARD))
    width = max(1, -(-parts * most // shards))
    writers = min(shards, MAX_WRITERS)
    writer = F.floor(F.floor(F.col("place") / width) * writers / shards).cast("int")
    sent = sequences(documents, parts, most, key, vocabulary).repartitionById(writers, writer).sortWithinPartitions("place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        rows = chain.from_iterable(zip(*(b[c].to_pylist() for c in ("doc_id", "seq", "place", "n_tokens", "ids"))) for b in batches)
        row = next(rows, None)
        while row is not None:
            shard, out = row[2] // width, []
            with written(shard_name(folder, shard)) as f:
                while row is not None and row[2] // width == shard:
                    doc, seq, _, size, ids = row
                    ids = unpack.decompress(ids)
                    f.write(struct.pack(HEAD, -1 if doc is None else doc, seq, size) + ids)
                    out.append((doc, seq, shard, len(out), size, zlib.crc32(ids[: 2 * size])))
                    row = next(rows, None)
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.record_batch([pa.array(v, k) for v, k in zip(zip(*out), kinds)], names=names)

    sent.mapInArrow(run, SCHEMA).write.parquet(f"{folder}/index")
    index = spark.read.schema(SCHEMA).parquet(f"{folder}/index")
    firsts, pages = _first_slots(index, folder)
    layout = {"length": LENGTH, "stride": STRIDE, "key": key, "end": END, "sequences": sum(p["n"] for p in pages), "pages": [[p["page"], p["first"]] for p in pages]}
    with written(f"{folder}/layout.json") as f:
        f.write(json.dumps(layout).encode())
    return index.join(firsts, "shard").select("doc_id", "seq", (F.col("first") + F.col("place")).alias("slot"), "shard", (F.col("place") * STRIDE).alias("byte_offset"), "n_tokens", "token_crc32")


def _shards(folder: str, start: int, stop: int, layout: dict) -> Iterator[tuple[int, int, int]]:
    """(shard, first slot, end) of the shards that hold slots of a range; the pages before and after are not read."""
    ends = [x for _, x in layout["pages"][1:]] + [layout["sequences"]]
    for (page, first), end in zip(layout["pages"], ends):
        if start < end and first < stop:
            with opened(page_name(folder, page)) as f:
                shards = json.loads(f.read())
            for (shard, lo), hi in zip(shards, [x for _, x in shards[1:]] + [end]):
                yield shard, lo, hi


def read(folder: str, start: int = 0, stop: int | None = None) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(slot, doc_id, seq, ids) from slot `start` on, in training order; any slot can be where reading resumes."""
    with opened(f"{folder}/layout.json") as f:
        layout = json.loads(f.read())
    total, stride = layout["sequences"], layout["stride"]
    stop = total if stop is None else min(stop, total)
    for shard, first, end in _shards(folder, start, stop, layout):
        lo, hi = max(start, first), min(stop, end)
        if lo < hi:
            with seekable(shard_name(folder, shard)) as f:
                f.seek((lo - first) * stride)
                for slot in range(lo, hi):
                    record = f.read(stride)
                    doc, seq, size = struct.unpack_from(HEAD, record)
                    yield slot, doc, seq, np.frombuffer(record, dtype=np.uint16, offset=struct.calcsize(HEAD), count=size)
