"""Quality rules: a hashed word and character n-gram logistic regression with calibrated probabilities.

The model is fitted on a bounded sample of labelled rows (`sample_rows`, the smallest hashes of doc_id; those that
pass the base rule), four fifths of it for the weights and the rest for Platt scaling. Documents are scored in Arrow
batches against one fixed threshold; there is no shuffle of texts.

What the driver gets for the fit is bounded twice: by the number of rows, one for each doc_id (of repeated ones the text
with the smallest hash), and by `SAMPLE_SLOTS` features in all, whole rows in the order of their hashes. The features of
the sample stand in a stored table meanwhile.

Null or empty texts have no words, so they fail the base rule. Rows with a null label are not used. Without
both classes in the sample there is no model, and only the base rule rejects. Repeated rows get equal results, and a
text of any length is scored whole; extra columns of the input are not read by `rules` and are passed through by `keep`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm import text as tx
from logweave.llm.session import stored

#: Bound on the labelled rows that the model is fitted on.
SAMPLE_ROWS = 2000
#: Bound on their features (slots that a text has n-grams in; 8 bytes each).
SAMPLE_SLOTS = 6_000_000
#: A document is kept from this probability of good quality on.
THRESHOLD = 0.4
BITS = 16
CHAR_N, WORD_N = (2, 4), (1, 2)
BASE_MIN_WORDS, BASE_MAX_REPEAT_PERCENT = 10, 20
SYMBOLS = tx.byte_table(b"#*$%&|<>")

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, quality double"


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0
    threshold: float = THRESHOLD
    fitted: bool = field(default=True)

    def probability(self, z: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.ones(len(z))
        return 1 / (1 + np.exp(-np.clip(self.slope * z + self.shift, -40, 40)))


def _grams(buf: np.ndarray, offsets: np.ndarray, words: np.ndarray, word_at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each family of n-grams: slots, and for each row the range of its n-grams."""
    shift = np.uint64(64 - BITS)
    for n in WORD_N:
        g, _, at = tx.ngrams(words, word_at, n)
        yield (g * np.uint64(0x9FB21C651E98DF25 + 2 * n) >> shift).astype(np.int32), at[:-1], at[1:]
    points, at = tx.code_points(buf, offsets)
    for n in CHAR_N:
        if len(points) < n:
            none = np.zeros(len(at) - 1, dtype=np.int64)
            yield np.zeros(0, dtype=np.int32), none, none
            continue
        h = points[: len(points) - n + 1].copy()
        for k in range(1, n):
            h *= np.uint32(0x01000193)
            h += points[k : k + len(h)]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA6B + 2 * n)
        yield (h >> np.uint32(32 - BITS)).astype(np.int32), at[:-1], np.maximum(at[:-1], at[1:] - (n - 1))


#: What a family's mean count is multiplied by, so that one step size fits all weights.
_SCALE = 40.0


def base_counts(buf: np.ndarray, offsets: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """The base rule's counts for each row, the words' hashes and the rows' offsets into them."""
    starts, ends, at = tx.segments(buf, offsets, tx.SPACE)
    words = tx.segment_hashes(buf, starts, ends)
    n_words = np.diff(at)
    lead = ((buf & 0xC0) != 0x80) & ~tx.SPACE[buf]
    out = {"n_words": n_words, "word_chars": tx.range_sum(lead, offsets[:-1], offsets[1:]), "n_symbols": tx.range_sum(SYMBOLS[buf], offsets[:-1], offsets[1:])}
    line_start, line_end, line_at = tx.segments(buf, offsets, tx.NEWLINE)
    lines = tx.per_doc_keys(tx.segment_hashes(buf, line_start, line_end), tx.row_of(line_at))
    worded = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
    again = pd.Series(lines).duplicated().to_numpy() & worded
    out["n_dup_lines"] = tx.range_sum(again, line_at[:-1], line_at[1:])
    grams, first, gram_at = tx.ngrams(words, at, 5)
    twice = first[pd.Series(tx.per_doc_keys(grams, tx.row_of(gram_at))).duplicated(keep=False).to_numpy()]
    cover = np.zeros(len(words) + 1, dtype=np.int32)
    if len(twice):
        cover[twice] += 1
        cover[twice + 5] -= 1
    covered = np.cumsum(cover)[:-1] > 0
    out["n_repeat_words"] = tx.range_sum(covered, at[:-1], at[1:])
    out["base_failed"] = (n_words < BASE_MIN_WORDS) | (100 * out["n_repeat_words"] > BASE_MAX_REPEAT_PERCENT * n_words)
    return out, words, at


def logits(model: Model, buf: np.ndarray, offsets: np.ndarray, words: np.ndarray, at: np.ndarray) -> np.ndarray:
    z = np.full(len(offsets) - 1, model.bias)
    for slots, lo, hi in _grams(buf, offsets, words, at):
        z += _SCALE * tx.range_sum(model.weights[slots], lo, hi, np.float64) / np.maximum(hi - lo, 1)
    return z


def score(model: Model, column: pa.Array) -> dict[str, np.ndarray]:
    """Counts and verdicts of all texts of a column."""
    parts: dict[str, list[np.ndarray]] = {}
    for _, _, buf, offsets in tx.chunks(column):
        out, words, at = base_counts(buf, offsets)
        p = model.probability(logits(model, buf, offsets, words, at)) if model.fitted else np.ones(len(offsets) - 1)
        out["kept"], out["quality"] = ~out["base_failed"] & (p >= model.threshold), p
        for k, v in out.items():
            parts.setdefault(k, []).append(v)
    return {k: np.concatenate(v) for k, v in parts.items()}


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slots and scaled mean counts of each labelled text that passes the base rule."""
    for batch in batches:
        rows, slots_out, values_out = [], [], []
        for first, _, buf, offsets in tx.chunks(batch["text"]):
            counts, words, at = base_counts(buf, offsets)
            families = list(_grams(buf, offsets, words, at))
            for i in np.flatnonzero(~counts["base_failed"]).tolist():
                rows.append(first + i)
                slots = np.concatenate([s[lo[i] : hi[i]] for s, lo, hi in families])
                share = np.concatenate([np.full(hi[i] - lo[i], _SCALE / max(1, hi[i] - lo[i]), dtype=np.float32) for _, lo, hi in families])
                kinds, inverse = np.unique(slots, return_inverse=True)
                slots_out.append(kinds.astype(np.int32).tobytes())
                values_out.append(np.bincount(inverse, weights=share, minlength=len(kinds)).astype(np.float32).tobytes())
        passed = batch.take(pa.array(rows, pa.int64()))
        yield pa.record_batch([passed["doc_id"], passed["label"], passed["hash"], pa.array([len(x) // 4 for x in slots_out], pa.int64()), pa.array(slots_out, pa.binary()), pa.array(values_out, pa.binary())], names=["doc_id", "label", "hash", "n", "slots", "vals"])


def _descend(rows: np.ndarray, slots: np.ndarray, values: np.ndarray, y: np.ndarray, steps: int = 80, decay: float = 1e-5) -> tuple[np.ndarray, float]:
    """Logistic regression by full-batch Adam, with the classes weighted alike."""
    size = 1 << BITS
    w, m, v, bias, mb, vb = np.zeros(size), np.zeros(size), np.zeros(size), 0.0, 0.0, 0.0
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y <= 0).sum()))
    for t in range(1, steps + 1):
        z = np.bincount(rows, weights=w[slots] * values, minlength=len(y)) + bias
        error = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) * weight
        g = np.bincount(slots, weights=values * error[rows], minlength=size) + decay * w
        gb = error.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        c1, c2 = 1 - 0.9**t, 1 - 0.99**t
        w -= 0.03 * (m / c1) / (np.sqrt(v / c2) + 1e-8)
        bias -= 0.03 * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
    return w, bias


def _platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the calibrated probability, by Newton's method with Platt's smoothed targets."""
    good, bad = (y > 0).sum(), (y <= 0).sum()
    target = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    x, beta = np.stack([z, np.ones(len(z))]), np.array([1.0, 0.0])

    def loss(b: np.ndarray) -> float:
        t = np.clip(b @ x, -500, 500)
        return float((np.logaddexp(0, t) - target * t).sum())

    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(beta @ x, -500, 500)))
        step = np.linalg.solve((x * (p * (1 - p))) @ x.T + 1e-6 * np.eye(2), x @ (p - target))
        scale = 1.0
        while scale > 1e-6 and loss(beta - scale * step) > loss(beta):
            scale /= 2
        beta = beta - scale * step
        if np.abs(scale * step).max() < 1e-8:
            break
    # a falling curve would mean that the held-out rows contradict the model: then all get nearly the same
    return float(max(beta[0], 1e-3)), float(beta[1])


def fit(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, threshold: float = THRESHOLD) -> Model:
    """A model from the labelled rows; `labels` has doc_id and quality (0 or 1; the lowest counts for a doc_id)."""
    chosen = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    texts = documents.select("doc_id", "text", F.xxhash64("text").alias("hash")).where("text is not null")
    # at most sample_rows ids and labels are broadcast
    rows = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", F.col("label").cast("int").alias("label"), "hash", "text")
    features = rows.mapInArrow(_featurise, "doc_id long, label int, hash long, n long, slots binary, vals binary")
    # of repeated ids one stays, in each task first
    one = features.groupBy("doc_id").agg(F.min_by(F.struct("label", "n", "slots", "vals"), F.struct("hash", "label")).alias("x")).select("doc_id", "x.*")
    features = stored(one, "quality-sample")
    sizes = sorted(((r["h"], r["doc_id"], r["n"]) for r in features.select(F.xxhash64("doc_id").alias("h"), "doc_id", "n").collect()))  # three numbers a row
    within = [doc for (_, doc, _), upto in zip(sizes, np.cumsum([n for _, _, n in sizes])) if upto <= SAMPLE_SLOTS]
    if len(within) < len(sizes):
        features = features.where(F.col("doc_id").isin(within))
    found = features.select("doc_id", "label", "slots", "vals").toArrow()
    found = found.take(pa.array(np.argsort(found["doc_id"].to_numpy(), kind="stable") if len(found) else [], pa.int64()))
    y = found["label"].to_numpy().astype(float) if len(found) else np.zeros(0)
    if len(set(y > 0)) < 2:
        return Model(np.zeros(1 << BITS, dtype=np.float32), 0.0, threshold=threshold, fitted=False)
    slots = [np.frombuffer(x, dtype=np.int32) for x in found["slots"].to_pylist()]
    values = [np.frombuffer(x, dtype=np.float32) for x in found["vals"].to_pylist()]
    held = np.arange(len(y)) % 5 == 4
    if len(set(y[held] > 0)) < 2 or len(set(y[~held] > 0)) < 2:
        held = np.ones(len(y), dtype=bool)
        train = held
    else:
        train = ~held

    def flat(which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.flatnonzero(which)
        return np.repeat(np.arange(len(at)), [len(slots[i]) for i in at]), np.concatenate([slots[i] for i in at]), np.concatenate([values[i] for i in at]).astype(float)

    r, s, v = flat(train)
    w, bias = _descend(r, s, v, (y[train] > 0).astype(float))
    w = w.astype(np.float32)
    r, s, v = flat(held)
    z = np.bincount(r, weights=w[s] * v, minlength=int(held.sum())) + bias
    slope, shift = _platt(z, y[held])
    return Model(w, bias, slope, shift, threshold)


def rules(documents: DataFrame, model: Model) -> DataFrame:
    """One row per document: the base counts, the calibrated probability and the verdict."""
    shared = documents.sparkSession.sparkContext.broadcast(model)  # 2**BITS weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for batch in batches:
            if batch.num_rows:
                out = score(shared.value, batch["text"])
                yield pa.record_batch([batch["doc_id"].cast(pa.int64()), *(pa.array(out[k]) for k in names[1:])], names=names)

    return documents.select("doc_id", "text").mapInArrow(run, SCHEMA)


def keep(documents: DataFrame, model: Model) -> DataFrame:
    """The documents that the rules keep, with all their columns."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(score(shared.value, batch["text"])["kept"]))

    return documents.mapInArrow(run, documents.schema)
