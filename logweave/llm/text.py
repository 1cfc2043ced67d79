"""Vectorised word splitting and hashing over the UTF-8 buffers of Arrow string columns.

Every function takes whole texts. Work arrays are bounded by the chunk size (a few MB of text), or by the
longest single text; prefix hashes are computed in blocks, so a very long text costs memory for its word
boundaries only. A null text counts as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 4 << 20
_BLOCK = 1 << 18


def byte_table(pattern: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[np.frombuffer(pattern, dtype=np.uint8)] = True
    return table


#: The separators of `[^\x20\x09-\x0D]+`.
SPACE = byte_table(b" \t\n\x0b\x0c\r")
NEWLINE = byte_table(b"\n")


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (two xor-shift-multiply rounds); returns a new array."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, dtype=np.uint64)
    out[0], done, step = 1, 1, base % 2**64
    while done < n:
        m = min(done, n - done)
        np.multiply(out[:m], np.uint64(step), out=out[done : done + m])
        done, step = done + m, step * step % 2**64
    return out


_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 2**64)
_POW, _INV = _powers(_P, _BLOCK), _powers(_PINV, _BLOCK)
_PB, _IB = pow(_P, _BLOCK, 2**64), pow(_PINV, _BLOCK, 2**64)
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
_N = np.uint64(0xBF58476D1CE4E5B9)


def chunks(column: pa.Array | pa.ChunkedArray, max_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, byte offsets of the rows) of runs of whole rows with about max_bytes of text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + max_bytes, side="right")) - 1)
        hi = min(hi, len(column))
        yield lo, hi, raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def segments(buf: np.ndarray, offsets: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the longest runs without a separator byte, and the rows' offsets into them."""
    inside = ~separator[buf]
    if not len(buf):
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(len(offsets), dtype=np.int64)
    full = offsets[1:] > offsets[:-1]
    first, last = offsets[:-1][full], offsets[1:][full] - 1
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    begin[first] = inside[first]
    end[:-1] &= ~inside[1:]
    end[last] = inside[last]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def segment_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of buf[start:end], alike wherever the bytes stand. Segments are in order and don't overlap."""
    low, high = np.zeros(len(starts), dtype=np.uint64), np.zeros(len(starts), dtype=np.uint64)
    unshift = np.ones(len(starts), dtype=np.uint64)
    carry, scale, inverse = 0, 1, 1
    sums = np.empty(_BLOCK + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for lo in range(0, len(buf), _BLOCK):
            part = buf[lo : lo + _BLOCK]
            values = _BYTE[part]
            values *= _POW[: len(part)]
            sums[0] = 0
            np.cumsum(values, out=sums[1 : len(part) + 1])
            i, j = np.searchsorted(starts, (lo, lo + len(part)))
            at = starts[i:j] - lo
            low[i:j] = sums[at] * np.uint64(scale) + np.uint64(carry)
            unshift[i:j] = _INV[at] * np.uint64(inverse)
            i, j = np.searchsorted(ends, (lo + 1, lo + len(part) + 1))
            high[i:j] = sums[ends[i:j] - lo] * np.uint64(scale) + np.uint64(carry)
            carry = (carry + int(sums[len(part)]) * scale) % 2**64
            scale, inverse = scale * _PB % 2**64, inverse * _IB % 2**64
        high -= low
        high *= unshift
        high += (ends - starts).astype(np.uint64) * _N
        return mix64(high)


def ngrams(words: np.ndarray, word_offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the rows' n-grams, the index of each one's first word, and the rows' offsets into them."""
    counts = np.maximum(np.diff(word_offsets) - (n - 1), 0)
    offsets = np.concatenate(([0], np.cumsum(counts)))
    if not offsets[-1]:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), offsets
    whole = np.ones(len(words) - n + 1, dtype=bool)
    for k in range(1, n):
        at = word_offsets[1:] - k
        at = at[(at >= word_offsets[:-1]) & (at < len(whole))]
        whole[at] = False
    with np.errstate(over="ignore"):
        out = words[: len(whole)].copy()
        for k in range(1, n):
            out *= _N
            out += words[k : k + len(whole)]
        starts = np.flatnonzero(whole)
        return mix64(out[starts] + np.uint64(n)), starts, offsets


def row_of(offsets: np.ndarray) -> np.ndarray:
    """The row of each element, from the rows' offsets."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def range_sum(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, dtype=np.int64) -> np.ndarray:
    """Sum of values[lo:hi] for each pair of bounds; 0 where a range is empty. Ranges are in order, disjoint."""
    out = np.zeros(len(lo), dtype=dtype)
    full = hi > lo
    if full.any():
        at = np.empty(2 * int(full.sum()), dtype=np.int64)
        at[::2], at[1::2] = lo[full], hi[full]
        if at[-1] == len(values):
            at = at[:-1]
        out[full] = np.add.reduceat(values, at, dtype=dtype)[::2]
    return out


def code_points(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each character (equal for equal characters), and the rows' offsets into them."""
    if not len(buf) or buf.max() < 0x80:
        return buf.astype(np.uint32), offsets
    lead = (buf & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    value = buf[at].astype(np.uint32)
    wide = np.flatnonzero(value >= 0x80)
    pad, more = np.concatenate((buf, np.zeros(4, dtype=np.uint8))), np.ones(len(wide), dtype=bool)
    for k in range(1, 4):
        following = pad[at[wide] + k]
        more &= (following & 0xC0) == 0x80
        value[wide] = np.where(more, value[wide] << np.uint32(6) | (following & 0x3F), value[wide])
    return value, np.searchsorted(at, offsets)


def per_doc_keys(values: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Keys that are equal for equal values of one row only."""
    return values ^ mix64(rows.astype(np.uint64) + np.uint64(1))
