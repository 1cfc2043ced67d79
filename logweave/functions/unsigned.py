"""Wrapping unsigned 64-bit arithmetic as vectorised functions; results are reinterpreted as signed longs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Generator, finaliser and hash constants.
GOLDEN = 0x9E3779B97F4A7C15
MIX_1, MIX_2 = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
SCRAMBLE_1, SCRAMBLE_2 = 0xC6A4A7935BD1E995, 0xFF51AFD7ED558CCD
PROFILE_SEED = 0xC0FFEE00D15EA5E5


def finalise(x: np.ndarray) -> np.ndarray:
    for shift, factor in ((30, MIX_1), (27, MIX_2)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def draws(seed: np.ndarray, position: np.ndarray | int) -> np.ndarray:
    """The generator's output number `position` (from 1): it depends on the seed and the position only."""
    return finalise(np.asarray(seed).astype(np.uint64) + np.asarray(position).astype(np.uint64) * np.uint64(GOLDEN))


def to_unit(x: np.ndarray) -> np.ndarray:
    """The top 53 bits as a double in [0, 1)."""
    return (x >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def below_share(x: np.ndarray, p: float) -> np.ndarray:
    """Whether a draw, over 2**64 - 1, is below p."""
    return x.astype(np.float64) / float(2**64 - 1) < p


def hash_bytes(values: list[bytes]) -> np.ndarray:
    """FNV-1a of each value: one step for all values that are long enough at each position of their joined bytes."""
    out = np.full(len(values), FNV_OFFSET, dtype=np.uint64)
    length = np.fromiter(map(len, values), dtype=np.int64, count=len(values))
    data, start = np.frombuffer(b"".join(values), dtype=np.uint8), np.cumsum(length) - length
    on = np.arange(len(values))
    for i in range(int(length.max(initial=0))):
        on = on[length[on] > i]
        out[on] = (out[on] ^ data[start[on] + i]) * np.uint64(FNV_PRIME)
    return out


def signed(x: np.ndarray) -> pd.Series:
    return pd.Series(x.astype(np.uint64).view(np.int64))


@F.pandas_udf(T.LongType())
def _draw(seed: pd.Series, position: pd.Series) -> pd.Series:
    return signed(draws(seed.to_numpy().view(np.uint64), position.to_numpy()))


@F.pandas_udf(T.DoubleType())
def _unit(x: pd.Series) -> pd.Series:
    return pd.Series(to_unit(x.to_numpy().view(np.uint64)))


@F.pandas_udf(T.LongType())
def _below(x: pd.Series, n: pd.Series) -> pd.Series:
    return signed(x.to_numpy().view(np.uint64) % n.to_numpy().view(np.uint64))


@F.pandas_udf(T.LongType())
def _scramble(rank: pd.Series, n: pd.Series) -> pd.Series:
    x = rank.to_numpy().view(np.uint64) * np.uint64(SCRAMBLE_1)
    return signed(((x ^ (x >> np.uint64(33))) * np.uint64(SCRAMBLE_2)) % n.to_numpy().view(np.uint64))


@F.pandas_udf(T.LongType())
def _fnv(value: pd.Series) -> pd.Series:
    return signed(hash_bytes([bytes(v) for v in value]))


def draw(seed: Column, position: Column) -> Column:
    return _draw(seed.cast("long"), position.cast("long"))


def unit(x: Column) -> Column:
    return _unit(x)


def chance(x: Column, p: float) -> Column:
    """Whether a draw, over 2**64 - 1, is below p."""

    @F.pandas_udf(T.BooleanType())
    def run(v: pd.Series) -> pd.Series:
        return pd.Series(below_share(v.to_numpy().view(np.uint64), p))

    return run(x)


def below(x: Column, n: Column | int) -> Column:
    """A draw modulo n. With a plain number it is a function of the draw alone, which Spark runs in the draw's process."""
    if not isinstance(n, int):
        return _below(x, n.cast("long"))

    @F.pandas_udf(T.LongType())
    def run(v: pd.Series) -> pd.Series:
        return signed(v.to_numpy().view(np.uint64) % np.uint64(n))

    return run(x)


def between(x: Column, lo: int, hi: int) -> Column:
    """A draw as a whole number from lo to hi, both included."""
    return below(x, hi - lo + 1) + lo


def pick(x: Column, values: list) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (below(x, len(values)) + 1).cast("int"))


def scramble(rank: Column, n: int) -> Column:
    return _scramble(rank.cast("long"), F.lit(n).cast("long"))


def fnv1a(value: Column) -> Column:
    return _fnv(value.cast("binary"))
