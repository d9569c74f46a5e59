"""Vectorised hashing of texts, and a filter of fixed size for keys that later scans need."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_RANDOM = np.random.default_rng(20240229)
#: A random 64-bit value per byte and an odd multiplier with its inverse modulo 2**64.
BYTE_VALUES = _RANDOM.integers(1, 2 ** 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
STEP = 0x9E3779B97F4A7C15
UNSTEP = pow(STEP, -1, 2 ** 64)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True

#: Bits of the key filter: 4 MB however large the input; beyond some millions of keys it lets more through.
FILTER_BITS = 2 ** 25


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit values over all bits."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


class Powers:
    """Powers of an odd number modulo 2**64, extended as longer texts come."""

    def __init__(self, base: int):
        self._base, self._known = base, np.ones(1, np.uint64)

    def __call__(self, n: int) -> np.ndarray:
        if n > len(self._known):
            table = np.full(max(n, 2 * len(self._known)), self._base, np.uint64)
            table[0] = 1
            self._known = np.cumprod(table, dtype=np.uint64)
        return self._known[:n]


class RollingHash:
    """Hashes of any substring of a buffer from one running sum."""

    def __init__(self) -> None:
        self._up, self._down = Powers(STEP), Powers(UNSTEP)

    def load(self, buffer: np.ndarray) -> None:
        n = len(buffer)
        self._sum = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE_VALUES[buffer] * self._up(n), out=self._sum[1:])
        self._scale = self._down(n + 1)

    def windows(self, width: int) -> np.ndarray:
        return mix((self._sum[width:] - self._sum[:-width]) * self._scale[:len(self._sum) - width])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self._sum[end] - self._sum[start]) * self._scale[start] + (end - start).astype(np.uint64))


def word_hashes(texts: list[bytes], powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word of all texts in order, number of words of each text)."""
    buffer = np.frombuffer(b" ".join([b"", *texts, b""]), np.uint8)
    blank = IS_SPACE[buffer]
    edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    starts, ends = edges[0::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    lengths = ends - starts
    heads = np.cumsum(lengths) - lengths
    inside = np.arange(lengths.sum()) - np.repeat(heads, lengths)
    values = BYTE_VALUES[buffer[~blank]] * powers(int(lengths.max()))[inside]
    hashes = mix(np.add.reduceat(values, heads) + lengths.astype(np.uint64))
    limits = 1 + np.cumsum([len(t) + 1 for t in texts])
    return hashes, np.diff(np.searchsorted(starts, limits, side="left"), prepend=0)


def key_filter(keys: DataFrame, key: Column, bits: int = FILTER_BITS) -> np.ndarray:
    """A bit table of the keys' hashes; its size does not depend on their number."""
    place = F.pmod(F.xxhash64(key), F.lit(bits))
    rows = keys.select(place.alias("b")).groupBy(F.floor(F.col("b") / 64).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(b % 64 as int))")).alias("bits")).toPandas()
    table = np.zeros(bits // 64, np.int64)
    table[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
    return table


def in_filter(table: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Whether keys, given as ``pmod(xxhash64(key), bits)``, may be in the filter."""
    return (table[places >> 6] >> (places & 63)) & 1 == 1
