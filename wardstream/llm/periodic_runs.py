"""Runs of consecutive words that repeat with a period, by internal pattern matching.

A run is a stretch of words with smallest period q, at least ``max(shortest, 2 q)`` words
long, that no neighbouring word extends.

1.  Names of all dyadic factors (stretches of 2**k words; equal stretches have equal names)
    come from names of their halves; the order of the names of the longest factors is the
    suffix array.
2.  A period q belongs to the level whose blocks of ``m = 2**k`` words are at most half as long:
    q from 2 m - 1 to 4 m - 2; blocks of 4 words serve all periods up to 14.  A run holds one
    of the aligned blocks and the block's copy q words on.  So a block asks for its occurrences
    in the window that starts that far on: a range successor query, the smallest place from
    there on in the block's range of the suffix array, answered by a wavelet tree over it.
3.  Occurrences not more than half a block apart are an arithmetic progression, as the block
    has their distance p as its period.  Both the block and the progression lie in maximal
    p-periodic stretches.  If these are one stretch, only p is a period there; else the
    distances of their two starts and of their two ends are candidates, and, where the
    stretches touch, the progression's members.  Single occurrences are candidates.
4.  A candidate is extended to both sides by comparing names of factors, longest first; what is
    long enough is a run, and of equal stretches the smallest period counts.

Texts are worked on in lots of a bounded number of words (a longer text is a lot of its own);
everything inside a lot is done on whole arrays.  Work is O(n log n) for n words.

Defined results: null, empty and blank texts have no words and no runs; rows may repeat; a
word is a run of bytes without ASCII white space; other columns are not read; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import words

SHORTEST = 12
#: Words that are worked on together, unless one text has more.
LOT = 150_000
#: Length and distance of the smallest blocks, and the longest period they serve.  A run of ``STRIDE - 1 + SMALL + q``
#: words holds a block and its copy; runs of 12 words or more have that many for every period q up to 14.
SMALL, STRIDE, REACH = 4, 3, 14


class Factors:
    """Names of the stretches of 2**k numbers of a sequence that is several texts in a row."""

    def __init__(self, numbers: np.ndarray, ends: np.ndarray):
        """``ends``: for each place, where its text ends."""
        n = len(numbers)
        self.n, self.ends = n, ends
        self.names = [numbers.astype(np.int64)]
        longest = int((ends - np.arange(n)).max(initial=1))
        size = 1
        # places whose stretch still stands twice; all others have names of their own
        tied = np.arange(n)
        fresh = int(self.names[0].max(initial=0)) + 1
        while 2 * size <= longest:
            now = np.arange(fresh, fresh + n, dtype=np.int64)
            fresh += n
            tied = tied[tied + 2 * size <= ends[tied]]
            if len(tied):
                last = self.names[-1]
                first, second = last[tied], last[tied + size]
                at = np.lexsort((second, first))
                first, second, own = first[at], second[at], tied[at]
                head = np.append(True, (first[1:] != first[:-1]) | (second[1:] != second[:-1]))
                now[own] = now[own[np.flatnonzero(head)]][np.cumsum(head) - 1]
                tied = own[~(head & np.append(head[1:], True))]
            self.names.append(now)
            size *= 2

    def ahead(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How far the words from a on equal those from b on; a < b of one text."""
        at, room = np.zeros(len(a), np.int64), self.ends[np.minimum(b, self.n - 1)] - b
        for k in range(len(self.names) - 1, -1, -1):
            names, size = self.names[k], 1 << k
            fit = np.flatnonzero(at + size <= room)
            fit = fit[names[a[fit] + at[fit]] == names[b[fit] + at[fit]]]
            at[fit] += size
        return at

    def behind(self, a: np.ndarray, b: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """How far the words before a equal those before b; ``starts``: where a's text starts."""
        at, room = np.zeros(len(a), np.int64), a - starts
        for k in range(len(self.names) - 1, -1, -1):
            names, size = self.names[k], 1 << k
            fit = np.flatnonzero(at + size <= room)
            fit = fit[names[a[fit] - at[fit] - size] == names[b[fit] - at[fit] - size]]
            at[fit] += size
        return at


class WaveletTree:
    """Range successor queries on a sequence of different numbers below ``bound``.

    A level has the numbers in the order of their upper bits and says which have the next bit
    set, as running counts.
    """

    def __init__(self, values: np.ndarray, bound: int):
        self.bits = max(1, int(bound - 1).bit_length())
        self.zeros, self.levels = [], []
        order = values
        for bit in range(self.bits - 1, -1, -1):
            ones = (order >> bit) & 1
            self.levels.append(np.concatenate([[0], np.cumsum(ones)]).astype(np.int32))
            self.zeros.append(len(order) - int(self.levels[-1][-1]))
            order = np.concatenate([order[ones == 0], order[ones == 1]])

    def _down(self, level: int, low: np.ndarray, high: np.ndarray, one: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ones = self.levels[level]
        a, b = ones[low], ones[high]
        return np.where(one, self.zeros[level] + a, low - a), np.where(one, self.zeros[level] + b, high - b)

    def successor(self, low: np.ndarray, high: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The smallest number of at least ``least`` among those at [low, high); -1 if there is none."""
        n = len(low)
        # the way down along the bits of ``least``; the last place where the way could turn to larger numbers
        turn = np.full(n, -1)
        turn_low, turn_high = np.zeros(n, np.int64), np.zeros(n, np.int64)
        a, b = low.astype(np.int64), high.astype(np.int64)
        inside = (least >> self.bits) == 0
        b = np.where(inside, b, a)
        for level in range(self.bits):
            bit = (least >> (self.bits - 1 - level)) & 1
            up_a, up_b = self._down(level, a, b, np.ones(n, bool))
            better = (bit == 0) & (up_b > up_a)
            turn = np.where(better, level, turn)
            turn_low, turn_high = np.where(better, up_a, turn_low), np.where(better, up_b, turn_high)
            a, b = self._down(level, a, b, bit == 1)
        found = np.where(b > a, least, -1)
        # from the turn on always the smaller half that is not empty
        late = np.flatnonzero((b <= a) & (turn >= 0))
        if len(late):
            level = turn[late]
            shift = self.bits - 1 - level
            value = ((least[late] >> (shift + 1)) << 1) | 1
            a, b = turn_low[late], turn_high[late]
            for at in range(self.bits):
                go = level < at
                zero_a, zero_b = self._down(at, a, b, np.zeros(len(late), bool))
                one = zero_b <= zero_a
                one_a, one_b = self._down(at, a, b, np.ones(len(late), bool))
                a, b = (np.where(go, np.where(one, x, y), z) for x, y, z in ((one_a, zero_a, a), (one_b, zero_b, b)))
                value = np.where(go, (value << 1) | one, value)
            found[late] = value
        return found


def _candidates(factors: Factors, starts: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) pairs; every run holds a place whose pair with the run's period is among them."""
    n, ends = factors.n, factors.ends
    level = SMALL.bit_length() - 1
    if len(factors.names) <= level:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # the suffix array of the places whose smallest block stands twice
    _, group, count = np.unique(factors.names[level], return_inverse=True, return_counts=True)
    repeated = np.flatnonzero(count[group] > 1)
    array = _suffix_order(factors, repeated, level)
    tree = WaveletTree(array, n) if len(array) else None
    places, periods = [], []
    while len(array) and SMALL <= (size := 1 << level):
        low_q, high_q, stride = (1, REACH, STRIDE) if size == SMALL else (2 * size - 1, 4 * size - 2, size)
        if 2 * low_q > longest or level >= len(factors.names):
            break
        names = factors.names[level][array]
        head = np.append(True, names[1:] != names[:-1])
        first = np.flatnonzero(head)
        bounds = np.append(first, len(array))
        group = np.cumsum(head) - 1
        # blocks are aligned to the text's start and stand twice
        block = ((array - starts[array]) % stride == 0) & (bounds[group + 1] - bounds[group] > 1) & (array + size <= ends[array])
        at = np.flatnonzero(block)
        found = _occurrences(factors, tree, starts, array[at], bounds[group[at]], bounds[group[at] + 1], size, low_q, high_q)
        places += found[0]
        periods += found[1]
        level += 1
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(places), np.concatenate(periods)


def _suffix_order(factors: Factors, places: np.ndarray, level: int) -> np.ndarray:
    """``places`` so that places with equal names lie together at every level from ``level`` on."""
    keys = [factors.names[level][places]]
    order = np.argsort(keys[0], kind="stable")
    places = places[order]
    for names in factors.names[level + 1:]:
        # only groups that are equal so far are ordered further
        before = factors.names[level][places]
        level += 1
        head = np.append(True, before[1:] != before[:-1])
        tied = np.flatnonzero(~(head & np.append(head[1:], True)))
        if not len(tied):
            break
        own = places[tied]
        places[tied] = own[np.lexsort((names[own], np.cumsum(head)[tied]))]
    return places


def _occurrences(factors: Factors, tree: WaveletTree, starts: np.ndarray, block: np.ndarray, low: np.ndarray, high: np.ndarray,
                 size: int, low_q: int, high_q: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Candidates (block, distance) of each block from its occurrences in its window."""
    places, periods = [], []

    def note(s: np.ndarray, q: np.ndarray) -> None:
        good = (q >= low_q) & (q <= high_q)
        places.append(s[good])
        periods.append(q[good])

    far = np.minimum(block + high_q, factors.ends[block] - size)
    least = block + low_q
    open_ = np.flatnonzero(least <= far)
    block, low, high, far, least = (x[open_] for x in (block, low, high, far, least))
    while len(block):
        now = tree.successor(low, high, least)
        open_ = np.flatnonzero((now >= 0) & (now <= far))
        block, low, high, far, now = (x[open_] for x in (block, low, high, far, now))
        if not len(block):
            break
        note(block, now - block)
        after = tree.successor(low, high, now + 1)
        least = now + 1
        close = np.flatnonzero((after >= 0) & (after - now <= size // 2))
        if len(close):
            s, x, p, start = block[close], now[close], (after - now)[close], starts[block[close]]
            # the maximal p-periodic stretches around the block and around the progression
            i, j = s - factors.behind(s, s + p, start), s + p + factors.ahead(s, s + p)
            i2, j2 = x - factors.behind(x, x + p, start), x + p + factors.ahead(x, x + p)
            note(s, j2 - j)
            note(s, i2 - i)
            touch = np.flatnonzero((i2 > i) & (j >= i2))
            if len(touch):
                count = np.maximum((np.minimum(far[close][touch], j2[touch] - size) - x[touch]) // p[touch], 0)
                nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + 1
                own = np.repeat(touch, count)
                note(s[own], x[own] + nth * p[own] - s[own])
            # the search goes on after the progression
            least[close] = np.maximum(x + 1, j2 - size + 1)
        open_ = np.flatnonzero(least <= far)
        block, low, high, far, least = (x[open_] for x in (block, low, high, far, least))
    return places, periods


def runs_of(numbers: np.ndarray, sizes: np.ndarray, shortest: int = SHORTEST) -> tuple[np.ndarray, ...]:
    """(text, start, length, period) of all runs of texts whose words' numbers stand in a row, by text, start and period."""
    stops = np.cumsum(sizes)
    text = np.repeat(np.arange(len(sizes)), sizes)
    starts, ends = (stops - sizes)[text], stops[text]
    factors = Factors(numbers, ends)
    place, period = _candidates(factors, starts, int(sizes.max(initial=0)))
    if not len(place):
        return (np.zeros(0, np.int64),) * 4
    pair = np.unique(np.stack([place, period]), axis=1)
    place, period = pair[0], pair[1]
    first = place - factors.behind(place, place + period, starts[place])
    length = place + period + factors.ahead(place, place + period) - first
    good = length >= np.maximum(shortest, 2 * period)
    first, length, period = first[good], length[good], period[good]
    at = np.lexsort((period, length, first))
    first, length, period = first[at], length[at], period[at]
    # of equal stretches the smallest period counts
    fresh = np.append(True, (first[1:] != first[:-1]) | (length[1:] != length[:-1]))[:len(first)]
    first, length, period = first[fresh], length[fresh], period[fresh]
    at = np.lexsort((period, first))
    first, length, period = first[at], length[at], period[at]
    return text[first], first - starts[first], length, period


def _lots(texts: list[list[bytes]], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about ``most`` words."""
    first, n = 0, 0
    for k, words_ in enumerate(texts):
        if n and n + len(words_) > most:
            yield first, k
            first, n = k, 0
        n += len(words_)
    if first < len(texts):
        yield first, len(texts)


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST, lot: int = LOT) -> DataFrame:
    """Per row: id, its runs (start, length, period) by start and period, and the text without repetitions:
    words in a run after its first period are dropped, the others joined by a space."""
    if shortest < SHORTEST:
        raise ValueError(f"runs of fewer than {SHORTEST} words may hold no block")
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [(t or "").encode("utf-8", "surrogatepass").split() for t in batch.iloc[:, 1]]
            for a, b in _lots(texts, lot):
                yield _lot(batch.iloc[a:b, 0], texts[a:b])

    def _lot(ids: pd.Series, texts: list[list[bytes]]) -> pd.DataFrame:
        known: dict[bytes, int] = {}
        numbers = np.array([known.setdefault(w, len(known)) for ws in texts for w in ws], np.int64)
        text, start, length, period = runs_of(numbers, np.array([len(ws) for ws in texts], np.int64), shortest)
        edges = np.searchsorted(text, np.arange(len(texts) + 1))
        found, collapsed = [], []
        for k, ws in enumerate(texts):
            a, b = edges[k], edges[k + 1]
            own = list(zip(start[a:b].tolist(), length[a:b].tolist(), period[a:b].tolist(), strict=True))
            found.append([{"start": s, "length": n, "period": q} for s, n, q in own])
            if own:
                gone = np.zeros(len(ws) + 1, np.int64)
                np.add.at(gone, start[a:b] + period[a:b], 1)
                np.add.at(gone, start[a:b] + length[a:b], -1)
                ws = [w for w, g in zip(ws, np.cumsum(gone).tolist(), strict=False) if not g]
            collapsed.append(b" ".join(ws).decode("utf-8", "surrogatepass"))
        return pd.DataFrame({id_col: ids.to_numpy(), "runs": found, "collapsed": collapsed})

    return docs.select(id_col, text_col).mapInPandas(
        run, f"`{id_col}` {kind}, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def summary(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per row: id, n_runs, the longest run (ties: smallest start, then period), digests of all runs and of the collapsed text."""
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("_best", best).select(
        id_col, F.size("runs").cast("long").alias("n_runs"), F.col("_best.s").alias("start"), (-F.col("_best.l")).alias("length"),
        F.col("_best.p").alias("period"), F.floor(-1000 * F.col("_best.l") / F.col("_best.p")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def planted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and text, with the end of every tenth text (by a checksum of the id) made periodic."""
    h = F.crc32(F.col(id_col).cast("string"))
    g = F.floor(h / 10)
    with_words = docs.select(id_col, text_col, g.alias("_g"), F.when(h % 10 == 0, words(F.col(text_col))).alias("_w"))
    n = F.size("_w")
    placed = with_words.withColumn("_a", F.when(n > 0, F.col("_g") % n)).withColumn(
        "_p", 1 + F.floor((n - F.col("_a")) / (3 + F.col("_g") % 8)))
    periodic = F.transform("_w", lambda w, i: F.when(i < F.col("_a"), w).otherwise(
        F.get("_w", (F.col("_a") + (i - F.col("_a")) % F.col("_p")).cast("int"))))
    return placed.select(id_col, F.when(F.col("_a").isNull(), F.col(text_col)).otherwise(F.array_join(periodic, " ")).alias(text_col))

