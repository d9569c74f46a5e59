"""Exact removal of repeated byte strings by sharded suffix arrays.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere else.

1.  Texts are told apart by SHA-256; of copies one stands for all, and a text that occurs
    twice goes whole.
2.  Only places that can matter reach a suffix array.  Every string of ``length`` bytes
    holds a minimizer: the k-gram with the smallest hash in it.  Equal strings have equal
    minimizers at equal places, so only surroundings of k-grams that are a minimizer twice
    are kept.  Places with equal surroundings are settled at once; for the others one
    place for each different surrounding goes on.
3.  Surroundings go to shards by the hash of the minimizer.  A shard's suffix array is
    refined in the way of Larsson and Sadakane: sorted by 8 bytes, then only groups that are
    still tied are sorted by the ranks further on, with doubled depth, up to ``length``.
    Common prefixes follow Kasai: along the text a prefix shrinks by one a step, so
    only the heads of such chains are compared byte by byte.
4.  A minimizer with very many different surroundings is dealt over several shards.  Each
    sends the hashes of its distinct strings as a sorted run, and runs are merged by
    binary search.  A string is repeated if its places in the text differ, as surroundings
    in one text overlap over shards.
5.  Covered stretches are united per text and cut out.

Fingerprints have 64 bits (128 in step 4).  Defined results: null and empty texts have no
bytes; texts shorter than ``length`` keep all; overlapping repeats count; repeated rows are
copies; other columns are not read by ``removals`` and pass through ``cut_documents``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardstream.session import cut_lineage

from .common import words
from .hashing import RollingHash, in_filter, key_filter, mix

LENGTH, GRAM = 400, 100
#: Bytes of a shard, and surroundings of one minimizer in a shard.
SHARD_BYTES, SHARD_PLACES = 1_500_000, 2048
SEEN = 200_000
#: Bytes that are hashed together; hashing takes about a hundred times as much memory.
LOT_BYTES = 1_000_000
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def _bytes(text: Column) -> Column:
    return F.encode(F.coalesce(text, F.lit("")), "UTF-8")


def text_key(data: Column) -> Column:
    """The first 64 bits of the SHA-256; used together with the length."""
    return F.conv(F.substring(F.sha2(data, 256), 1, 15), 16, 10).cast("long")


def _key(data: bytes) -> int:
    return int(hashlib.sha256(data).hexdigest()[:15], 16)


# -- minimizers -------------------------------------------------------------------------------


def pieces(texts: list[bytes], length: int, lot: int = LOT_BYTES) -> Iterator[list[tuple[int, int, bytes, int, int]]]:
    """Texts of ``length`` bytes or more in lots of about ``lot`` bytes: (text number, place of the
    piece, piece, first and last start of a string in it).

    A longer text is cut into pieces that share ``2 * length`` bytes with each neighbour, so that
    every string is in one piece together with all of its minimizer's surroundings.
    """
    now: list[tuple[int, int, bytes, int, int]] = []
    size = 0
    for k, text in enumerate(texts):
        starts = len(text) - length + 1
        for first in range(0, starts, lot):
            last = min(first + lot, starts)
            low, high = max(0, first - length), min(len(text), last + 2 * length)
            if now and size + high - low > lot:
                yield now
                now, size = [], 0
            now.append((k, low, text[low:high], first - low, last - low))
            size += high - low
    if now:
        yield now


def minimizers(lot: list[tuple[int, int, bytes, int, int]], rolling: RollingHash, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text number, place, k-gram hash, hash of the surroundings) of the minimizers of a lot of pieces.

    The pieces are hashed in one buffer; strings that would cross from one into the next are left out.
    """
    window = length - gram + 1
    number, offset, texts, first, last = zip(*lot, strict=True)
    buffer = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    rolling.load(buffer)
    grams = rolling.windows(gram)
    order = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    padded = np.full(-(-len(order) // window) * window, np.uint64(2 ** 64 - 1))
    padded[:len(order)] = order
    blocks = padded.reshape(-1, window)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(grams) - window + 1
    least = np.minimum(behind[:n], ahead[window - 1:window - 1 + n])
    at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)[:n]
    place = np.arange(n) - starts[owner]
    inside = (place >= np.array(first)[owner]) & (place < np.array(last)[owner])
    at = at[inside]
    at = at[np.append(True, at[1:] != at[:-1])] if len(at) else at
    piece = np.searchsorted(ends, at, side="right")
    low = np.maximum(starts[piece], at - (length - gram))
    high = np.minimum(ends[piece], at + length)
    around = mix(rolling.spans(low, high) + (at - low).astype(np.uint64))
    return np.array(number)[piece], at - starts[piece] + np.array(offset)[piece], grams[at], around


def _places(docs: DataFrame, text_col: str, length: int, gram: int) -> DataFrame:
    """h, around, k, n, pos of every minimizer of the distinct texts; copies in other tasks and pieces repeat rows."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rolling, seen = RollingHash(), set()
        for batch in batches:
            texts, keys = [], []
            for t in batch.iloc[:, 0]:
                data = t.encode("utf-8", "surrogatepass")
                if len(data) >= length and (k := (_key(data), len(data))) not in seen:
                    if len(seen) < SEEN:
                        seen.add(k)
                    texts.append(data)
                    keys.append(k)
            for lot in pieces(texts, length):
                no, pos, h, around = minimizers(lot, rolling, length, gram)
                ks = np.array(keys, np.int64)[no]
                yield pd.DataFrame({"h": h.view(np.int64), "around": around.view(np.int64), "k": ks[:, 0], "n": ks[:, 1], "pos": pos})

    long_enough = docs.select(text_col).filter(F.octet_length(text_col) >= length)
    return long_enough.mapInPandas(run, "h long, around long, k long, n long, pos long")


# -- suffix arrays ----------------------------------------------------------------------------


def packed(buffer: np.ndarray) -> np.ndarray:
    """The 8 bytes from every place on as one number, in text order."""
    wide = np.concatenate([buffer, np.zeros(8, np.uint8)]).astype(np.uint64)
    out = np.zeros(len(buffer), np.uint64)
    for i in range(8):
        out = (out << np.uint64(8)) | wide[i:len(buffer) + i]
    return out


def repeated_suffixes(words: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places whose string of ``length`` bytes stands twice inside segments, in suffix order, and
    which of them head a group of equal strings.

    ``ends`` has the end of each place's segment.  A string that holds a part which stands
    once stands once itself; so only runs of places that are tied at the depth reached and
    long enough for a whole string go on, and the ranks that a run needs lie inside it.
    """
    n = len(words)
    depth = min(8, length)
    order = np.flatnonzero(ends - np.arange(n) >= depth)
    key = words[order] >> np.uint64(64 - 8 * depth)
    at = np.argsort(key)
    order, key = order[at], key[at]
    heads = np.append(True, key[1:] != key[:-1])[:len(order)]
    rank = np.zeros(n, np.int64)
    while len(order):
        tied = ~(heads & np.append(heads[1:], True))
        if depth == length:
            return order[tied], heads[tied]
        step = min(depth, length - depth)
        rank[order] = np.maximum.accumulate(np.where(heads, np.arange(len(order)), 0))
        live = np.zeros(n + 2, np.int8)
        live[order[tied] + 1] = 1
        edges = np.flatnonzero(np.diff(live))
        starts, stops = edges[0::2], edges[1::2]
        whole = stops - starts > length - depth
        border = np.zeros(n + 1, np.int8)
        border[starts[whole]] = 1
        border[stops[whole] - step] -= 1
        own = order[np.cumsum(border[:n], dtype=np.int8)[order] == 1]
        pair = rank[own] * np.int64(n) + rank[own + step]
        at = np.argsort(pair)
        order, pair = own[at], pair[at]
        heads = np.append(True, pair[1:] != pair[:-1])[:len(order)]
        depth += step
    return order, heads


def common_prefixes(words: np.ndarray, ends: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the suffixes at a[i] and b[i] inside their segments.

    Where the pair of the next place is the pair of this one moved by one, the prefix is one
    shorter and nothing is compared.
    """
    at = np.argsort(a)
    a, b = a[at], b[at]
    limit = np.minimum(ends[a] - a, ends[b] - b)
    head = np.append(True, (a[1:] != a[:-1] + 1) | (b[1:] != b[:-1] + 1))[:len(a)]
    first = np.flatnonzero(head)
    i, j, most = a[first], b[first], limit[first]
    done, open_ = np.zeros(len(first), np.int64), np.arange(len(first))
    while len(open_):
        differ = words[i[open_] + done[open_]] ^ words[j[open_] + done[open_]]
        equal = sum((differ >> np.uint64(64 - 8 * k) == 0).astype(np.int64) for k in range(1, 8)) + (differ == 0)
        done[open_] += equal
        open_ = open_[(equal == 8) & (done[open_] < most[open_])]
    done = np.minimum(done, most)
    out = np.empty(len(a), np.int64)
    out[at] = done[np.cumsum(head) - 1] - (a - i[np.cumsum(head) - 1])
    return out


def repeats_in_shard(segments: list[bytes], length: int = LENGTH) -> tuple[list[tuple[int, int, int]], np.ndarray]:
    """Stretches (segment, start, end) covered by strings that stand twice in the shard, and one
    place, counted over all segments, for each distinct string of the shard."""
    buffer = np.frombuffer(b"".join(segments), np.uint8)
    sizes = np.array([len(s) for s in segments], np.int64)
    stops = np.cumsum(sizes)
    segment = np.repeat(np.arange(len(segments)), sizes)
    ends = stops[segment]
    words = packed(buffer)
    order, heads = repeated_suffixes(words, ends, length)
    once = ends - np.arange(len(buffer)) >= length
    follows = np.flatnonzero(~heads)
    if not len(follows):
        return [], np.flatnonzero(once)
    once[order[follows]] = False
    a, b = order[follows], order[follows - 1]
    prefix = common_prefixes(words, ends, a, b)
    a = np.concatenate([a, b])
    reach = a + np.concatenate([prefix, prefix])
    at = np.argsort(a)
    a, far = a[at], np.maximum.accumulate(reach[at])
    # a stretch ends where the next place lies behind all that was reached
    cut = np.flatnonzero(np.append(True, (a[1:] > far[:-1]) | (segment[a[1:]] != segment[a[:-1]])))
    own = segment[a[cut]]
    base = (stops - sizes)[own]
    last = far[np.append(cut[1:], len(a)) - 1]
    return list(zip(own.tolist(), (a[cut] - base).tolist(), (last - base).tolist(), strict=True)), np.flatnonzero(once)


# -- the job ----------------------------------------------------------------------------------


def _segments(docs: DataFrame, text_col: str, asked: DataFrame, length: int, gram: int) -> DataFrame:
    """shard, salt, parts, k, n, start, data: the united surroundings of the asked places in each shard."""
    columns = ("shard", "salt", "parts", "pos")
    listed = asked.groupBy("k", "n").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("s"))
    met = listed.select("k", "n", *(F.col(f"s.{c}").alias(c) for c in columns)).join(
        _texts(docs, text_col, asked.select("k"), length), ["k", "n"])

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, n, shards, salts, parts, places, data in batch[["k", "n", *columns, "data"]].itertuples(index=False):
                now: list = [None]
                for shard, salt, part, pos in zip(shards.tolist(), salts.tolist(), parts.tolist(), places.tolist(), strict=True):
                    low, high = max(0, pos - (length - gram)), min(n, pos + length)
                    if now[0] == shard and now[1] == salt and low <= now[4]:
                        now[4] = max(now[4], high)
                    else:
                        now = [shard, salt, part, low, high]
                        rows.append((now, k, n, data))
            yield pd.DataFrame([(*r[:3], k, n, r[3], data[r[3]:r[4]]) for r, k, n, data in rows],
                               columns=["shard", "salt", "parts", "k", "n", "start", "data"])

    return met.mapInPandas(cut, "shard long, salt long, parts long, k long, n long, start long, data binary")


def _texts(docs: DataFrame, text_col: str, keys: DataFrame, length: int) -> DataFrame:
    """k, data of the texts that the keys name, one row for each task that has a copy."""
    wanted = docs.sparkSession.sparkContext.broadcast(key_filter(keys, F.col("k")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from .jaccard_join import spark_places

        table, seen = wanted.value, set()
        for batch in batches:
            data = [t.encode("utf-8", "surrogatepass") for t in batch.iloc[:, 0]]
            keys = np.array([_key(d) for d in data], np.int64)
            rows = []
            for i in np.flatnonzero(in_filter(table, spark_places(keys, 64 * len(table)))).tolist():
                k = (int(keys[i]), len(data[i]))
                if k not in seen:
                    if len(seen) < SEEN:
                        seen.add(k)
                    rows.append((k[0], len(data[i]), data[i]))
            yield pd.DataFrame(rows, columns=["k", "n", "data"])

    long_enough = docs.select(text_col).filter(F.octet_length(text_col) >= length)
    found = long_enough.mapInPandas(run, "k long, n long, data binary")
    return found.groupBy("k", "n").agg(F.first("data").alias("data"))


def _in_shards(segments: DataFrame, length: int) -> DataFrame:
    """k, n, start, end of stretches repeated in a shard; and, where a minimizer has several
    shards, the shard's distinct strings as sorted runs, one for each part (kind 1)."""
    columns = ["kind", "k", "n", "start", "end", "shard", "part", "one", "two", "ks", "ns", "at"]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        data = group["data"].tolist()
        spans, once = repeats_in_shard(data, length)
        ks, ns, starts = group["k"].to_numpy(), group["n"].to_numpy(), group["start"].to_numpy()
        rows = [(0, int(ks[s]), int(ns[s]), int(starts[s]) + a, int(starts[s]) + b, 0, 0, b"", b"", b"", b"", b"") for s, a, b in spans]
        shard, salt, parts = (int(group[c].iloc[0]) for c in ("shard", "salt", "parts"))
        if salt and len(once):
            rolling = RollingHash()
            rolling.load(np.frombuffer(b"".join(data), np.uint8))
            middle = once + length // 2
            one = rolling.spans(once, once + length)
            two = mix(rolling.spans(once, middle)) ^ rolling.spans(middle, once + length)
            stops = np.cumsum([len(d) for d in data])
            own = np.searchsorted(stops, once, side="right")
            place = once - (stops - [len(d) for d in data])[own] + starts[own]
            at = np.argsort(one)
            part = (two % np.uint64(parts))[at]
            for p in range(parts):
                pick = at[part == p]
                if len(pick):
                    rows.append((1, 0, 0, 0, 0, shard, p, one[pick].tobytes(), two[pick].tobytes(),
                                 ks[own[pick]].tobytes(), ns[own[pick]].tobytes(), place[pick].tobytes()))
        return pd.DataFrame(rows, columns=columns)

    return segments.groupBy("shard", "salt").applyInPandas(
        run, "kind int, k long, n long, start long, end long, shard long, part int, one binary, two binary, ks binary, ns binary, at binary")


def merge_runs(runs: list[tuple[np.ndarray, np.ndarray]], places: list[tuple[np.ndarray, ...]] | None = None) -> list[np.ndarray]:
    """For every run of distinct strings, given by two hashes and sorted by the first: which
    of them stand in another run too.

    The runs are united in one order; each run then looks up by binary search how many rows
    of the union its strings have.  With ``places``, the columns of each run's places, rows
    of one place are one: segments of a text that overlap send it in several runs.
    """
    one, two = np.concatenate([r[0] for r in runs]), np.concatenate([r[1] for r in runs])
    order = np.lexsort((two, one))
    one, two = one[order], two[order]
    fresh = np.append(True, (one[1:] != one[:-1]) | (two[1:] != two[:-1]))
    heads = np.flatnonzero(fresh)
    if places is None:
        twice = np.diff(np.append(heads, len(one))) > 1
    else:
        columns = [np.concatenate(c)[order] for c in zip(*places, strict=True)]
        head = heads[np.cumsum(fresh) - 1]
        twice = np.logical_or.reduceat(np.any([c != c[head] for c in columns], axis=0), heads)
    one, two = one[heads], two[heads]
    found = []
    for first, second in runs:
        at = np.searchsorted(one, first)
        # strings that share the first hash stand side by side in order of the second
        while (late := two[at] < second).any():
            at[late] += 1
        found.append(twice[at])
    return found


def _across_shards(runs: DataFrame, length: int) -> DataFrame:
    """k, n, start, end of strings that stand at two places, in two shards of one minimizer."""
    def run(group: pd.DataFrame) -> pd.DataFrame:
        one, two, ks, ns, at = ([np.frombuffer(x, kind) for x in group[c]] for c, kind in (
            ("one", np.uint64), ("two", np.uint64), ("ks", np.int64), ("ns", np.int64), ("at", np.int64)))
        many = np.concatenate(merge_runs(list(zip(one, two, strict=True)), list(zip(ks, ns, at, strict=True))))
        ks, ns, at = np.concatenate(ks)[many], np.concatenate(ns)[many], np.concatenate(at)[many]
        order = np.lexsort((at, ns, ks))
        ks, ns, at = ks[order], ns[order], at[order]
        # strings of one text that overlap or touch are one stretch
        fresh = np.append(True, (ks[1:] != ks[:-1]) | (ns[1:] != ns[:-1]) | (at[1:] > at[:-1] + length))[:len(at)]
        cut = np.flatnonzero(fresh)
        last = np.append(cut[1:], len(at))[:len(cut)] - 1
        return pd.DataFrame({"k": ks[cut], "n": ns[cut], "start": at[cut], "end": at[last] + length})

    return runs.groupBy("shard", "part").applyInPandas(run, "k long, n long, start long, end long")


def covered(docs: DataFrame, text_col: str = "text", length: int = LENGTH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES,
            shard_places: int = SHARD_PLACES) -> DataFrame:
    """k, n, start, end: stretches of distinct texts that repeated strings cover."""
    places = cut_lineage(_places(docs, text_col, length, gram)).withColumn("occ", F.xxhash64("k", "n", "pos"))
    by_gram = places.groupBy("h").agg(F.min("occ").alias("o1"), F.max("occ").alias("o2"), F.min("around").alias("a1"),
                                      F.max("around").alias("a2")).filter("o1 <> o2")
    by_gram = cut_lineage(by_gram)  # both sides of the join are then exchanges, which adaptive execution can split
    shared = cut_lineage(places.join(by_gram.select("h", (F.col("a1") != F.col("a2")).alias("several")), "h"))
    alike = shared.groupBy("h", "around", "several").agg(F.min("occ").alias("o1"), F.max("occ").alias("o2"))
    low, high = F.greatest(F.lit(0), F.col("pos") - (length - gram)), F.least(F.col("n"), F.col("pos") + length)
    settled = shared.join(alike.filter("o1 <> o2").select("h", "around"), ["h", "around"]).select(
        "k", "n", low.alias("start"), high.alias("end"))
    one_each = shared.filter("several").join(alike.filter("several").select("h", "around", "o1"), ["h", "around"]).filter(
        "occ = o1").select("h", "around", "k", "n", "pos").distinct()
    one_each = cut_lineage(one_each)
    kinds = one_each.groupBy("h").agg(F.count("*").alias("kinds"))
    shards = max(1, one_each.count() * 2 * length // shard_bytes)
    # a minimizer with too many surroundings has shards of its own, numbered below zero, and salts from 1
    parts = F.ceil(F.col("kinds") / shard_places)
    crowded = F.col("kinds") > shard_places
    asked = one_each.join(kinds, "h").select(
        "k", "n", "pos", F.when(crowded, -1 - F.pmod(F.xxhash64("h"), F.lit(2 ** 40))).otherwise(F.pmod(F.xxhash64("h"), F.lit(shards))).alias("shard"),
        F.when(crowded, 1 + F.pmod(F.xxhash64("around"), parts)).otherwise(F.lit(0)).cast("long").alias("salt"),
        F.when(crowded, parts).otherwise(F.lit(0)).cast("long").alias("parts"))
    found = cut_lineage(_in_shards(_segments(docs, text_col, asked, length, gram), length))
    inside = found.filter("kind = 0").select("k", "n", "start", "end")
    across = _across_shards(found.filter("kind = 1"), length)
    return settled.unionByName(inside).unionByName(across)


def unite(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of the union of stretches."""
    at = np.argsort(starts, kind="stable")
    starts, far = starts[at], np.maximum.accumulate(ends[at])
    cut = np.flatnonzero(np.append(True, starts[1:] > far[:-1]))
    return list(zip(starts[cut].tolist(), far[np.append(cut[1:], len(starts)) - 1].tolist(), strict=True))


def whole_words(data: bytes, start: int, end: int) -> int:
    """How many words lie inside a stretch with both ends."""
    n = len(data[start:end].split())
    n -= start > 0 and start < end and not data[start - 1:start].isspace() and not data[start:start + 1].isspace()
    return n - (n > 0 and end < len(data) and not data[end - 1:end].isspace() and not data[end:end + 1].isspace())


def removals(docs: DataFrame, text_col: str = "text", length: int = LENGTH, keep_data: bool = False, least_words: int = 0, **how) -> DataFrame:
    """k, n, n_removed, n_spans, kept_sha256 (and the kept bytes) of every distinct text that loses bytes.

    With ``least_words`` only stretches that hold so many whole words go.
    """
    size = F.size(words(F.col(text_col))) if least_words else F.lit(0)
    keyed = docs.select(text_key(_bytes(F.col(text_col))).alias("k"), F.octet_length(_bytes(F.col(text_col))).cast("long").alias("n"), size.alias("w"))
    copied = keyed.filter((F.col("n") >= length) & (F.col("w") >= least_words)).groupBy("k", "n").agg(F.count("*").alias("c")).filter("c > 1")
    gone = copied.select("k", "n", F.col("n").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(EMPTY_SHA).alias("kept_sha256"),
                         F.lit(b"").alias("kept"))
    parts = covered(docs, text_col, length, **how).join(copied.select("k", "n"), ["k", "n"], "left_anti")
    parts = cut_lineage(parts.groupBy("k", "n").agg(F.collect_set(F.struct("start", "end")).alias("s")).select(
        "k", "n", F.col("s.start").alias("starts"), F.col("s.end").alias("ends")))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, n, starts, ends, data in batch[["k", "n", "starts", "ends", "data"]].itertuples(index=False):
                runs = unite(np.asarray(starts), np.asarray(ends))
                if least_words:
                    runs = [r for r in runs if whole_words(data, *r) >= least_words]
                edges = [0, *(x for r in runs for x in r), n]
                kept = b"".join(data[a:b] for a, b in zip(edges[0::2], edges[1::2], strict=True))
                rows.append((k, n, n - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), _whole_characters(data, runs) if keep_data else b""))
            yield pd.DataFrame(rows, columns=["k", "n", "n_removed", "n_spans", "kept_sha256", "kept"])

    texts = _texts(docs, text_col, parts.select("k"), length)
    trimmed = parts.join(texts, ["k", "n"]).mapInPandas(
        cut, "k long, n long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    both = gone.unionByName(trimmed)
    return both if keep_data else both.drop("kept")


def _whole_characters(data: bytes, runs: list[tuple[int, int]]) -> bytes:
    """What is kept, with characters that a run only touches kept whole."""
    out, at = [], 0
    for a, b in runs:
        while a < b and data[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
            b -= 1
        out.append(data[at:a])
        at = b
    return b"".join([*out, data[at:]])


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """Per document: id, n_bytes, n_removed, n_spans, kept_sha256."""
    data = _bytes(F.col(text_col))
    own = docs.select(id_col, text_key(data).alias("k"), F.octet_length(data).cast("long").alias("n"), F.sha2(data, 256).alias("sha"))
    lost = cut_lineage(removals(docs, text_col, **how))
    return own.join(lost, ["k", "n"], "left").select(
        id_col, F.col("n").alias("n_bytes"), F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"))


def cut_documents(docs: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """``docs`` without the repeated bytes; a character that a run only touches stays."""
    data = _bytes(F.col(text_col))
    lost = cut_lineage(removals(docs, text_col, keep_data=True, **how)).select("k", "n", "kept")
    keyed = docs.withColumns({"k__": text_key(data), "n__": F.octet_length(data).cast("long")})
    met = keyed.join(lost.withColumnsRenamed({"k": "k__", "n": "n__", "kept": "kept__"}), ["k__", "n__"], "left")
    text = F.when(F.col("kept__").isNull(), F.col(text_col)).otherwise(F.decode("kept__", "UTF-8"))
    return met.withColumn(text_col, text).select(*docs.columns)
