"""Exact Jaccard self-join on word shingles by vertical partitioning.

Documents with equal shingle sets form a class, and only classes are joined.  The shingles
have one global order: those that many documents hold come last, by how many do so, the
rest by hash.  Two sets within the threshold share a shingle among the first
``n - ceil(t n) + 1`` of each, so only these prefixes are posted.  The order is cut into
fragments; each fragment's postings meet in one task that keeps shingles of two classes or
more.  Candidate pairs are counted exactly: their sets are cut into fragments of the same
order, overlaps are counted for each fragment on its own and summed per pair.

A group of near copies is not expanded into its pairs.  In some rounds every class is paired
only with a hub: of each bucket and band of sizes the class with the largest share of frequent
shingles (the fewest edits of its own), or the first in a random order, so that a group meets
few hubs.  Verified links join classes to components, and buckets that lie in one component
are done.  Then pairs across components are candidates.  Links inside a component change no
result, so none that matters is lost.

Two bounds end most candidates before they are counted.  Of two prefixes the one that ends
first in the order holds all common shingles up to there, so the number of shared prefix
shingles bounds the overlap.  A prefix with a frequent shingle holds all other shingles of its
set, so a pair that shares none of these overlaps in frequent ones only, of which each set has
a known number.  The first shingle that such a pair shares leaves both sets only those from
there on in the order, so two postings of a frequent shingle meet only where both have enough
of them left: a copy with many edits of its own meets nobody in the buckets of its group, and
the group's linked copies are never laid against each other.
Pairs that do share another one come from those buckets, which are small.

Defined results: null, empty and blank texts have an empty set and link with nothing; fewer
words than a shingle make one shingle of the whole sequence; rows that repeat an id are all
listed; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardstream.session import cut_lineage

from .graph import components
from .hashing import Powers, STEP, in_filter, key_filter, mix, word_hashes

WIDTH, PERCENT = 5, 75
#: A shingle in this many documents is frequent; at most so many of them have a place of their own in the order (8 MB).
FREQUENT, LISTED = 16, 2 ** 20
#: Shingles that a task gathers before it sends them, and documents for each fragment.
GATHERED, DOCS_A_FRAGMENT = 2_000_000, 4000
#: Fragments that a set is cut into when overlaps are counted: one for so many shingles.
COUNT_FRAGMENTS = 16
SEEN = 1_000_000
#: Bytes of text that are hashed at a time: the arrays beside them take some 40 times as much.
LOT_BYTES = 250_000
#: Rounds with hubs.
ROUNDS = 3
#: Pairs of one class that meet in one place when overlaps are counted.
PAIRS_A_PLACE = 500


def shingle_sets(texts: list[str], powers: Powers, width: int = WIDTH) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; texts are hashed in lots of about ``LOT_BYTES``."""
    sets: list[np.ndarray] = []
    lot, size = [], 0
    for t in texts:
        data = (t or "").encode("utf-8", "surrogatepass").lower()
        if lot and size + len(data) > LOT_BYTES:
            sets += _lot_sets(lot, powers, width)
            lot, size = [], 0
        lot.append(data)
        size += len(data)
    return sets + _lot_sets(lot, powers, width) if lot else sets


def _lot_sets(texts: list[bytes], powers: Powers, width: int) -> list[np.ndarray]:
    hashes, n_words = word_hashes(texts, powers)
    rolled = hashes.copy()
    for k in range(1, width):
        m = max(0, len(rolled) - k)
        rolled[:m] = mix(rolled[:m] * np.uint64(STEP) + hashes[k:])
    sets, at = [], 0
    for n in n_words.tolist():
        if n >= width:
            s = np.sort(rolled[at:at + n - width + 1])
            sets.append(s[np.append(True, s[1:] != s[:-1])])
        elif n:
            whole = np.uint64(n)
            for h in hashes[at:at + n]:
                whole = mix(np.array([whole], np.uint64) * np.uint64(STEP) + h)[0]
            sets.append(np.array([whole], np.uint64))
        else:
            sets.append(np.zeros(0, np.uint64))
        at += n
    return sets


def class_ids(sets: list[np.ndarray]) -> np.ndarray:
    """A hash of each set; equal sets have equal ones."""
    sizes = np.array([len(s) for s in sets], np.int64)
    out = np.zeros(len(sets), np.uint64)
    if sizes.sum():
        filled = np.flatnonzero(sizes)
        starts = np.cumsum(sizes[filled]) - sizes[filled]
        out[filled] = mix(np.add.reduceat(mix(np.concatenate(sets)), starts) ^ sizes[filled].astype(np.uint64))
    return out.view(np.int64)


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - ceil(percent * n / 100) + 1


def _classes(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        powers = Powers(STEP)
        for batch in batches:
            sets = shingle_sets(batch.iloc[:, 1].tolist(), powers, width)
            yield pd.DataFrame({"doc_id": batch.iloc[:, 0], "n": [len(s) for s in sets], "cls": class_ids(sets)})

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), text_col).mapInPandas(run, f"doc_id {kind}, n long, cls long")


def _by_top_bits(values: np.ndarray, bits: int) -> np.ndarray:
    """Borders of the fragments in sorted 64-bit values; a fragment is a range of their top bits."""
    return np.searchsorted(values >> np.uint64(64 - bits), np.arange(2 ** bits + 1, dtype=np.uint64))


def _frequent(docs: DataFrame, text_col: str, width: int, bits: int, frequent: int, listed: int) -> tuple[np.ndarray, np.ndarray]:
    """Top halves of frequent shingle hashes in order, and the power of two of their document counts.

    Counts cover all documents.  A task sends the top 32 bits of its shingles, sorted and cut
    into fragments, at two bytes each.  Only the order of the join depends on them.
    """
    spread = 16 - bits

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        powers, held, n = Powers(STEP), [], 0

        def out() -> pd.DataFrame:
            tops = np.sort((np.concatenate(held) >> np.uint64(32)).astype(np.uint32))
            borders = np.searchsorted(tops >> np.uint32(32 - bits), np.arange(2 ** bits + 1, dtype=np.uint32))
            rows = []
            for f in range(2 ** bits):
                part = tops[borders[f]:borders[f + 1]]
                if len(part):
                    high = np.bincount((part >> np.uint32(16)) & np.uint32(2 ** spread - 1), minlength=2 ** spread)
                    rows.append((f, high.astype(np.uint32).tobytes(), (part & np.uint32(0xFFFF)).astype(np.uint16).tobytes()))
            return pd.DataFrame(rows, columns=["f", "high", "low"])

        for batch in batches:
            sets = shingle_sets(batch.iloc[:, 0].tolist(), powers, width)
            held += [s for s in sets if len(s)]
            n += sum(map(len, sets))
            if n > GATHERED:
                yield out()
                held, n = [], 0
        if held:
            yield out()

    def count(group: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for f, high, low in group.itertuples(index=False):
            tops = np.repeat(np.arange(2 ** spread, dtype=np.uint32), np.frombuffer(high, np.uint32))
            parts.append((np.uint32(f) << np.uint32(32 - bits)) | (tops << np.uint32(16)) | np.frombuffer(low, np.uint16))
        values, counts = np.unique(np.concatenate(parts), return_counts=True)
        many = counts >= frequent
        return pd.DataFrame({"top": values[many].astype(np.int64), "level": np.log2(counts[many]).astype(np.int32)})

    found = cut_lineage(docs.select(text_col).mapInPandas(send, "f int, high binary, low binary").groupBy("f").applyInPandas(
        count, "top long, level int"))
    left, least = listed, 0
    for r in sorted(found.groupBy("level").count().collect(), key=lambda r: -r["level"]):
        left -= r["count"]
        if left < 0:
            least = r["level"] + 1
            break
    kept = found.filter(F.col("level") >= least).toPandas().sort_values("top")
    return kept["top"].to_numpy(np.uint64), kept["level"].to_numpy(np.uint64)


def _shared(docs: DataFrame, text_col: str, width: int, percent: int, bits: int, tops: np.ndarray, levels: np.ndarray) -> DataFrame:
    """token, hot, cls, n, h, rest for prefix shingles that two classes or more hold.

    ``hot`` tells a frequent shingle, h is how many of them the whole set has, and rest how
    many of the set's shingles the order has from this one on.
    """
    order = docs.sparkSession.sparkContext.broadcast((tops, levels))

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        powers, (top, level) = Powers(STEP), order.value
        held: list[tuple[np.ndarray, int, int, int]] = []
        n, seen = 0, set()

        def out() -> pd.DataFrame:
            tokens = np.concatenate([p for p, *_ in held])
            sizes = [len(p) for p, *_ in held]
            at = np.argsort(tokens)
            tokens = tokens[at]
            cls, count, hot = (np.repeat(np.array([x[k] for x in held], kind), sizes)[at] for k, kind in ((1, np.int64), (2, np.int32), (3, np.int32)))
            rest = np.concatenate([np.arange(whole, whole - len(p), -1, np.int32) for p, _, whole, _ in held])[at]
            borders = _by_top_bits(tokens, bits)
            rows = [(f, tokens[a:b].tobytes(), cls[a:b].tobytes(), count[a:b].tobytes(), hot[a:b].tobytes(), rest[a:b].tobytes())
                    for f, (a, b) in enumerate(zip(borders[:-1], borders[1:], strict=True)) if b > a]
            return pd.DataFrame(rows, columns=["f", "tokens", "cls", "n", "h", "rest"])

        for batch in batches:
            sets = shingle_sets(batch.iloc[:, 0].tolist(), powers, width)
            for s, c in zip(sets, class_ids(sets).tolist(), strict=True):
                if len(s) and c not in seen:
                    if len(seen) < SEEN:
                        seen.add(c)
                    often, at = _listed(top, s)
                    keys = s[np.lexsort((s, np.where(often, level[at], 0)))] if often.any() else s
                    held.append((keys[:prefix_length(len(s), percent)], c, len(s), int(often.sum())))
                    n += len(held[-1][0])
            if n > GATHERED:
                yield out()
                held, n = [], 0
        if held:
            yield out()

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        tokens, cls, n, h, rest = (np.concatenate([np.frombuffer(x, kind) for x in group[c]]) for c, kind in (
            ("tokens", np.uint64), ("cls", np.int64), ("n", np.int32), ("h", np.int32), ("rest", np.int32)))
        at = np.lexsort((cls, tokens))
        tokens, cls = tokens[at], cls[at]
        fresh = np.append(True, (tokens[1:] != tokens[:-1]) | (cls[1:] != cls[:-1]))
        tokens, cls, n, h, rest = tokens[fresh], cls[fresh], n[at][fresh], h[at][fresh], rest[at][fresh]
        heads = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1]))
        sizes = np.diff(np.append(heads, len(tokens)))
        several = np.repeat(sizes > 1, sizes)
        tokens = tokens[several]
        return pd.DataFrame({"token": tokens.view(np.int64), "hot": _listed(order.value[0], tokens)[0],
                             "cls": cls[several], "n": n[several], "h": h[several], "rest": rest[several]})

    packed = docs.select(text_col).mapInPandas(send, "f int, tokens binary, cls binary, n binary, h binary, rest binary")
    return cut_lineage(packed.groupBy("f").applyInPandas(meet, "token long, hot boolean, cls long, n int, h int, rest int"))


def _listed(top: np.ndarray, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which shingles are listed as frequent, and where in the list."""
    if not len(top):
        return np.zeros(len(shingles), bool), np.zeros(len(shingles), np.int64)
    at = np.minimum(np.searchsorted(top, shingles >> np.uint64(32)), len(top) - 1)
    return top[at] == shingles >> np.uint64(32), at


class _Verifier:
    """Counts overlaps of pairs; sets that were made for earlier pairs are used again."""

    def __init__(self, docs: DataFrame, text_col: str, width: int, percent: int):
        self._docs, self._text, self._width, self._percent = docs, text_col, width, percent
        self._made: DataFrame | None = None

    def _tokens(self, pairs: DataFrame) -> DataFrame:
        needed = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct()
        if self._made is not None:
            needed = needed.join(self._made.select("cls"), "cls", "left_anti")
        needed = cut_lineage(needed)
        if self._made is None or not needed.isEmpty():
            wanted = self._docs.sparkSession.sparkContext.broadcast(key_filter(needed, F.col("cls")))
            fresh = _sets(self._docs, self._text, self._width, wanted).join(needed, "cls").dropDuplicates(["cls", "f"])
            fresh = cut_lineage(fresh)
            self._made = fresh if self._made is None else self._made.unionByName(fresh)
        return self._made

    def links(self, pairs: DataFrame) -> DataFrame:
        """a, b of the pairs (a, a_n, b, b_n) within the threshold: overlaps of each fragment, summed.

        The set of each b goes to its a's fragments; an a with many pairs is dealt to several places.
        """
        pairs = cut_lineage(pairs)
        tokens = self._tokens(pairs)
        places = cut_lineage(pairs.groupBy("a").agg(F.ceil(F.count("*") / PAIRS_A_PLACE).cast("int").alias("places")))
        dealt = pairs.join(places, "a").withColumn("place", F.pmod(F.xxhash64("b"), "places").cast("int")).drop("places")
        right = dealt.join(tokens.select(F.col("cls").alias("b"), "f", F.col("tokens").alias("y")), "b")
        left = tokens.withColumnRenamed("cls", "a").join(places, "a").select(
            "a", "f", F.col("tokens").alias("x"), F.explode(F.sequence(F.lit(0), F.col("places") - 1)).alias("place"))
        met = right.join(left, ["a", "f", "place"])
        counted = met.select("a", "a_n", "b", "b_n", F.size(F.array_intersect("x", "y")).alias("part"))
        whole = counted.groupBy("a", "a_n", "b", "b_n").agg(F.sum("part").alias("both"))
        near = 100 * F.col("both") >= self._percent * (F.col("a_n") + F.col("b_n") - F.col("both"))
        return cut_lineage(whole.filter(near).select("a", "b"))


def _sets(docs: DataFrame, text_col: str, width: int, wanted) -> DataFrame:
    """cls, f, tokens: the sets of the wanted classes cut into fragments of the order of hashes; some repeat."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        powers, table, seen = Powers(STEP), wanted.value, set()
        for batch in batches:
            sets, rows = shingle_sets(batch.iloc[:, 0].tolist(), powers, width), []
            ids = class_ids(sets)
            near = in_filter(table, spark_places(ids, 64 * len(table)))
            for s, c, use in zip(sets, ids.tolist(), near.tolist(), strict=True):
                if use and len(s) and c not in seen:
                    if len(seen) < SEEN:
                        seen.add(c)
                    borders = _by_top_bits(s, COUNT_FRAGMENTS.bit_length() - 1)
                    rows += [(c, f, s[a:b].view(np.int64)) for f, (a, b) in enumerate(zip(borders[:-1], borders[1:], strict=True)) if b > a]
            yield pd.DataFrame(rows, columns=["cls", "f", "tokens"])

    return docs.select(text_col).mapInPandas(run, "cls long, f int, tokens array<long>")


def spark_places(values: np.ndarray, bits: int) -> np.ndarray:
    """``pmod(xxhash64(value), bits)`` of 64-bit integers, as Spark computes it (seed 42)."""
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (
        0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))

    def turn(x: np.ndarray, by: int) -> np.ndarray:
        return (x << np.uint64(by)) | (x >> np.uint64(64 - by))

    with np.errstate(over="ignore"):
        h = np.full(len(values), np.uint64(42) + p5 + np.uint64(8), np.uint64)
        h ^= turn(values.view(np.uint64) * p2, 31) * p1
        h = turn(h, 27) * p1 + p4
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
        h ^= h >> np.uint64(32)
    return np.mod(h.view(np.int64), bits)


def _needed(a_n: str, b_n: str, percent: int) -> Column:
    """The overlap from which two sets are within the threshold."""
    return F.ceil(percent * (F.col(a_n) + F.col(b_n)) / (100 + percent))


def _enough(shared: str, a_n: str, b_n: str, percent: int) -> Column:
    """Whether so many shared prefix shingles leave room for the threshold.

    Beyond the prefix that ends first at most ceil(t n) - 1 shingles of its set are left.
    """
    left = F.ceil(percent * F.greatest(a_n, b_n) / 100) - 1
    return F.col(shared) >= F.greatest(F.lit(1), _needed(a_n, b_n, percent) - left)


def _open_rows(shared: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """The postings of shingles whose classes lie in two components or more, with the component; without ``known`` each class is one."""
    owned = shared.withColumn("component", F.col("cls")) if known is None else shared.join(
        known.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    mixed = owned.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("token")
    return cut_lineage(owned.join(mixed, "token"))


def _near(percent: int) -> Column:
    return 100 * F.least("a_n", "b_n") >= percent * F.greatest("a_n", "b_n")


def _side(rows: DataFrame, side: str, *more: str | Column) -> DataFrame:
    return rows.select("token", *more, F.col("cls").alias(side), *(F.col(c).alias(f"{side}_{c[0]}") for c in ("n", "h", "component")))


def _hub_pairs(rows: DataFrame, seed: int, percent: int, plain: bool) -> DataFrame:
    """Every class with the hub of another component that it shares most prefix shingles with.

    A bucket has one hub in each band of sizes, whose bounds differ by the threshold and lie
    half a band higher for every other seed: the set with the largest share of frequent
    shingles, or without ``plain`` any set; ties by a random order.
    """
    band = F.floor(F.log(F.col("n")) / F.log(F.lit(max(1.01, 100 / percent))) + 0.5 * (seed % 2)).cast("int")
    edits = F.lit(1000) - F.floor(1000 * F.col("h") / F.col("n")) if plain else F.lit(0)
    order = F.shiftleft(edits.cast("long"), 48).bitwiseOR(F.shiftrightunsigned(F.xxhash64("cls", F.lit(seed)), 16))
    ranked = rows.withColumn("band", band).withColumn("r", order)
    first = ranked.groupBy("token", "band").agg(F.min(F.struct("r", "cls", "n", "h", "component")).alias("m"))
    hubs = _side(first.select("token", "band", "m.*"), "a", "band")
    met = _side(ranked, "b", "band", "hot").join(hubs, ["token", "band"]).filter((F.col("a_c") != F.col("b_c")) & _near(percent))
    shares = _counted(met, percent, others=F.count_if(~F.col("hot"))).filter(_enough("c", "a_n", "b_n", percent))
    best = shares.groupBy("b", "b_n").agg(F.max(F.struct("c", "a", "a_n")).alias("m"))
    return best.select("m.a", "m.a_n", "b", "b_n")


def _counted(met: DataFrame, percent: int, others: Column) -> DataFrame:
    """Pairs with their shared prefix shingles, c, without those that cannot reach the threshold.

    A set with ceil(t n) frequent shingles or more has all its others in the prefix.  Of two
    such sets (``whole``) the shared others and the frequent ones bound the overlap.
    """
    pairs = met.groupBy("a", "a_n", "a_h", "b", "b_n", "b_h").agg(F.count("*").alias("c"), others.alias("others"))
    whole = (F.col("a_h") >= F.ceil(percent * F.col("a_n") / 100)) & (F.col("b_h") >= F.ceil(percent * F.col("b_n") / 100))
    room = F.least("a_h", "b_h") + F.col("others") >= _needed("a_n", "b_n", percent)
    return pairs.withColumn("whole", whole).filter(~F.col("whole") | room)


def _frequent_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs across components that can reach the threshold from a frequent shingle on, if it is the first they share.

    The rest of a set from there on must hold the overlap, which bounds the size of the other
    set (``most``).  A bucket's largest component only answers: the classes of others ask for
    the sizes that they can still reach, and only postings of such a size meet them.
    """
    of = rows.filter("hot").withColumn("most", F.floor(F.col("rest") * (100 + percent) / percent) - F.col("n"))
    parts = of.groupBy("token", "component").agg(F.count("*").alias("k"), F.min("n").alias("least"))
    buckets = parts.groupBy("token").agg(F.max(F.struct("k", "component")).alias("main"), F.min("least").alias("least"))
    asking = of.join(buckets, "token").filter((F.col("component") != F.col("main.component")) & (F.col("most") >= F.col("least")))
    sizes = of.select("token", F.col("n").alias("b_n")).distinct()
    asked = _side(asking, "a", "most").join(sizes, "token").filter((F.col("b_n") <= F.col("most")) & _near(percent))
    answers = _side(of, "b", F.col("most").alias("b_most"))
    met = asked.join(answers, ["token", "b_n"]).filter((F.col("a_c") != F.col("b_c")) & (F.col("a_n") <= F.col("b_most")))
    low = F.col("a") < F.col("b")
    return met.select(F.least("a", "b").alias("a"), F.when(low, F.col("a_n")).otherwise(F.col("b_n")).alias("a_n"),
                      F.greatest("a", "b").alias("b"), F.when(low, F.col("b_n")).otherwise(F.col("a_n")).alias("b_n"))


def _all_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """All pairs across components that can still reach the threshold.

    Pairs that share a shingle that is not frequent are counted by these; for the rest
    frequent ones must do.
    """
    of = rows.filter("NOT hot")
    across = _side(of, "a").join(_side(of, "b"), "token").filter((F.col("a_c") != F.col("b_c")) & (F.col("a") < F.col("b")) & _near(percent))
    others = _counted(across, percent, others=F.count("*")).filter(F.col("whole") | _enough("c", "a_n", "b_n", percent))
    columns = ["a", "a_n", "b", "b_n"]
    return others.select(columns).unionByName(_frequent_pairs(rows, percent).select(columns)).distinct()


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT,
         frequent: int = FREQUENT, listed: int = LISTED) -> DataFrame:
    """Per document: id, n_shingles, component_id (the smallest id reachable by links)."""
    classes = cut_lineage(_classes(docs, id_col, text_col, width))
    bits = min(16, max(4, (classes.count() // DOCS_A_FRAGMENT).bit_length()))
    tops, levels = _frequent(docs, text_col, width, bits, frequent, listed)
    shared = _shared(docs, text_col, width, percent, bits, tops, levels)

    verifier = _Verifier(docs, text_col, width, percent)
    links = docs.sparkSession.createDataFrame([], "a long, b long")
    known = docs.sparkSession.createDataFrame([], "node long, component long")
    rows = _open_rows(shared)
    for turn in range(ROUNDS):
        found = verifier.links(_hub_pairs(rows, turn, percent, turn < ROUNDS - 1))
        if found.isEmpty():
            break
        links = links.unionByName(found)
        known = components(links)
        rows = _open_rows(shared, known)
    found = verifier.links(_all_pairs(rows, percent))
    if not found.isEmpty():
        known = components(links.unionByName(found))
    met = classes.join(known.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    met = cut_lineage(met)
    least = met.filter("n > 0").groupBy("component").agg(F.min("doc_id").alias("least"))
    return met.join(least, "component", "left").select(
        F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))
