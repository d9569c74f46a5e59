"""Suffix dedup and the Jaccard join against brute force, on hard small tables."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wardstream.llm import graph, hashing, jaccard_join, suffix_dedup
from wardstream.session import cut_lineage

SCHEMA = "doc_id long, text string, k string, n string"


def frame(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, "x", "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


# -- suffix dedup -----------------------------------------------------------------------------


def removed(texts, length):
    data = [(t or "").encode() for t in texts]
    count = Counter(b[p:p + length] for b in data for p in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - length + 1):
            if count[b[p:p + length]] > 1:
                gone[p:p + length] = True
        kept = bytes(x for x, g in zip(b, gone[:-1], strict=True) if not g)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


def awkward_texts(seed, size=40):
    rng = random.Random(seed)

    def prose(n):
        return "".join(rng.choice("abcdé\n ") for _ in range(n))

    passage, other = prose(90), prose(60)
    texts = [None, "", "a", "aaaa" * 40, "ab" * 100, "ba" * 90, passage, passage, passage + other, other + passage + other]
    for _ in range(size):
        base = prose(rng.randrange(0, 200))
        at = rng.randrange(len(base) + 1)
        texts.append(base[:at] + rng.choice([passage, passage[5:70], other, "", passage[20:]]) + base[at:])
    return texts


@pytest.mark.parametrize("places", [4096, 2])
def test_removals_against_brute_force(spark, places):
    texts = awkward_texts(3)
    got = suffix_dedup.dedup(frame(spark, texts), length=24, gram=8, shard_bytes=600, shard_places=places).collect()
    want = removed(texts, 24)
    assert [tuple(r)[1:] for r in sorted(got)] == want


@pytest.mark.parametrize("places", [4096, 2])
def test_a_place_that_two_shards_send_is_one(spark, places):
    """Runs of one character in unique contexts: neighbouring minimizers of a text are dealt over salts."""
    rng = random.Random(11)
    texts = ["".join(chr(rng.randrange(0x21, 0x7F)) for _ in range(50)) + "-" * 60 + "".join(chr(rng.randrange(0x21, 0x7F)) for _ in range(50))
             for _ in range(14)]
    got = suffix_dedup.dedup(frame(spark, texts), length=24, gram=8, shard_places=places).collect()
    assert [tuple(r)[1:] for r in sorted(got)] == removed(texts, 24)


def test_empty_table_and_nulls(spark):
    assert suffix_dedup.dedup(frame(spark, [])).count() == 0
    row = suffix_dedup.dedup(frame(spark, [None])).first()
    assert (row.n_bytes, row.n_removed, row.n_spans, row.kept_sha256) == (0, 0, 0, suffix_dedup.EMPTY_SHA)


def test_cut_documents_keeps_characters_whole(spark):
    shared = "é" * 30
    docs = frame(spark, ["x" + shared + "y", "ä" + shared + "z", None, ""])
    texts = {r.doc_id: r.text for r in suffix_dedup.cut_documents(docs, length=20, gram=6).collect()}
    assert texts == {0: "xy", 1: "äz", 2: None, 3: ""}
    assert suffix_dedup.cut_documents(docs, length=20, gram=6).columns == docs.columns


@pytest.mark.parametrize("seed", range(5))
def test_repeated_suffixes_and_prefixes(seed):
    rng = np.random.default_rng(seed)
    buffer = rng.integers(97, 99 + seed // 2, 500).astype(np.uint8)
    buffer[300:360] = buffer[20:80]
    buffer[400:440] = 97
    text, length = bytes(buffer), 13 + 10 * (seed % 3)
    ends = np.where(np.arange(500) < 350, 350, 500)
    words = suffix_dedup.packed(buffer)
    order, heads = suffix_dedup.repeated_suffixes(words, ends, length)
    strings = {i: text[i:i + length] for i in range(500) if i + length <= ends[i]}
    count = Counter(strings.values())
    assert sorted(order) == sorted(i for i, s in strings.items() if count[s] > 1)
    keys = [strings[i] for i in order]
    assert keys == sorted(keys)
    assert heads.tolist() == [i == 0 or keys[i] != keys[i - 1] for i in range(len(keys))]

    def common(i, j):
        n = 0
        while i + n < ends[i] and j + n < ends[j] and text[i + n] == text[j + n]:
            n += 1
        return n

    a, b = order[1:], order[:-1]
    assert suffix_dedup.common_prefixes(words, ends, a, b).tolist() == [common(i, j) for i, j in zip(a, b, strict=True)]


def test_merge_runs_marks_strings_of_two_runs():
    u = np.uint64
    runs = [(np.array([1, 5, 9], u), np.array([1, 1, 1], u)), (np.array([5, 9], u), np.array([2, 1], u)), (np.array([7], u), np.array([1], u))]
    assert [r.tolist() for r in suffix_dedup.merge_runs(runs)] == [[False, False, True], [False, True], [False]]


def test_merge_runs_tells_one_place_from_two():
    u = np.uint64
    runs = [(np.array([1, 5], u), np.array([1, 1], u)), (np.array([1, 5], u), np.array([1, 1], u))]
    places = [(np.array([7, 7]), np.array([3, 4])), (np.array([7, 7]), np.array([3, 5]))]
    assert [r.tolist() for r in suffix_dedup.merge_runs(runs, places)] == [[False, True], [False, True]]


def test_minimizers_of_equal_strings_are_equal():
    rng = random.Random(5)
    shared = bytes(rng.randrange(256) for _ in range(60))
    texts = [bytes(rng.randrange(256) for _ in range(40)) + shared, shared + bytes(rng.randrange(256) for _ in range(50))]
    (lot,) = suffix_dedup.pieces(texts, 60)
    no, pos, h, _ = suffix_dedup.minimizers(lot, hashing.RollingHash(), 60, 20)
    inside = [{int(x) for x, p in zip(h[no == i], pos[no == i], strict=True) if low <= p <= low + 40} for i, low in ((0, 40), (1, 0))]
    assert inside[0] & inside[1]


@pytest.mark.parametrize("lot", [1, 61, 100, 333])
def test_long_texts_are_hashed_in_pieces(lot):
    """Pieces give the minimizers of the whole text, with the same surroundings."""
    rng = random.Random(lot)
    texts = [bytes(rng.choices(b"ab", k=n)) for n in (60, 61, 500, 1200, 75)]

    def found(lots):
        out = set()
        for one in lots:
            no, pos, h, around = suffix_dedup.minimizers(one, hashing.RollingHash(), 60, 20)
            out |= set(zip(no.tolist(), pos.tolist(), h.tolist(), around.tolist(), strict=True))
        return out

    lots = list(suffix_dedup.pieces(texts, 60, lot))
    assert found(lots) == found(suffix_dedup.pieces(texts, 60)) and len(lots) > 2
    assert all(len(p) <= lot + 180 for one in lots for _, _, p, _, _ in one)


def test_whole_words_of_a_stretch():
    for text in (b"one two  three", b" one\ntwo ", b"word", b"", b"  "):
        spans = [(m.start(), m.end()) for m in re.finditer(rb"\S+", text)]
        for a in range(len(text) + 1):
            for b in range(a, len(text) + 1):
                assert suffix_dedup.whole_words(text, a, b) == sum(a <= s and e <= b for s, e in spans), (text, a, b)


# -- Jaccard join -----------------------------------------------------------------------------


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[k:k + 5]) for k in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def linked(texts, ids):
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i in range(len(texts)):
        least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return [(ids[i], len(sets[i]), least[find(i)]) for i in range(len(texts))]


def near_texts(seed):
    rng = random.Random(seed)
    vocabulary = [f"W{i}" for i in range(400)]
    boiler = [rng.choice(vocabulary) for _ in range(12)]
    texts = [None, "", " \n\t ", "one", "ONE", "one two three four", "one two three", "one two three four five"]
    for _ in range(6):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(6, 90))]
        for _ in range(rng.randrange(1, 9)):
            copy = list(base)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                copy += boiler
            texts.append(rng.choice([" ", "\n", " \x0b "]).join(copy))
            if rng.random() < 0.2:
                texts.append(texts[-1])
    return texts


@pytest.mark.parametrize(("seed", "frequent"), [(1, 16), (2, 2), (3, 3)])
def test_components_against_brute_force(spark, seed, frequent):
    texts = near_texts(seed)
    ids = list(range(len(texts)))
    random.Random(seed).shuffle(ids)
    got = jaccard_join.join(frame(spark, texts, ids), frequent=frequent).collect()
    assert sorted(map(tuple, got)) == sorted(linked(texts, ids))


def joined_rows(plan):
    """Rows that each join of an executed plan made."""
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return joined_rows(plan.executedPlan())
    if name.endswith("QueryStageExec"):
        return joined_rows(plan.plan())
    below = [n for i in range(plan.children().size()) for n in joined_rows(plan.children().apply(i))]
    return below + ([plan.metrics().apply("numOutputRows").value()] if "Join" in name else [])


def test_far_copies_do_not_meet_their_group(spark, monkeypatch):
    """Half of a large group is too far from all others, though a common tail gives it frequent shingles enough."""
    rng, size = random.Random(4), 160
    template, tail = [f"t{i}" for i in range(150)], [f"tail{i}" for i in range(12)]
    texts = []
    for i in range(size):
        copy = list(template)
        for at in rng.sample(range(10, 140, 10), 5 if i % 2 else rng.randrange(4)):
            copy[at] = f"own{i}x{at}"
        texts.append(" ".join(copy + tail * (i % 2)))
    rows, postings = [], []
    pairs_of = jaccard_join._all_pairs

    def counted(*given):
        pairs = pairs_of(*given)
        postings.append(given[0].count())
        pairs.collect()
        rows.extend(joined_rows(pairs._jdf.queryExecution().executedPlan()))
        return pairs

    monkeypatch.setattr(jaccard_join, "_all_pairs", counted)
    ids = list(range(size))
    got = jaccard_join.join(frame(spark, texts, ids)).collect()
    assert sorted(map(tuple, got)) == sorted(linked(texts, ids))
    assert max(rows) <= 5 * postings[0], (rows, postings)


def test_join_of_empty_table(spark):
    assert jaccard_join.join(frame(spark, [])).count() == 0


def test_word_hashes_follow_the_word_rule():
    powers = hashing.Powers(hashing.STEP)
    one, counts = hashing.word_hashes([b"a b\x0bc", b"", b"  ", b"\nb a"], powers)
    assert counts.tolist() == [3, 0, 0, 2]
    assert one[0] == one[4] and one[1] == one[3] and len(set(one.tolist())) == 3


def test_filter_places_are_sparks(spark):
    values = np.array([0, 1, -1, 2 ** 62, -(2 ** 63)], np.int64)
    want = [r[0] for r in spark.createDataFrame(pd.DataFrame({"v": values, "i": range(5)})).orderBy("i").select(
        F.pmod(F.xxhash64("v"), F.lit(2 ** 20))).collect()]
    assert jaccard_join.spark_places(values, 2 ** 20).tolist() == want


def test_connected_components(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (103, 101), (7, 7)]
    got = graph.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == {i: 0 for i in range(61)} | {100: 100, 101: 100, 103: 100}


def test_stars_are_written_once(spark, monkeypatch):
    written = []
    monkeypatch.setattr(graph, "cut_lineage", lambda df: written.append(0) or cut_lineage(df))
    stars = [(1, i) for i in range(2, 30)] + [(40, 41), (40, 41), (42, 42)]
    got = graph.components(spark.createDataFrame(stars, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == {i: 1 for i in range(1, 30)} | {40: 40, 41: 40}
    assert len(written) == 1
    chain = [(1, 2), (2, 3), (5, 3)]
    assert {tuple(r) for r in graph.components(spark.createDataFrame(chain, "a long, b long")).collect()} == {(i, 1) for i in (1, 2, 3, 5)}


def test_hubs_are_found_without_a_join(spark):
    """Classes meet their bucket's hub by one join; the hub is the least by edits, then by the random order."""
    rows = spark.createDataFrame([(t, False, c, 100, c % 3, 100, c) for t in range(20) for c in range(30)],
                                 "token long, hot boolean, cls long, n int, h int, rest int, component long")
    pairs = jaccard_join._hub_pairs(rows, 0, 5, True)
    got = pairs.collect()
    assert len(joined_rows(pairs._jdf.queryExecution().executedPlan())) == 1
    hubs = {r.a for r in got}
    assert len(hubs) == 1 and hubs.pop() % 3 == 2 and len(got) == 29


def test_shingle_sets_are_made_in_lots(monkeypatch):
    import tracemalloc

    from wardstream.llm import jaccard_join
    from wardstream.llm.hashing import STEP, Powers

    texts = [" ".join(f"w{(i * 7 + k) % 311}" for k in range(i * 13 % 900)) for i in range(600)] + [None, "", " ", "one two"]
    tracemalloc.start()
    small = jaccard_join.shingle_sets(texts, Powers(STEP))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    monkeypatch.setattr(jaccard_join, "LOT_BYTES", 10 ** 9)
    whole = jaccard_join.shingle_sets(texts, Powers(STEP))
    assert [s.tolist() for s in small] == [s.tolist() for s in whole] and len(small) == len(texts)
    assert peak < 20 * sum(len(t or "") for t in texts)
