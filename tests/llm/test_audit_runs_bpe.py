"""Filter audit, periodic runs and byte-pair encoding against brute force and the tokenizers library."""

from __future__ import annotations

import hashlib
import random
import zlib
from itertools import permutations

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wardstream.llm import bpe, filter_audit, periodic_runs
from wardstream.llm.queries import tokenizer_path

# -- filter audit -----------------------------------------------------------------------------


def brute_audit(docs, labels):
    """One loop over the rows for every order."""
    def split(text):
        return [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text).split(" ") if w]

    rows = []
    for doc, text, part in docs:
        text, w = text or "", split(text or "")
        failed = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text),
            "D": any(c in "#$%&*|" for c in text),
            "E": doc is not None and any(d is not None and d < doc and (t or "") == text for d, t, _ in docs)}
        mine = [x for x in labels if doc is not None and x[0] == doc]
        rows.append((part or "", {f for f in failed if failed[f]}, any(x[1] == 1 for x in mine), any(x[2] == 1 for x in mine)))
    out, shapley = {}, {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        for order in permutations("ABCDE"):
            for k, f in enumerate(order):
                before = set(order[:k])
                removed = [r for r in own if f in r[1] and not r[1] & before]
                shapley[part, f] = shapley.get((part, f), 0) + len(removed)
                out[part, "".join(order), k + 1] = [
                    sum(not r[1] & (before | {f}) for r in own), len(removed), sum(f in r[1] and bool(r[1] & before) for r in own),
                    sum(r[1] == {f} for r in own), sum(r[2] for r in removed), sum(r[3] for r in removed), f]
    return {k: (*v[:-1], shapley[k[0], v[-1]]) for k, v in out.items()}


def run_audit(spark, docs, labels):
    table = spark.createDataFrame([(*d, "x", True, 1) for d in docs], "doc_id long, text string, source string, part string, A boolean, row int")
    marked = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.audit(*filter_audit.failing_ids(filter_audit.judged(table), marked)).collect()
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in got}


def test_audit_matches_brute_force(spark):
    rng = random.Random(3)
    words = ["one", "Two", "three#", "four", "A", "ü"] + [f"w{i}" for i in range(300)]
    texts = [None, "", " \n", "a|b", " ", "x" * 200_000] + [
        " ".join(rng.choices(words[:rng.choice([3, 6, 306])], k=rng.choice([1, 150, 199, 200, 260]))) for _ in range(40)]
    docs = [(i, rng.choice(texts), rng.choice(["s", "t", "", None])) for i in range(80)]
    docs += [(5, docs[5][1], docs[5][2])] * 3 + [(5, "another", "s"), (None, None, "s"), (None, "", None), (None, "a|b", "t")]
    labels = [(i, i % 2, i % 3 % 2) for i in range(0, 80, 2)] + [(4, 1, None), (4, None, 1), (None, 1, 1), (999, 1, 1)]
    got = run_audit(spark, docs, labels)
    assert got == brute_audit(docs, labels)
    assert len(got) == 3 * 600


def test_audit_of_one_hot_text_and_of_nothing(spark):
    docs = [(i, "same text", "s") for i in range(500)]
    got = run_audit(spark, docs, [(499, 1, 0)])
    assert got["s", "EABCD", 1][:2] == (1, 499) and got["s", "EABCD", 1][4] == 1
    assert got == brute_audit(docs, [(499, 1, 0)])
    assert run_audit(spark, [], []) == {}


# -- periodic runs ----------------------------------------------------------------------------


def brute_runs(words):
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(12, 2 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def texts_of_runs(rng, n):
    out = []
    for _ in range(n):
        k = rng.choice([1, 2, 2, 3, 50])
        base = [rng.randrange(k) for _ in range(rng.randint(1, 40))]
        text = [rng.randrange(k) for _ in range(rng.randint(0, 10))] + base * rng.randint(1, 6) + [rng.randrange(k) for _ in range(rng.randint(0, 10))]
        for _ in range(rng.randint(0, 2)):
            text[rng.randrange(len(text))] = rng.randrange(k)
        out.append(text + text[:rng.randint(0, len(text))])
    fib = [[0], [0, 1]]
    while len(fib[-1]) < 250:
        fib.append(fib[-1] + fib[-2])
    return out + fib + [[]]


def runs_in(texts):
    text, start, length, period = periodic_runs.runs_of(
        np.array([w for t in texts for w in t], np.int64), np.array([len(t) for t in texts], np.int64))
    return [[(s, n, q) for k, s, n, q in zip(text.tolist(), start.tolist(), length.tolist(), period.tolist(), strict=True) if k == i]
            for i in range(len(texts))]


@pytest.mark.parametrize("seed", range(4))
def test_runs_match_brute_force(seed):
    texts = texts_of_runs(random.Random(seed), 150)
    assert runs_in(texts) == [brute_runs(t) for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 1), max_size=90))
def test_runs_of_two_words_match_brute_force(words):
    assert runs_in([words]) == [brute_runs(words)]


def test_touching_periodic_stretches_hold_longer_periods():
    # b ababa ababa b, each letter a word of its own; the period 5 * k lies across two stretches of period 2 * k
    words = [x for c in "bababaababab" for x in (c, "x", "y")]
    ids = {w: k for k, w in enumerate(dict.fromkeys(words))}
    numbers = [ids[w] for w in words]
    assert runs_in([numbers]) == [brute_runs(numbers)]
    assert any(q == 15 for _, _, q in brute_runs(numbers))


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 500), min_size=1), st.data())
def test_range_successor(values, data):
    order = data.draw(st.permutations(sorted(values)))
    tree = periodic_runs.WaveletTree(np.array(order, np.int64), 501)
    low = data.draw(st.integers(0, len(order)))
    high = data.draw(st.integers(low, len(order)))
    least = data.draw(st.integers(0, 520))
    want = min((v for v in order[low:high] if v >= least), default=-1)
    assert tree.successor(np.array([low]), np.array([high]), np.array([least])).tolist() == [want]


def brute_summary(doc, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc).encode()) if doc is not None else 1
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    best = min(((-size, s, q) for s, size, q in runs), default=None)
    listed = "".join(f"{s},{size},{q}\n" for s, size, q in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc, len(runs), *((best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4),
            hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_run_summary_matches_brute_force(spark):
    rng = random.Random(5)
    planted = [i for i in range(3000) if zlib.crc32(str(i).encode()) % 10 == 0][:40]
    docs = [(i, " ".join(f"é{rng.randrange(400)}" for _ in range(rng.randint(0, 120)))) for i in planted]
    docs += [(-1, None), (-2, ""), (-3, " \n\t"), (-4, "a " * 30), (None, "b " * 30), (-5, "  x y " * 9), (-6, "q " * 1_500)]
    docs += [(-7, " ".join(f"w{i % 300}" for i in range(1000)))] + docs[-4:-2]
    docs += [(1000 + i, " ".join(map(str, t))) for i, t in enumerate(texts_of_runs(rng, 30))]
    table = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, runs int, collapsed string")
    got = periodic_runs.summary(periodic_runs.runs(periodic_runs.planted(table), lot=5000))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((brute_summary(*d) for d in docs), key=repr)
    assert periodic_runs.summary(periodic_runs.runs(table.limit(0))).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.runs(table, shortest=8)


# -- byte-pair encoding -----------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def same_as_library(library, texts):
    own, table = bpe.loaded(tokenizer_path()), bpe.loaded(tokenizer_path(), bpe.TokenTexts)
    for text, ids, want in zip(texts, own.encode(texts), library.encode_batch([t or "" for t in texts], add_special_tokens=False), strict=True):
        ids = np.frombuffer(ids, np.int32)
        assert ids.tolist() == want.ids, ascii(text)
        assert table.decode(ids).decode() == library.decode(want.ids, skip_special_tokens=False)


@settings(max_examples=200, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(max_size=40), max_size=5))
def test_encoding_is_that_of_the_library(library, texts):
    same_as_library(library, texts)


def test_hard_texts_encode_as_in_the_library(library):
    rng = random.Random(2)
    letters = "aabbcdeéÉİΣσςßﬁ ̸́\x1c\x1d\x85 ​ 'st.,!<|>09²Ⅷ中文かกี😀👩‍🦰﻿­ \t\n"
    parts = ["the", "ing", "er", "on", "in", "th", "an", "e", "s", "t", "ed", "io", "n"]
    same_as_library(library, [
        None, "", "<|endoftext|>", "a<|endoftext|>b <|startoftext|><|endoftext|", "it's we'LL 'S", "=" * 3000, "a" * 3000, "ab" * 2000, "中" * 500,
        *("".join(rng.choices(letters, k=rng.randint(1, 25))) for _ in range(3000)),
        *("".join(rng.choices(parts, k=rng.randint(1, 12))) for _ in range(1500))])


def test_forgotten_words_are_encoded_again(library):
    own = bpe.Bpe(tokenizer_path())
    own._pieces, own._words = bpe.Memory(5), bpe.Memory(5)
    texts = [" ".join(f"w{i % 7}ord{i}" for i in range(k, k + 9)) for k in range(40)]
    for _ in range(2):
        for t in texts:
            assert np.frombuffer(own.encode([t])[0], np.int32).tolist() == library.encode(t, add_special_tokens=False).ids


def test_every_token_comes_from_its_own_merges(library):
    """Pairs that a merge joins fit at no border, and each token's parts merge into it."""
    own = bpe.loaded(tokenizer_path())
    for (a, b), token in list(own._merged.items())[::97]:
        assert not own.fits(a, b)
        assert own._text[a] + own._text[b] == own._text[token]


def test_tokens_of_a_table(spark, library):
    rng = random.Random(4)
    texts = [None, "", "Hello, WORLD!!", "x" * 50_000, "word " * 20_000] + [
        " ".join(rng.choices(["Straße", "naïve", "don't", "100%", "a#b"], k=rng.randint(1, 9))) for _ in range(30)]
    docs = spark.createDataFrame([(i % 33, t, 1, "x") for i, t in enumerate(texts)], "doc_id int, text string, ids int, decoded string")
    done = bpe.decode(bpe.encode(docs, tokenizer_path()), tokenizer_path())
    assert done.columns == ["doc_id", "ids", "decoded"]
    got = sorted((r.doc_id, r.ids, r.decoded) for r in done.collect())
    ids = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert got == sorted((i % 33, x, library.decode(x, skip_special_tokens=False)) for i, x in enumerate(ids))
    assert bpe.encode(docs.limit(0), tokenizer_path()).count() == 0
    nothing = bpe.decode(spark.createDataFrame([(1, None)], "doc_id int, ids array<int>"), tokenizer_path()).first()
    assert nothing.decoded == ""
    assert done.filter(F.col("doc_id") == 1).count() == 2
