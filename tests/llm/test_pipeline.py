"""The corpus pipeline, stage by stage, against plain Python on a small table."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import corpus_pipeline
from wardstream.llm.queries import tokenizer_path

SPAN, WORDS = 200, 51


def corpus():
    """(doc_id, text, lang, source, n_chars): prose, near copies, a shared passage, poor texts."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 9))) for _ in range(900)]

    def prose(n):
        return " ".join(rng.choices(vocabulary, k=n))

    shared = prose(90)
    texts = [prose(rng.randint(30, 120)) for _ in range(36)]
    texts += [f"{prose(40)}\n{shared}\n{prose(40)}" for _ in range(3)]
    # passages of just enough words and of too few, with more bytes than a string of either
    longer, shorter = prose(51), prose(49)
    texts += [f"{prose(60)} {p} {prose(60)}" for p in (longer, longer, shorter, shorter)]
    copy = texts[0].split()
    texts += [texts[1], " ".join([*copy[:-2], "other", "ending"])]
    texts += [None, "", "too short", "again and again and so on we go " * 12]
    return [(i, t, "en", ("a", "b", None)[i % 3], len(t or "")) for i, t in enumerate(texts)]


def fit(text):
    """The base rule; without labels no cutoff is certified."""
    words = (text or "").split()
    grams = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    inside = {k for i in range(len(words) - 7) if grams[tuple(words[i:i + 8])] > 1 for k in range(i, i + 8)}
    return len(words) >= 20 and 100 * len(inside) <= 30 * len(words)


def firsts(texts):
    """Ids that have the smallest id of their component of near copies."""
    sets = {i: {tuple(t.lower().split()[k:k + 5]) for k in range(len(t.split()) - 4)} for i, t in texts.items()}
    owner = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            if i < j and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                old, new = max(owner[i], owner[j]), min(owner[i], owner[j])
                owner = {k: new if o == old else o for k, o in owner.items()}
    return {i for i, o in owner.items() if i == o}


def without_repeats(texts):
    count = Counter(t[p:p + SPAN] for t in texts.values() for p in range(len(t) - SPAN + 1))
    out = {}
    for i, t in texts.items():
        gone = {q for p in range(len(t) - SPAN + 1) if count[t[p:p + SPAN]] > 1 for q in range(p, p + SPAN)}
        kept, at = [], 0
        while at < len(t):
            end = at
            while end < len(t) and (end in gone) == (at in gone):
                end += 1
            # words that lie in the stretch with both ends
            inside = [m for m in re.finditer(r"\S+", t) if at <= m.start() and m.end() <= end]
            kept.append("" if at in gone and len(inside) >= WORDS else t[at:end])
            at = end
        out[i] = "".join(kept)
    return out


def test_stages_against_brute_force(spark, tmp_path):
    from tokenizers import Tokenizer

    folder, rows = str(tmp_path), corpus()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    got = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        got[name] = docs.collect()
        assert name == "pack" or docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]

    want = {r[0]: r[1] for r in rows if fit(r[1])}
    assert {r.doc_id: r.text for r in got["quality"]} == want and len(want) == 45
    kept = firsts(want)
    want = {i: t for i, t in want.items() if i in kept}
    assert {r.doc_id: r.text for r in got["near_copies"]} == want and len(want) == 43
    shortened = without_repeats(want)
    assert {r.doc_id: r.text for r in got["passages"]} == shortened and sum(shortened[i] != want[i] for i in want) == 5
    assert all(r.n_chars == len(r.text) for r in got["passages"])

    copies = Counter(r.doc_id for r in got["mix"])
    assert max(copies.values()) <= 3 and all(r.text == shortened[r.doc_id] for r in got["mix"])
    source = {r[0]: r[3] for r in rows}
    words, taken = defaultdict(int), defaultdict(int)
    for i, t in shortened.items():
        words[source[i]] += len(t.split())
        taken[source[i]] += copies[i] * len(t.split())
    level = sum(words.values()) / 8
    for name, weight in (("a", 5), ("b", 2), (None, 1)):  # no source is above three times its words here
        assert weight * level < 3 * words[name] and abs(taken[name] - weight * level) < 60

    tokenizer = Tokenizer.from_file(tokenizer_path())
    lengths = Counter(len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1 for r in got["mix"])
    assert Counter(r.length for r in got["pack"]) == lengths and max(lengths) <= 2048
    placed = defaultdict(list)
    for r in got["pack"]:
        placed[r.sequence_id].append((r.offset, r.length))
    for pieces in placed.values():
        pieces.sort()
        assert [o for o, _ in pieces] == [sum(n for _, n in pieces[:k]) for k in range(len(pieces))]
        assert sum(n for _, n in pieces) <= 2048


def test_near_copies_go_by_row_not_by_id(spark):
    def prose(seed):
        return " ".join(random.Random(seed).choices(["alpha", "beta", "gamma", "delta", "kappa", "sigma", "omega", "theta"], k=60))

    one, two, three, four = (prose(k) for k in range(4))
    rows = [(1, one), (1, two), (1, two), (2, two + " end"), (-5, three), (3, three + " end"), (3, four), (None, four + " end"),
            (None, prose(9)), (None, prose(9) + " end"), (None, prose(9)), (None, None), (None, None), (7, None), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter(map(tuple, corpus_pipeline.near_copies(spark, docs, "").collect()))
    nameless = [t for i, t in got if i is None and t is not None]
    assert len(nameless) == 1 and nameless[0] in (prose(9), prose(9) + " end")
    del got[None, nameless[0]]
    assert got == Counter([(1, one), (1, two), (-5, three), (3, four), (None, None), (None, None), (7, None)])


def test_stages_on_clashing_columns_and_empty_tables(spark, tmp_path):
    """Columns named like the stages' own ones pass through; empty tables stay empty."""
    folder = str(tmp_path)
    rows = [(*r, 1, 2, 3, 4) for r in corpus()[:8]] + [(900, "word " * 30_000, "en", None, None, 1, 2, 3, 4)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, copies int, component int, k int, rank int"
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        some = not docs.isEmpty()
        for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, folder).write.parquet(f"{folder}/{name}-{some}")
            docs = spark.read.parquet(f"{folder}/{name}-{some}")
            assert docs.isEmpty() != some
            assert number == 4 or docs.columns == [c.split()[0] for c in schema.split(", ")]
            assert number == 4 or all((r.copies, r.component, r.k, r.rank) == (1, 2, 3, 4) for r in docs.collect())
