"""Exact nearest entries and text vectors against plain numpy."""

from __future__ import annotations

import datetime
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardstream.operators import neighbours, requests, scoring
from wardstream.sources import tables


def brute_nearest(queries, entries, exclude_self):
    def unit(v):
        v = np.asarray(v, float)
        n = np.linalg.norm(v)
        return v / (n or 1.0)

    def usable(v):
        return v is not None and all(x is not None and np.isfinite(x) for x in v)

    out = set()
    for q, v in queries:
        if usable(v):
            scores = [(-round(float(unit(v) @ unit(w)), 9), e) for e, w in entries if usable(w) and not (exclude_self and e == q)]
            if scores:
                out.add((q, min(scores)[1], -min(scores)[0]))
    return out


def close(got, want):
    assert {r[:2] for r in got} == {r[:2] for r in want}
    found = {r[0]: r[2] for r in got}
    assert all(abs(found[q] - s) < 1e-8 for q, _, s in want)


def clustered(rng, n, dimensions, clusters):
    centres = rng.normal(size=(clusters, dimensions))
    return [[float(x) for x in np.float32(centres[rng.integers(clusters)] + 0.05 * rng.normal(size=dimensions))] for _ in range(n)]


@pytest.mark.parametrize("clusters, block_bytes", [(12, 4_000), (1, 2_000), (300, 16_000_000)])
def test_nearest_is_exact(spark, clusters, block_bytes):
    rng = np.random.default_rng(clusters)
    vectors = clustered(rng, 330, 16, clusters)
    vectors += [vectors[5], [-x for x in vectors[5]], [0.0] * 16, [0.0] * 16, None, [float("nan")] * 16, [float("inf"), *[0.0] * 15], [None, *[1.0] * 15]]
    rows = list(enumerate(vectors))
    table = spark.createDataFrame([(i, v, 1, 2, 3) for i, v in rows], "id long, embedding array<float>, cell int, block int, found int")
    got = {tuple(r) for r in neighbours.nearest_exact(table, table, "id", "id", exclude_self=True, pivots=24, block_bytes=block_bytes).collect()}
    close(got, brute_nearest(rows, rows, True))


def test_all_queries_near_one_cell_and_few_entries(spark):
    rng = np.random.default_rng(3)
    entries = list(enumerate(clustered(rng, 40, 8, 4)))
    hot = [(1000 + i, [float(x) for x in np.float32(np.array(entries[7][1]) + 0.01 * rng.normal(size=8))]) for i in range(400)]
    schema = "id long, embedding array<float>"
    asked, stored = spark.createDataFrame(hot, schema), spark.createDataFrame(entries, schema)
    got = {tuple(r) for r in neighbours.nearest_exact(asked, stored, "id", "id", block_bytes=1_000).collect()}
    close(got, brute_nearest(hot, entries, False))
    assert neighbours.nearest_exact(asked, stored.limit(0), "id", "id").count() == 0
    assert neighbours.nearest_exact(asked.limit(0), stored, "id", "id").count() == 0
    one = stored.filter("id = 7")
    assert neighbours.nearest_exact(one, one, "id", "id", exclude_self=True).count() == 0


def test_nearest_above_five_thousand_entries(spark):
    """The best entries lie behind the first 5,000."""
    rng = np.random.default_rng(9)
    vectors = clustered(rng, 6_500, 8, 60)
    schema = "id long, embedding array<float>"
    table = spark.createDataFrame(list(enumerate(vectors)), schema)
    asked = table.filter("id % 50 = 1")
    got = {tuple(r) for r in neighbours.nearest_exact(asked, table, "id", "id", exclude_self=True, pivots=64, block_bytes=40_000).collect()}
    want = brute_nearest([(i, v) for i, v in enumerate(vectors) if i % 50 == 1], list(enumerate(vectors)), True)
    close(got, want)
    assert any(e >= 5_000 for _, e, _ in got)


def test_text_vectors(spark):
    texts = [None, "", " \n", "one two one", "béta one", "one two one", "w " * 50_000 + "x"]
    table = spark.createDataFrame([(i, t, "old") for i, t in enumerate(texts)], "id int, prompt string, embedding string")
    got = {r.id: r for r in scoring.embed(table, "prompt").collect()}
    for i, t in enumerate(texts):
        if t is None:
            assert got[i].embedding is None
            continue
        want = np.zeros(scoring.DIMENSIONS)
        for w in set(t.split()):
            h = hashlib.md5(w.encode()).hexdigest()
            want[int(h[:4], 16) % scoring.DIMENSIONS] += 1 if int(h[4], 16) < 8 else -1
        assert got[i].embedding == want.tolist()
    assert {r.embedding_version for r in got.values()} == {"signed-md5-256"}
    assert scoring.embed(table.limit(0), "prompt").count() == 0


def test_scorer_sees_gated_texts_only(spark):
    """A model is built in the task and gets no text outside its gate."""
    import pandas as pd

    def build():
        return lambda texts: pd.DataFrame({"label": ["long" if len(t) > 3 else "short" for t in texts], "score": [float(len(t)) for t in texts]})

    table = spark.createDataFrame([(1, "abcdef"), (2, "ab"), (3, None), (4, "secret")], "id int, prompt string")
    got = {r.id: r.score for r in scoring.score_with(table, "prompt", build, "label string, score double", F.col("id") < 4).collect()}
    assert tuple(got[1]) == ("long", 6.0) and tuple(got[2]) == ("short", 2.0)
    assert all(got[i] is None or got[i].label is None for i in (3, 4))


def test_every_request_has_a_vector(spark):
    """A stored prompt answers its repetition, and a session turns suspicious, without any vector table."""
    start = datetime.datetime(2024, 1, 1)
    prompts = ["the refund of my last order"] * 2 + ["alpha beta gamma", "delta epsilon zeta", "eta theta iota", "kappa lambda my"]
    rows = [(i, "s" if i > 1 else f"t{i}", start + datetime.timedelta(hours=i), p) for i, p in enumerate(prompts)]
    none = {c: F.lit(None).cast(t) for c, t in {
        "clf_label": "string", "clf_score": "double", "judge_action": "string", "judge_reason": "string", "judge_confidence": "double",
        "contra_score": "double", "out_judge_reason": "string", "out_judge_confidence": "double"}.items()}
    history = spark.createDataFrame(rows, "id long, session_id string, ts timestamp_ntz, prompt string").withColumns({
        **none, "llm_available": F.lit(True), "canary_leak": F.lit(False), "text": F.lit("ok"), "out_judge_action": F.lit("PASS")})
    stored = spark.createDataFrame([(0, prompts[0]), (99, prompts[2])], "entry_id long, prompt string")
    limits = spark.createDataFrame([(1, "f", "<=", 50.0, "Max")], tables.SCHEMAS["business_rules"])
    got = requests.verdicts(history, stored, limits, requests.Settings(drift_limit=0.9)).orderBy("id").collect()
    assert [r.stage for r in got] == ["done", "cache", "done", "done", "session", "session"]
