"""What a Python worker holds at a time does not follow the size of the input."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardstream.functions import text as textfn
from wardstream.operators import neighbours, scoring, similarity

ROWS, BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


def _vectors(spark, n=600, dims=4):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=dims).round(1).tolist()) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, embedding array<double>")


@pytest.mark.parametrize("operator", ["decode", "embed", "score", "nearest", "replay", "exact"])
def test_operators_bound_their_batches(spark, operator):
    texts = spark.createDataFrame([(1, "a &amp; b"), (2, None)], "id long, t string")
    rows, vectors = _vectors(spark, 5)
    before = {k: spark.conf.get(k) for k in (ROWS, BYTES)}
    spark.conf.set(ROWS, "10000")
    spark.conf.set(BYTES, str(64 << 20))
    try:
        {"decode": lambda: textfn.decode_once(texts, "t", "d"), "embed": lambda: scoring.embed(texts, "t"),
         "score": lambda: scoring.score_with(texts, "t", lambda: None, "label string"),
         "nearest": lambda: similarity.nearest(vectors, vectors, "id", "id", "id"),
         "replay": lambda: similarity.replay(vectors.withColumn("ok", F.lit(True)), "id", "id", "ok"),
         "exact": lambda: neighbours.nearest_exact(vectors, vectors, "id", "id", exclude_self=True)}[operator]()
        assert int(spark.conf.get(ROWS)) <= 1000 and int(spark.conf.get(BYTES)) <= 8 << 20
    finally:
        for k, v in before.items():
            spark.conf.set(k, v.removesuffix("b"))


def test_nearest_in_small_pieces_is_still_exact(spark, monkeypatch):
    """Few cosines at a time and pieces of 16 rows; a block holds 16 entries, so a query asks for many."""
    monkeypatch.setattr(neighbours, "SCORES", 40)
    monkeypatch.setattr(neighbours, "SENT_BYTES", 1)
    rows, df = _vectors(spark)
    units = np.array([v for _, v in rows])
    units = units / np.maximum(np.linalg.norm(units, axis=1, keepdims=True), 1e-300)
    cosines = np.round(units @ units.T, similarity.DIGITS)
    np.fill_diagonal(cosines, -np.inf)
    got = neighbours.nearest_exact(df, df, "id", "id", exclude_self=True, pivots=8, block_bytes=512).collect()
    assert {r["query_id"]: r["entry_id"] for r in got} == {i: int(cosines[i].argmax()) for i in range(len(rows))}
