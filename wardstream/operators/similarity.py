"""Exact nearest-entry lookups against a capacity-bounded response cache.

The cache holds at most ``capacity`` entries (5,000 by default), which bounds what is
sent to the executors; queries are scored in Arrow batches against that matrix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed, vectors
from ..session import bound_batches
from .skew import lookup_join

SLICE = 256  # vectors scored at a time, so the score matrix stays within some 10 MB
DIGITS = 9  # similarities are compared after rounding, so equal vectors tie


def normalised(df: DataFrame, embedding: str = "embedding") -> DataFrame:
    return df.withColumn("unit_embedding", vectors.unit(F.col(embedding)))


def cache_entries(candidates: DataFrame, row_id: str, added_at: str, capacity: int = fixed.CACHE_CAPACITY) -> DataFrame:
    """The first ``capacity`` candidates in insertion order with their index."""
    kept = candidates.orderBy(added_at, row_id).limit(capacity)
    return kept.withColumn("idx", F.row_number().over(W.orderBy(added_at, row_id)).cast("long") - 1)


def _unit_rows(values: list) -> np.ndarray:
    m = np.asarray([np.asarray(v, dtype=np.float64) for v in values])
    if not len(m):
        return m.reshape(0, 0)
    length = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(length == 0.0, 1.0, length)


class _Index:
    """Cache entries in insertion order, as sent to the executors."""

    def __init__(self, ids: list[int], orders: list, rows: list) -> None:
        self.ids, self.orders = np.asarray(ids, dtype=np.int64), np.asarray(orders)
        self.matrix = _unit_rows(rows)

    def best(self, values: list, before: np.ndarray | None, skip: np.ndarray | None):
        """Best entry position and similarity per vector; position -1 where none is eligible."""
        if not len(self.ids):
            return np.full(len(values), -1), np.full(len(values), np.nan)
        if len(values) > SLICE:
            cuts = range(0, len(values), SLICE)
            parts = [self.best(values[i:i + SLICE], None if before is None else before[i:i + SLICE],
                               None if skip is None else skip[i:i + SLICE]) for i in cuts]
            return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        sims = np.round(_unit_rows(values) @ self.matrix.T, DIGITS)
        if before is not None:
            sims[np.arange(len(self.ids))[None, :] >= np.searchsorted(self.orders, before)[:, None]] = -np.inf
        if skip is not None:
            sims[self.ids[None, :] == skip[:, None]] = -np.inf
        at = sims.argmax(axis=1)
        top = sims[np.arange(len(values)), at]
        return np.where(np.isfinite(top), at, -1), np.where(np.isfinite(top), top, np.nan)


def _collect_index(entries: DataFrame, row_id: str, order: str, embedding: str, capacity: int) -> _Index:
    """The first ``capacity`` entries in insertion order; a full cache skips later ones."""
    rows = entries.select(row_id, order, embedding).orderBy(order, row_id).limit(capacity).collect()
    return _Index([r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows])


def nearest(queries: DataFrame, entries: DataFrame, query_id: str, entry_id: str, entry_order: str,
            embedding: str = "embedding", entry_embedding: str | None = None,
            query_order: str | None = None, exclude_self: bool = False,
            capacity: int = fixed.CACHE_CAPACITY) -> DataFrame:
    """``(query_id, entry_id, similarity)`` of the most similar entry; ties go to the oldest.

    With ``query_order`` only entries added strictly before the query are eligible.
    """
    index = _collect_index(entries, entry_id, entry_order, entry_embedding or embedding, capacity)
    return _score(queries, index, query_id, embedding, query_order, exclude_self)


def _score(queries: DataFrame, index: _Index, query_id: str, embedding: str,
           query_order: str | None, exclude_self: bool) -> DataFrame:
    bound_batches(queries.sparkSession)
    shared = queries.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for pdf in batches:
            if pdf.empty:
                continue
            before = pdf["_order"].to_numpy() if query_order else None
            skip = pdf["query_id"].to_numpy() if exclude_self else None
            at, sim = known.best(list(pdf["_vec"]), before, skip)
            found = pd.array(known.ids[at] if len(known.ids) else np.zeros(len(at), dtype=np.int64), dtype="Int64")
            found[at < 0] = pd.NA
            yield pd.DataFrame({"query_id": pdf["query_id"], "entry_id": found,
                                "similarity": sim})

    columns = [F.col(query_id).cast("long").alias("query_id"), F.col(embedding).alias("_vec")]
    if query_order:
        columns.append(F.col(query_order).alias("_order"))
    rows = queries.filter(F.col(embedding).isNotNull()).select(*columns)
    scored = rows.mapInPandas(run, "query_id long, entry_id long, similarity double")
    return scored.withColumn("similarity", F.when(F.col("entry_id").isNotNull(), F.col("similarity")))


def hits(scored: DataFrame, responses: DataFrame, threshold: float = fixed.CACHE_THRESHOLD) -> DataFrame:
    """Scored queries at or above ``threshold`` with the stored response.

    One popular entry may answer a large share of the queries, hence the checked join.
    """
    found = scored.filter(F.col("similarity") >= threshold)
    return lookup_join(found, responses, ["entry_id"], "inner", F.col("query_id"))


def replay(requests: DataFrame, row_id: str, order: str, approved: str, embedding: str = "embedding",
           threshold: float = fixed.CACHE_THRESHOLD, capacity: int = fixed.CACHE_CAPACITY) -> DataFrame:
    """Replays the cache over a request history, exactly.

    A request hits the best entry added before it; a missed, approved request is added
    until the cache is full.  Rounds find, in parallel, the earliest approved requests
    that the entries so far do not cover; those few are settled in order, and the next
    round starts after them.  Afterwards every request is scored in one pass.
    ``order`` must be a unique, increasing long.
    """
    spark = requests.sparkSession
    bound_batches(spark)
    ids: list[int] = []
    orders: list[int] = []
    rows: list = []
    clock: int | None = None
    while len(ids) < capacity:
        room = capacity - len(ids)
        shared = spark.sparkContext.broadcast(_Index(ids, orders, rows))

        def misses(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if pdf.empty:
                    continue
                _, sim = shared.value.best(list(pdf["vec"]), None, None)
                yield pdf[~(sim >= threshold)]

        open_rows = requests.filter(F.col(approved) & F.col(embedding).isNotNull())
        if clock is not None:
            open_rows = open_rows.filter(F.col(order) > clock)
        block = (
            open_rows.select(F.col(row_id).cast("long").alias("id"), F.col(order).cast("long").alias("ord"),
                             F.col(embedding).alias("vec"))
            .mapInPandas(misses, f"id long, ord long, vec {requests.schema[embedding].dataType.simpleString()}")
            .orderBy("ord").limit(room).collect()
        )
        shared.unpersist()
        fresh: list[np.ndarray] = []
        for r in block:
            v = _unit_rows([r["vec"]])[0]
            if fresh and np.round(np.max(np.asarray(fresh) @ v), DIGITS) >= threshold:
                continue
            fresh.append(v)
            ids.append(r["id"])
            orders.append(r["ord"])
            rows.append(r["vec"])
        if len(block) < room:
            break
        clock = block[-1]["ord"]
    scored = _score(requests, _Index(ids, orders, rows), row_id, embedding, order, False)
    added = spark.createDataFrame([(i,) for i in ids], "query_id long")
    hit = F.coalesce(F.col("similarity") >= threshold, F.lit(False))
    return (
        scored.withColumn("hit", hit)
        .withColumn("entry_id", F.when(F.col("hit"), F.col("entry_id")))
        .withColumn("similarity", F.when(F.col("hit"), F.col("similarity")))
        .join(F.broadcast(added.withColumn("_added", F.lit(True))), "query_id", "left")
        .withColumn("inserted", F.coalesce("_added", F.lit(False))).drop("_added")
    )
