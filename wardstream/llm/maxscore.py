"""Exact top-k inner-product search by MaxScore over shards.

A query's terms are its dimensions.  Queries and candidates are cut into blocks; every pair
of blocks is one bounded task, in which a query's terms are ordered by their largest
possible contribution in the shard.  A first bound on the k-th best score splits them into
essential terms and the rest, which together cannot lift a vector over that bound; the
essential terms are scored for the whole shard, the others only for vectors that still can
compete.  The best of all shards are merged.

Defined results: vectors that are null or hold null or non-finite components take no part;
missing trailing components count as 0; ties go to the smaller id; rows with the query's own
id are not its candidates, repeated candidate rows count each, repeated equal queries once;
other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardstream.session import cut_lineage

CANDIDATES, QUERIES, TOP = 8192, 1024, 5
#: Terms that the first bound looks at, and terms probed between two looks at the bound.
SEEDS, STEP = 12, 8


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component; null for a vector that takes no part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~bad, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return out


def best_in_shard(query: np.ndarray, shard: np.ndarray, ids: np.ndarray, own: int, k: int,
                  low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(positions, scores) of the k best rows of a shard, and how many rows were scored in full."""
    bounds = np.maximum(query * low, query * high)
    order = np.argsort(-bounds, kind="stable")
    rest = np.append(np.cumsum(bounds[order][::-1])[::-1], 0)
    others = ids != own
    seed = order[:SEEDS]
    first = shard[:, seed] @ query[seed]
    n = min(len(ids), 8 * k + 1)
    likely = np.argpartition(-first, n - 1)[:n]
    likely = likely[others[likely]]
    known = np.sort(shard[likely] @ query)[::-1]
    least = known[k - 1] if len(known) >= k else None
    if least is None:
        alive, scores = np.flatnonzero(others), shard[others] @ query
    else:
        essential = int(np.argmax(rest < least)) if (rest < least).any() else len(order)
        partial = shard[:, order[:essential]] @ query[order[:essential]]
        alive = np.flatnonzero(others & (partial + rest[essential] >= least))
        scores = partial[alive]
        for at in range(essential, len(order), STEP):
            terms = order[at:at + STEP]
            scores = scores + shard[np.ix_(alive, terms)] @ query[terms]
            near = scores + rest[min(at + STEP, len(order))] >= least
            alive, scores = alive[near], scores[near]
    best = np.lexsort((ids[alive], -scores))[:k]
    return alive[best], scores[best].astype(np.int64), len(alive)


def search(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256,
           k: int = TOP, candidates: int = CANDIDATES, queries: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k best rows.

    The grid copies a candidate once per block of queries and a query once per shard; both
    counts follow the number of rows, and each cell holds at most about ``candidates`` and
    ``queries`` rows.
    """
    kept = vectors.select(F.col(id_col).cast("long").alias("vec_id"), quantised(F.col(vector_col), scale).alias("v"),
                          F.coalesce(is_query, F.lit(False)).alias("asks")).filter("v IS NOT NULL AND vec_id IS NOT NULL")
    kept = cut_lineage(kept.withColumn("mix", F.xxhash64("vec_id", "v")))
    size = kept.agg(F.count("*").alias("n"), F.count_if("asks").alias("q"), F.max(F.size("v")).alias("w"),
                    F.max(F.array_max(F.transform("v", F.abs))).alias("top")).first()
    shards, blocks, width = max(1, -(-size["n"] // candidates)), max(1, -(-size["q"] // queries)), size["w"] or 1
    exact = (size["top"] or 0) ** 2 * width < 2 ** 53

    def cell(df: DataFrame, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
        return (df.withColumn(own, F.pmod("mix", F.lit(n_own)).cast("int"))
                .withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1)))))

    left = cell(kept.filter("asks").dropDuplicates(["vec_id", "v"]).select("vec_id", "v", "mix"), "block", blocks, "shard", shards)
    right = cell(kept.select("vec_id", "v", "mix"), "shard", shards, "block", blocks)

    def score(asked: pd.DataFrame, stored: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked) and len(stored):
            kind = np.float64 if exact else np.int64
            ids, shard = stored["vec_id"].to_numpy(), _matrix(stored["v"], width).astype(kind)
            low, high = shard.min(axis=0), shard.max(axis=0)
            for own, mix, q in zip(asked["vec_id"], asked["mix"], _matrix(asked["v"], width).astype(kind), strict=True):
                at, scores, _ = best_in_shard(q, shard, ids, own, k, low, high)
                out.append(pd.DataFrame({"query_id": own, "mix": mix, "vec_id": ids[at], "score": scores}))
        return pd.concat(out) if out else pd.DataFrame({c: pd.Series(dtype="int64") for c in ("query_id", "mix", "vec_id", "score")})

    found = left.groupBy("block", "shard").cogroup(right.groupBy("block", "shard")).applyInPandas(
        score, "query_id long, mix long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("query_id", "mix").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
