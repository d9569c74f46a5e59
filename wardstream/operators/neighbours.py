"""Exact nearest entries over tables of any size, by pivots and angle bounds.

Some entries are pivots.  Every entry belongs to the cell of its nearest pivot, and a cell's
radius is the largest angle between its entries and the pivot.  A cell cannot hold an entry
nearer to a query than the angle to its pivot less its radius (the triangle inequality of
angles), so cells whose bound lies below a similarity that a query has already found are
skipped.  Cells are packed into blocks of bounded size, and large ones are cut; queries travel
to blocks, not to cells, and skip cells inside a block by the same bound.

A query first searches one block of its own cell, then the blocks that may hold better
entries; the partial winners are merged.  How much is skipped depends on how the vectors are
clustered.  Where nothing can be skipped, a query meets every block once, that is one row for
each ``block_bytes`` of entries.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import bound_batches, cut_lineage
from .similarity import DIGITS, _unit_rows
from .skew import lookup_join

#: Pivots that the driver takes and sends to the executors, at most; bytes of vectors in a block.
PIVOTS, BLOCK_BYTES = 256, 16_000_000
#: Queries scored at a time, cosines held at a time, and what angles are widened by against rounding.
SLICE, SCORES, SLACK = 512, 1_000_000, 1e-6
#: Bytes of vectors that a task hands over at a time.
SENT_BYTES = 2_000_000


def _usable(vector: str) -> Column:
    """Whether a vector is there and all its parts are finite numbers."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vector).isNotNull() & ~odd


def _angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1.0, 1.0))


def _in_cells(entries: DataFrame, pivots: np.ndarray) -> DataFrame:
    """entry_id, vec (of unit length), cell, angle of every entry."""
    shared = entries.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                vectors = _unit_rows(list(batch["vec"]))
                angles = _angles(vectors, shared.value)
                cell = angles.argmin(axis=1)
                yield pd.DataFrame({"entry_id": batch["entry_id"], "vec": list(vectors), "cell": cell.astype(np.int32),
                                    "angle": angles[np.arange(len(cell)), cell]})

    return entries.mapInPandas(run, "entry_id long, vec array<double>, cell int, angle double")


def _layout(sizes: dict[int, int], rows: int) -> dict[int, tuple[int, int]]:
    """(first block, number of blocks) of every cell: small cells share a block, large ones are cut."""
    out, block, filled = {}, 0, 0
    for cell in sorted(sizes):
        n = sizes[cell]
        if filled and filled + n > rows:
            block, filled = block + 1, 0
        parts = max(1, -(-n // rows))
        out[cell] = (block, parts)
        block, filled = (block, filled + n) if parts == 1 else (block + parts, 0)
    return out


def _asked(queries: DataFrame, pivots: np.ndarray, pivot_ids: np.ndarray, radius: np.ndarray, layout: dict[int, tuple[int, int]],
           home: bool, exclude_self: bool) -> DataFrame:
    """query_id, vec, found, block: the blocks that a query has to search.

    ``home`` asks for one block of the nearest cell.  Otherwise the query brings the similarity
    that it has found, and every block with a cell that may reach it is asked for.
    """
    first = np.array([layout.get(c, (0, 0))[0] for c in range(len(pivots))])
    parts = np.array([layout.get(c, (0, 0))[1] for c in range(len(pivots))])
    shared = queries.sparkSession.sparkContext.broadcast((pivots, pivot_ids, radius, first, parts))
    most = max(16, SENT_BYTES // (8 * pivots.shape[1]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centres, ids, wide, start, count = shared.value
        for batch in batches:
            if not len(batch):
                continue
            vectors, own = _unit_rows(list(batch["vec"])), batch["query_id"].to_numpy()
            angles = _angles(vectors, centres)
            near = angles.argmin(axis=1)
            # a pivot is an entry itself: a first similarity for free
            others = np.where((ids[None, :] == own[:, None]) & exclude_self, np.inf, angles).min(axis=1)
            free = np.where(np.isfinite(others), np.cos(np.minimum(others, np.pi)) - SLACK, -2.0)
            if home:
                found = free
                rows = ((q, v, f, int(start[c] + q % count[c])) for q, v, f, c in zip(own.tolist(), vectors, found, near, strict=True))
            else:
                found = np.maximum(batch["found"].to_numpy(), free)
                best = np.cos(np.maximum(angles - wide[None, :] - SLACK, 0.0))
                open_cells = (best >= found[:, None] - SLACK) & (count > 0)
                rows = ((int(own[k]), vectors[k], found[k], int(b)) for k, open_ in enumerate(open_cells)
                        for b in {b for c in np.flatnonzero(open_).tolist() for b in range(start[c], start[c] + count[c])})
            # a query may ask for many blocks, so its batch is not handed over as one frame
            while piece := list(islice(rows, most)):
                yield pd.DataFrame(piece, columns=["query_id", "vec", "found", "block"])

    return queries.mapInPandas(run, "query_id long, vec array<double>, found double, block long")


def _search(asked: DataFrame, entries: DataFrame, pivots: np.ndarray, radius: np.ndarray, rows: int, exclude_self: bool) -> DataFrame:
    """query_id, entry_id, similarity: the best entry of each block for each query that asks for it.

    A block that many queries ask for is copied, so that each copy has about ``rows`` of them.
    """
    copies = cut_lineage(asked.groupBy("block").agg(F.ceil(F.count("*") / rows).cast("int").alias("copies")))
    mine = lookup_join(asked, copies, ["block"], "inner", F.col("query_id")).withColumn(
        "copy", F.pmod(F.xxhash64("query_id", F.lit(5)), "copies").cast("int")).drop("copies")
    theirs = lookup_join(entries, copies, ["block"], "inner", F.col("entry_id")).withColumn(
        "copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")
    shared = asked.sparkSession.sparkContext.broadcast((pivots, radius))

    def run(queries: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        out: list[pd.DataFrame] = []
        if len(queries) and len(found):
            found = found.sort_values(["cell", "entry_id"])
            ids, cells = found["entry_id"].to_numpy(), found["cell"].to_numpy()
            vectors = np.stack(found["vec"].to_list())
            centres, wide = shared.value
            cuts = np.append(np.flatnonzero(np.append(True, cells[1:] != cells[:-1])), len(cells))
            step = max(1, min(SLICE, SCORES // int(np.diff(cuts).max())))
            for at in range(0, len(queries), step):
                part = queries.iloc[at:at + step]
                own, asking = part["query_id"].to_numpy(), np.stack(part["vec"].to_list())
                best, winner = part["found"].to_numpy().copy(), np.full(len(part), -1)
                for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    c = cells[a]
                    reach = np.cos(np.maximum(_angles(asking, centres[c:c + 1])[:, 0] - wide[c] - SLACK, 0.0))
                    live = np.flatnonzero(reach >= best - SLACK)
                    if not len(live):
                        continue
                    similar = np.round(asking[live] @ vectors[a:b].T, DIGITS)
                    if exclude_self:
                        similar[ids[None, a:b] == own[live][:, None]] = -np.inf
                    top = similar.argmax(axis=1)
                    value = similar[np.arange(len(live)), top]
                    now = np.where(winner[live] >= 0, ids[winner[live]], np.iinfo(np.int64).max)
                    better = np.isfinite(value) & ((value > best[live]) | ((value == best[live]) & (ids[a + top] < now)))
                    best[live[better]], winner[live[better]] = value[better], a + top[better]
                hit = winner >= 0
                out.append(pd.DataFrame({"query_id": own[hit], "entry_id": ids[winner[hit]], "similarity": best[hit]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "entry_id": [], "similarity": []})

    return mine.groupBy("block", "copy").cogroup(theirs.groupBy("block", "copy")).applyInPandas(
        run, "query_id long, entry_id long, similarity double")


def nearest_exact(queries: DataFrame, entries: DataFrame, query_id: str, entry_id: str, embedding: str = "embedding",
                  exclude_self: bool = False, pivots: int = PIVOTS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(query_id, entry_id, similarity)`` of the entry with the largest cosine, ties to the smallest id.

    Cosines are rounded to nine digits before they are compared.  One row for each query id
    that has an entry to compare with; vectors that are null or hold null or non-finite parts
    take no part, and a zero vector has cosine 0 with all.  With ``exclude_self`` entries of
    the query's own id are left out.
    """
    bound_batches(entries.sparkSession)
    stored = entries.filter(_usable(embedding)).select(F.col(entry_id).cast("long").alias("entry_id"), F.col(embedding).alias("vec"))
    asking = queries.filter(_usable(embedding)).select(F.col(query_id).cast("long").alias("query_id"), F.col(embedding).alias("vec"))
    chosen = stored.orderBy(F.xxhash64("entry_id"), "entry_id").limit(pivots).collect()
    if not chosen:
        return asking.select("query_id", F.lit(None).cast("long").alias("entry_id"), F.lit(None).cast("double").alias("similarity")).limit(0)
    centres, centre_ids = _unit_rows([r["vec"] for r in chosen]), np.array([r["entry_id"] for r in chosen])
    cells = cut_lineage(_in_cells(stored, centres))
    sizes = {r["cell"]: (r["n"], r["angle"]) for r in cells.groupBy("cell").agg(
        F.count("*").alias("n"), F.max("angle").alias("angle")).collect()}
    rows = max(16, block_bytes // (8 * centres.shape[1]))
    layout = _layout({c: n for c, (n, _) in sizes.items()}, rows)
    radius = np.array([sizes.get(c, (0, 0.0))[1] for c in range(len(centres))])
    places = F.broadcast(queries.sparkSession.createDataFrame([(c, b, p) for c, (b, p) in layout.items()], "cell int, first long, parts long"))
    placed = cells.join(places, "cell").select(
        "entry_id", "vec", "cell", (F.col("first") + F.pmod(F.xxhash64("entry_id", F.lit(3)), "parts")).alias("block"))

    home = _asked(asking, centres, centre_ids, radius, {c: layout.get(c, (0, 1)) for c in range(len(centres))}, True, exclude_self)
    first = cut_lineage(_search(home, placed, centres, radius, rows, exclude_self))
    known = first.groupBy("query_id").agg(F.max("similarity").alias("found"))
    again = asking.join(known, "query_id", "left").select("query_id", "vec", F.coalesce("found", F.lit(-2.0)).alias("found"))
    rest = _search(_asked(again, centres, centre_ids, radius, layout, False, exclude_self), placed, centres, radius, rows, exclude_self)
    best = first.unionByName(rest).groupBy("query_id").agg(F.max(F.struct("similarity", (-F.col("entry_id")).alias("entry_id"))).alias("m"))
    return best.select("query_id", (-F.col("m.entry_id")).alias("entry_id"), "m.similarity")
