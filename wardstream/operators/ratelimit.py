"""Token-bucket replay over recorded requests.

Time and tokens are integers: one microsecond adds ``refill_tokens`` units and a
request takes ``refill_seconds * 1e6`` units, so no rounding enters the decision.
Requests of one key at one microsecond are a single tick with a count.

Keys are clustered and sorted by Spark and replayed batch by batch.  A key with more
than ``hot_ticks`` ticks is cut into time chunks: each chunk is summarised as an exact
function from its start level to its end level, the functions are chained per key, and
the chunks are then replayed in parallel from their known start levels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed
from ..session import cut_lineage
from .skew import lookup_join

HOT_TICKS = 1_000_000


def _segments(keys: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """(start, end) of the runs of equal keys."""
    n = len(keys[0])
    if not n:
        return
    change = np.zeros(n, dtype=bool)
    for k in keys:
        change[1:] |= k[1:] != k[:-1]
    starts = np.flatnonzero(change).tolist()
    for a, b in zip([0, *starts], [*starts, n]):
        yield a, b


def _replay_batches(cost: int, capacity: int, refill: int):
    """Replays sorted ticks ``_key, _chunk, _start, _start_us, ts_us, m``; carries state over batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        owner: tuple | None = None
        level = last = 0
        for pdf in batches:
            if pdf.empty:
                continue
            keys, chunks = pdf["_key"].to_numpy(), pdf["_chunk"].to_numpy()
            stamps, sizes = pdf["ts_us"].to_numpy(), pdf["m"].to_numpy()
            starts, start_us = pdf["_start"].to_numpy(), pdf["_start_us"].to_numpy()
            granted = np.zeros(len(pdf), dtype=np.int64)
            for a, b in _segments([keys, chunks]):
                if owner != (keys[a], chunks[a]):
                    owner = (keys[a], chunks[a])
                    level, last = int(starts[a]), int(start_us[a])
                now, want = stamps[a:b].tolist(), sizes[a:b].tolist()
                for i in range(b - a):
                    level = min(capacity, level + (now[i] - last) * refill)
                    last = now[i]
                    take = min(want[i], level // cost)
                    level -= take * cost
                    granted[a + i] = take
            yield pd.DataFrame({"_key": keys, "ts_us": stamps, "granted": granted})

    return run


def advance(pieces: list[tuple[int, int, int, int]], gain: int, want: int, cost: int,
            capacity: int) -> list[tuple[int, int, int, int]]:
    """One tick applied to a piecewise level function.

    A piece ``(lo, hi, value, slope)`` maps a start level x in [lo, hi] to
    ``value + slope * (x - lo)`` with slope 0 or 1.
    """
    out: list[tuple[int, int, int, int]] = []

    def add(lo: int, hi: int, value: int, slope: int) -> None:
        if lo == hi:
            slope = 0
        if out:
            p_lo, p_hi, p_value, p_slope = out[-1]
            if slope == 0 and p_slope == 0 and value == p_value:
                out[-1] = (p_lo, hi, p_value, 0)
                return
            if (slope == 1 or lo == hi) and p_slope == 1 and value == p_value + (lo - p_lo):
                out[-1] = (p_lo, hi, p_value, 1)
                return
        out.append((lo, hi, value, slope))

    def take(lo: int, hi: int, value: int, slope: int) -> None:
        while lo <= hi:
            n = value // cost
            # Up to here the same number of whole tokens is available.
            end = hi if slope == 0 or n >= want else min(hi, lo + (n + 1) * cost - 1 - value)
            add(lo, end, value - min(n, want) * cost, slope)
            value += slope * (end + 1 - lo)
            lo = end + 1

    for lo, hi, value, slope in pieces:
        value += gain
        if slope == 0:
            take(lo, hi, min(capacity, value), 0)
            continue
        first_full = lo + max(0, capacity - value)
        if first_full > lo:
            take(lo, min(hi, first_full - 1), value, 1)
        if first_full <= hi:
            take(max(lo, first_full), hi, capacity, 0)
    return out


def _summarise_batches(cost: int, capacity: int, refill: int):
    """Sorted ticks to one row per piece of each chunk's level function."""

    def emit(owner, pieces, first, last):
        return pd.DataFrame(
            [(owner[0], owner[1], first, last, *p) for p in pieces],
            columns=["_key", "_chunk", "first_us", "last_us", "lo", "hi", "value", "slope"],
        )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        owner: tuple | None = None
        pieces: list[tuple[int, int, int, int]] = []
        first = last = 0
        for pdf in batches:
            if pdf.empty:
                continue
            keys, chunks = pdf["_key"].to_numpy(), pdf["_chunk"].to_numpy()
            stamps, sizes = pdf["ts_us"].to_numpy(), pdf["m"].to_numpy()
            for a, b in _segments([keys, chunks]):
                if owner != (keys[a], chunks[a]):
                    if owner is not None:
                        yield emit(owner, pieces, first, last)
                    owner = (keys[a], chunks[a])
                    pieces, first = [(0, capacity, 0, 1)], int(stamps[a])
                    last = first
                for now, want in zip(stamps[a:b].tolist(), sizes[a:b].tolist()):
                    pieces = advance(pieces, (now - last) * refill, want, cost, capacity)
                    last = now
        if owner is not None:
            yield emit(owner, pieces, first, last)

    return run


def _chain(capacity: int, refill: int):
    """Per key: start level and time of every chunk, from the chunk functions in order."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_chunk", "lo"], kind="stable")
        level, clock, rows = capacity, None, []
        for (key, chunk), part in pdf.groupby(["_key", "_chunk"], sort=False):
            first, last = int(part["first_us"].iloc[0]), int(part["last_us"].iloc[0])
            if clock is not None:
                level = min(capacity, level + (first - clock) * refill)
            rows.append((key, chunk, level, first))
            at = part[(part["lo"] <= level) & (level <= part["hi"])].iloc[0]
            level = int(at["value"]) + int(at["slope"]) * (level - int(at["lo"]))
            clock = last
        return pd.DataFrame(rows, columns=["_key", "_chunk", "_start", "_start_us"])

    return run


def replay(requests: DataFrame, key: str, ts: str, row_id: str,
           capacity: int = fixed.BUCKET_CAPACITY, refill_tokens: int = fixed.BUCKET_REFILL_TOKENS,
           refill_seconds: int = fixed.BUCKET_REFILL_SECONDS, hot_ticks: int = HOT_TICKS) -> DataFrame:
    """Adds ``allowed``: the bucket's answer to each request in (time, id) order.

    Requests without a key share one bucket.
    """
    cost, refill = refill_seconds * 1_000_000, refill_tokens
    full = capacity * cost
    stamped = requests.withColumn("ts_us", F.unix_micros(F.col(ts).cast("timestamp")))
    ticks = stamped.groupBy(F.col(key).alias("_key"), "ts_us").agg(F.count("*").alias("m"))
    key_type = requests.schema[key].dataType.simpleString()
    granted_schema = f"_key {key_type}, ts_us long, granted long"

    sizes = ticks.groupBy("_key").agg(F.count("*").alias("n"), F.max("m").alias("m"))
    largest, thickest = sizes.agg(F.max("n"), F.max("m")).first()
    started = F.lit(full).cast("long")
    if (largest or 0) <= hot_ticks:
        plan = ticks.withColumns({"_chunk": F.lit(0).cast("long"), "_start": started, "_start_us": F.col("ts_us")})
        cluster = ["_key"]
    else:
        hot = sizes.filter(F.col("n") > hot_ticks).select("_key")
        plan = _chunked(ticks, hot, key_type, full, cost, refill, hot_ticks)
        cluster = ["_key", "_chunk"]
    granted = (
        plan.repartition(*cluster).sortWithinPartitions("_key", "_chunk", "ts_us")
        .mapInPandas(_replay_batches(cost, full, refill), granted_schema)
    )
    # At one microsecond a bucket grants at most its capacity, first ids first.
    rank = F.row_number().over(W.partitionBy(key, "ts_us").orderBy(row_id))
    granted = granted.withColumnRenamed("ts_us", "_us")

    def met(rows: DataFrame) -> DataFrame:
        same = rows[key].eqNullSafe(granted["_key"]) & (rows["ts_us"] == granted["_us"])
        return rows.join(granted, same).drop("_key", "_us")

    if (thickest or 0) <= capacity:
        return met(stamped.withColumn("_rank", rank)).withColumn(
            "allowed", F.col("_rank") <= F.col("granted")).drop("ts_us", "_rank", "granted")
    early = stamped.select(row_id, key, "ts_us").withColumn("_rank", rank).filter(F.col("_rank") <= capacity)
    winners = met(early).filter(F.col("_rank") <= F.col("granted")).select(row_id, F.lit(True).alias("_won"))
    return stamped.join(winners, row_id, "left").withColumn(
        "allowed", F.coalesce("_won", F.lit(False))).drop("ts_us", "_won")


def _chunked(ticks: DataFrame, hot: DataFrame, key_type: str, full: int, cost: int, refill: int,
             hot_ticks: int) -> DataFrame:
    """Ticks with chunk, start level and start time; only hot keys get several chunks."""
    hot = cut_lineage(hot.withColumn("_hot", F.lit(True)))
    marked = lookup_join(ticks, hot, ["_key"], "left", F.col("ts_us"))
    hot_rows = marked.filter(F.col("_hot")).drop("_hot").withColumn("_sec", F.floor(F.col("ts_us") / 1_000_000))
    # A second holds at most a million ticks, so a chunk has a bounded number of them.
    seconds = hot_rows.groupBy("_key", "_sec").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("_key").orderBy("_sec").rowsBetween(W.unboundedPreceding, -1))
    chunks = seconds.select(
        "_key", "_sec", F.floor(F.coalesce(before, F.lit(0)) / hot_ticks).cast("long").alias("_chunk"))
    placed = cut_lineage(hot_rows.join(chunks, ["_key", "_sec"]).drop("_sec"))
    pieces = (
        placed.repartition("_key", "_chunk").sortWithinPartitions("_key", "_chunk", "ts_us")
        .mapInPandas(
            _summarise_batches(cost, full, refill),
            f"_key {key_type}, _chunk long, first_us long, last_us long, lo long, hi long, value long, slope long",
        )
    )
    starts = pieces.groupBy("_key").applyInPandas(
        _chain(full, refill), f"_key {key_type}, _chunk long, _start long, _start_us long")
    warm = lookup_join(placed, starts, ["_key", "_chunk"], "inner", F.col("ts_us"))
    cold = marked.filter(F.col("_hot").isNull()).drop("_hot").withColumns({
        "_chunk": F.lit(0).cast("long"), "_start": F.lit(full).cast("long"), "_start_us": F.col("ts_us")})
    return cold.unionByName(warm)


def throttle_report(replayed: DataFrame, key: str) -> DataFrame:
    return replayed.groupBy(key).agg(
        F.count("*").alias("n_requests"),
        F.count_if(~F.col("allowed")).alias("n_throttled"),
        F.round(F.count_if(~F.col("allowed")) / F.count("*"), 6).alias("throttled_share"),
    )


def idle_keys(requests: DataFrame, key: str, ts: str, as_of=None, max_age_seconds: int = fixed.IDLE_SECONDS) -> DataFrame:
    """Keys whose last request is older than ``max_age_seconds`` at ``as_of`` (default: the newest request)."""
    last = requests.groupBy(key).agg(F.max(ts).alias("last_seen"))
    if as_of is None:
        as_of = requests.agg(F.max(ts)).first()[0]
    return last.filter(
        F.col("last_seen") < F.lit(as_of) - F.make_dt_interval(secs=F.lit(max_age_seconds)))

