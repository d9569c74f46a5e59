"""Streaming counterparts of the batch operators.

State is keyed, bounded per key and expires.  Stateful operators take rows of a key in
(time, id) order inside a micro-batch and in arrival order between micro-batches; event
time is bounded by watermarks, and rows later than the watermark are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from ..functions import fixed
from ..operators import canary, rules, screening, sessions, views
from ..sources import tables


def _cosine(a: np.ndarray, b: np.ndarray) -> float:
    scale = float(np.linalg.norm(a) * np.linalg.norm(b))
    return 1.0 if scale == 0.0 else float(a @ b) / scale


def _time_mode(ttl_ms: int | None) -> str:
    return "none" if ttl_ms is None else "processingTime"


class _SessionWindow(StatefulProcessor):
    """The last vectors of a session, scored on arrival."""

    def __init__(self, window: int, ttl_ms: int | None) -> None:
        self.window, self.ttl_ms = window, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        schema = T.StructType([T.StructField("v", T.ArrayType(T.FloatType()))])
        self.vectors = handle.getListState("vectors", schema, self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        held = [np.asarray(r[0], dtype=np.float64) for r in self.vectors.get()] if self.vectors.exists() else []
        for row in sorted(rows, key=lambda r: r["turn"]):
            held = [*held, np.asarray(row["embedding"], dtype=np.float64)][-self.window:]
            steps = [_cosine(a, b) for a, b in zip(held, held[1:])]
            drift = 1.0 - _cosine(held[0], held[-1]) if len(held) >= 3 else 0.0
            escalation = float(np.var(steps)) if steps else 0.0
            yield Row(session_id=key[0], turn=row["turn"], window_turns=len(held), drift=drift, escalation=escalation)
        self.vectors.put([(v.astype(np.float32).tolist(),) for v in held])

    def close(self) -> None:
        pass


def score_sessions(turns: DataFrame, window: int = fixed.SESSION_WINDOW, drift_limit: float = fixed.DRIFT_THRESHOLD,
                   escalation_limit: float = fixed.ESCALATION_THRESHOLD, ttl_ms: int | None = 86_400_000) -> DataFrame:
    """Streaming form of ``sessions.score_turns`` over (session_id, turn, embedding)."""
    schema = T.StructType([
        T.StructField("session_id", turns.schema["session_id"].dataType), T.StructField("turn", T.LongType()),
        T.StructField("window_turns", T.LongType()), T.StructField("drift", T.DoubleType()),
        T.StructField("escalation", T.DoubleType())])
    scored = turns.groupBy("session_id").transformWithState(
        _SessionWindow(window, ttl_ms), schema, "append", _time_mode(ttl_ms))
    return sessions.flag(scored, drift_limit, escalation_limit)


class _Bucket(StatefulProcessor):
    """One token bucket in integer units; see the batch replay."""

    def __init__(self, cost: int, full: int, refill: int, ttl_ms: int | None) -> None:
        self.cost, self.full, self.refill, self.ttl_ms = cost, full, refill, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        schema = T.StructType([T.StructField("level", T.LongType()), T.StructField("last", T.LongType())])
        self.bucket = handle.getValueState("bucket", schema, self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        level, last = self.bucket.get() if self.bucket.exists() else (self.full, None)
        for row in sorted(rows, key=lambda r: (r["ts_us"], r["id"])):
            if last is not None:
                # A row behind the clock neither refills nor sets it back.
                level = min(self.full, level + max(0, row["ts_us"] - last) * self.refill)
            last = row["ts_us"] if last is None else max(last, row["ts_us"])
            allowed = level >= self.cost
            level -= self.cost if allowed else 0
            yield Row(key=key[0], id=row["id"], allowed=allowed)
        self.bucket.update((level, last))

    def close(self) -> None:
        pass


def limit_rate(requests: DataFrame, key: str, ts: str, row_id: str, capacity: int = fixed.BUCKET_CAPACITY,
               refill_tokens: int = fixed.BUCKET_REFILL_TOKENS, refill_seconds: int = fixed.BUCKET_REFILL_SECONDS,
               ttl_ms: int | None = fixed.IDLE_SECONDS * 1000) -> DataFrame:
    """Streaming form of ``ratelimit.replay``; gives (key, id, allowed).

    The time to live drops idle buckets; it must be at least the time a bucket takes to
    fill, so that a dropped bucket and a full one are the same.
    """
    cost = refill_seconds * 1_000_000
    if ttl_ms is not None and ttl_ms * 1000 * refill_tokens < capacity * cost:
        raise ValueError("idle buckets would expire before they are full")
    rows = requests.select(
        F.col(key).alias("key"), F.col(row_id).cast("long").alias("id"),
        F.unix_micros(F.col(ts).cast("timestamp")).alias("ts_us"))
    schema = T.StructType([T.StructField("key", rows.schema["key"].dataType), T.StructField("id", T.LongType()),
                           T.StructField("allowed", T.BooleanType())])
    return rows.groupBy("key").transformWithState(
        _Bucket(cost, capacity * cost, refill_tokens, ttl_ms), schema, "append", _time_mode(ttl_ms))


def leak_stream(texts: DataFrame, canaries: DataFrame, text_id: str, text: str, seen_at: str,
                ttl_seconds: int = fixed.CANARY_TTL_SECONDS, delay: str = "10 minutes") -> DataFrame:
    """(text, canary) pairs within the canary's life: an interval join of two streams.

    ``seen_at`` and ``created_at`` are timestamps.  A text with several live phrases gives
    several rows.
    """
    pattern = canary.phrase_pattern()
    probes = texts.withWatermark(seen_at, delay).select(
        text_id, F.col(seen_at).alias("_seen"),
        F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)))).alias("_phrase"))
    minted = canaries.withWatermark("created_at", delay)
    life = (F.col("_seen") >= F.col("created_at")) & (
        F.col("_seen") <= F.col("created_at") + F.expr(f"INTERVAL {int(ttl_seconds)} SECONDS"))
    return probes.join(minted, (F.col("_phrase") == F.col("phrase")) & life).drop("_phrase")


def screen_prompts(prompts: DataFrame, text: str = "prompt") -> DataFrame:
    """Stateless screening of incoming prompts."""
    return screening.screen(prompts, text)


def period_counts(audit: DataFrame, ts: str = "ts", width: str = "1 hour", slide: str | None = None,
                  delay: str = "10 minutes") -> DataFrame:
    """Rows per action and event-time window."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    counts = audit.withWatermark(ts, delay).groupBy(w.alias("w"), "action_taken").agg(F.count("*").alias("n_requests"))
    return counts.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "action_taken", "n_requests")


def _start(df: DataFrame, checkpoint: str, write, every: str | None) -> StreamingQuery:
    writer = df.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


def start_audit_sink(rows: DataFrame, path: str, checkpoint: str, name: str = "audit",
                     every: str | None = "2 seconds") -> StreamingQuery:
    """Appends rows; a micro-batch that is retried replaces what it wrote before."""
    return _start(rows, checkpoint, lambda df, n: tables.append_batch(df, path, name, n), every)


def start_tail(audit: DataFrame, path: str, checkpoint: str, n: int = 50,
               every: str | None = "2 seconds") -> StreamingQuery:
    """Keeps the newest ``n`` audit rows: ``path/batch=<id>`` holds them as of that micro-batch."""
    spark = audit.sparkSession

    def merge(df: DataFrame, batch: int) -> None:
        newest = views.tail(df, n)
        if batch > 0:
            newest = newest.unionByName(spark.read.parquet(f"{path}/batch={batch - 1}"))
        views.tail(newest, n).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return _start(audit, checkpoint, merge, every)


def read_tail(spark: SparkSession, path: str) -> DataFrame:
    """The newest rows of the last finished micro-batch."""
    rows = spark.read.parquet(path)
    last = rows.agg(F.max("batch")).first()[0]
    return rows.filter(F.col("batch") == last).drop("batch")


def start_rule_mining(blocked: DataFrame, path: str, checkpoint: str, row_id: str, text: str,
                      every: str | None = "30 seconds") -> StreamingQuery:
    """Mines rule candidates from blocked answers as they arrive."""
    def mine(df: DataFrame, batch: int) -> None:
        found = rules.candidates(df, row_id, text)
        tables.append_batch(rules.learned(df, found, row_id), path, "mining", batch)

    return _start(blocked, checkpoint, mine, every)
