"""Rolling multi-turn scores: topic drift, escalation and session reports.

A session of any size is cut into blocks of ``block`` consecutive turn numbers.  Turns
are unique within a session, so no window task sees more than ``block`` rows of it.
Each block also gets copies of the seven turns before it, which makes every rolling
window complete without looking at another block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed, vectors
from .skew import lookup_join

BLOCK = 4096


def _with_halo(turns: DataFrame, session: str, turn: str, width: int, block: int) -> DataFrame:
    """``turns`` plus, per block, copies of the ``width`` turns before it (``_halo``)."""
    base = turns.withColumn("_block", F.floor(F.col(turn) / F.lit(block)))
    tails = base.groupBy(session, "_block").agg(
        F.slice(F.reverse(F.array_sort(F.collect_list(turn))), 1, width).alias("_tail")
    )
    earlier = W.partitionBy(session).orderBy("_block").rowsBetween(-width, -1)
    newest = F.reverse(F.array_sort(F.flatten(F.collect_list("_tail").over(earlier))))
    feeds = (
        tails.withColumn("_feed", F.slice(newest, 1, width))
        .select(session, F.col("_block").alias("_to"), F.explode("_feed").alias(turn))
    )
    halo = lookup_join(turns, feeds, [session, turn], "inner", F.col(turn))
    own = base.withColumn("_halo", F.lit(False))
    copies = halo.withColumnRenamed("_to", "_block").withColumn("_halo", F.lit(True))
    return own.unionByName(copies)


def score_turns(turns: DataFrame, session: str = "session_id", turn: str = "turn",
                embedding: str = "embedding", drift_limit: float = fixed.DRIFT_THRESHOLD,
                escalation_limit: float = fixed.ESCALATION_THRESHOLD,
                window: int = fixed.SESSION_WINDOW, block: int = BLOCK) -> DataFrame:
    """Adds ``window_turns``, ``drift``, ``escalation``, ``suspicious`` and ``reason``.

    ``drift`` is 1 - cosine of the first and last vector of the last ``window`` turns;
    ``escalation`` the population variance of the consecutive cosines in it.
    """
    vec = F.col(embedding)
    w = W.partitionBy(session, "_block").orderBy(turn)
    frame = w.rowsBetween(-(window - 1), 0)
    pairs = w.rowsBetween(-(window - 2), 0)
    df = _with_halo(turns, session, turn, window - 1, block)
    df = df.withColumn("_norm", vectors.norm(vec))
    df = df.withColumns({
        "_prev": F.lag(vec).over(w), "_prev_norm": F.lag("_norm").over(w),
        "_first": F.first(vec).over(frame), "_first_norm": F.first("_norm").over(frame),
        "window_turns": F.count("*").over(frame),
    })

    def cosine(other: str, other_norm: str) -> Column:
        scale = F.col("_norm") * F.col(other_norm)
        # A missing neighbour gives NULL; a zero vector counts as similar.
        return F.when(scale == 0.0, F.lit(1.0)).when(
            scale.isNotNull(), vectors.dot(vec, F.col(other)) / scale)

    df = df.withColumn("_sim", cosine("_prev", "_prev_norm"))
    df = df.withColumns({
        "drift": F.when(F.col("window_turns") < 3, F.lit(0.0)).otherwise(
            1.0 - cosine("_first", "_first_norm")),
        "escalation": F.when(F.col("window_turns") < 2, F.lit(0.0)).otherwise(
            F.var_pop("_sim").over(pairs)),
    }).filter(~F.col("_halo"))
    df = df.drop("_block", "_halo", "_norm", "_prev", "_prev_norm", "_first", "_first_norm", "_sim")
    return flag(df, drift_limit, escalation_limit)


def flag(scored: DataFrame, drift_limit: float, escalation_limit: float) -> DataFrame:
    by_drift = F.col("drift") > drift_limit
    by_escalation = F.col("escalation") > escalation_limit
    return scored.withColumn("suspicious", by_drift | by_escalation).withColumn(
        "reason",
        F.when(by_drift, F.format_string("topic drift %.2f", F.col("drift")))
        .when(by_escalation, F.format_string("escalation variance %.2f", F.col("escalation")))
        .otherwise(F.lit("")),
    )


def session_report(scored: DataFrame, session: str = "session_id", turn: str = "turn") -> DataFrame:
    """Latest state per session."""
    last = F.max_by(F.struct("drift", "escalation", "suspicious", "reason"), turn)
    return scored.groupBy(session).agg(
        F.count("*").alias("n_turns"), last.alias("_last")
    ).select(session, "n_turns", "_last.*")


def with_turns(sessions: DataFrame, turns: DataFrame, session: str = "session_id") -> DataFrame:
    """Sessions that have at least one turn."""
    return sessions.join(turns.select(session).distinct(), session, "left_semi")


def evict_oldest(sessions: DataFrame, session: str = "session_id", created: str = "created_at",
                 max_sessions: int = fixed.MAX_SESSIONS, evict: int = fixed.EVICT_SESSIONS) -> DataFrame:
    """Drops the ``evict`` oldest sessions when there are more than ``max_sessions``."""
    if sessions.limit(max_sessions + 1).count() <= max_sessions:
        return sessions
    oldest = sessions.orderBy(created, session).limit(evict).select(session)
    return lookup_join(sessions, oldest, [session], "left_anti", F.col(session))
