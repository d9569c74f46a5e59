"""Operational metrics and time-window reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ops_metrics(audit: DataFrame, reviews: DataFrame) -> DataFrame:
    """One row of metrics from one pass over each table.

    ``audit`` has ``action_taken`` and ``details``; ``reviews`` has ``status``.
    """
    action, details, status = F.col("action_taken"), F.col("details"), F.col("status")
    a = audit.agg(
        F.count("*").alias("total_requests"),
        F.count_if((action == "BLOCKED") & (details == "Injection Blocked")).alias("blocked_input"),
        F.count_if((action == "BLOCKED") & (details == "Evaluated semantically")).alias("blocked_output"),
        F.count_if(action == "CACHE_HIT").alias("_hits"),
    )
    r = reviews.agg(
        F.count_if(status == "pending").alias("queued_for_review"),
        F.count_if(status == "approved").alias("_approved"),
        F.count_if(status.isin("approved", "rejected")).alias("_resolved"),
    )
    both = a.unionByName(r, allowMissingColumns=True)
    one = both.agg(*[F.max(c).alias(c) for c in both.columns])

    def rate(part: str, whole: str):
        return F.round(F.coalesce(F.try_divide(part, whole), F.lit(0.0)), 4)

    return one.select(
        "total_requests", "blocked_input", "blocked_output", "queued_for_review",
        rate("_approved", "_resolved").alias("false_positive_rate"),
        rate("_hits", "total_requests").alias("cache_hit_rate"),
    )


def cards(metrics: DataFrame) -> DataFrame:
    return metrics.select(
        "total_requests", (F.col("blocked_input") + F.col("blocked_output")).alias("threats_blocked"),
        "queued_for_review",
        F.format_string("%.2f%%", F.col("false_positive_rate") * 100).alias("false_positive_rate"),
    )


def requests_by_period(audit: DataFrame, ts: str = "ts", as_of=None) -> DataFrame:
    """Requests in the last 1, 7 and 30 days and in the period of equal length before."""
    if as_of is None:
        as_of = audit.agg(F.max(ts)).first()[0]
    age = F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp"))
    days = [1, 7, 30]
    day = 86_400_000_000
    columns = []
    for n in days:
        columns.append(F.count_if((age >= 0) & (age < n * day)).alias(f"now_{n}"))
        columns.append(F.count_if((age >= n * day) & (age < 2 * n * day)).alias(f"before_{n}"))
    rows = F.array(*[
        F.struct(F.lit(n).alias("days"), F.col(f"now_{n}").alias("n_requests"), F.col(f"before_{n}").alias("n_previous"))
        for n in days])
    return audit.agg(*columns).select(F.inline(rows)).withColumn(
        "delta", F.col("n_requests") - F.col("n_previous"))


def threat_breakdown(audit: DataFrame) -> DataFrame:
    """Share of blocked, queued and passed rows."""
    kind = F.when(F.col("action_taken") == "BLOCKED", "blocked").when(
        F.col("action_taken") == "QUEUED_FOR_REVIEW", "queued").otherwise("passed")
    counts = audit.groupBy(kind.alias("outcome")).agg(F.count("*").alias("n_requests"))
    # At most three rows are left here.
    return counts.withColumn("share", F.round(F.col("n_requests") / F.sum("n_requests").over(W.partitionBy()), 6))


def guard_rates(audit: DataFrame) -> DataFrame:
    """Block rate per guard, and the share of its blocks a reviewer approved."""
    blocked = F.count_if(F.col("action_taken") == "BLOCKED")
    return audit.groupBy("guard_stage").agg(
        F.count("*").alias("n_requests"), blocked.alias("n_blocked"),
        F.round(blocked / F.count("*"), 6).alias("block_rate"),
        F.round(F.coalesce(F.try_divide(F.count_if(F.col("review_status") == "approved"),
                                        F.count_if(F.col("review_status").isin("approved", "rejected"))),
                           F.lit(0.0)), 6).alias("false_positive_rate"),
    )


def traffic_rates(audit: DataFrame, ts: str = "ts", latency: str = "latency_ms") -> DataFrame:
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    seconds = (F.max(micros) - F.min(micros)) / 1e6
    return audit.agg(
        F.round(F.avg(latency), 4).alias("avg_latency_ms"),
        F.round(F.coalesce(F.try_divide(F.count("*"), seconds), F.lit(0.0)), 8).alias("requests_per_second"),
        F.round(F.count_if(F.col("action_taken") == "CACHE_HIT") / F.count("*"), 6).alias("cache_hit_rate"),
    )


def spike_hours(audit: DataFrame, kind: str, ts: str = "ts", trailing: int = 24, sigmas: float = 2.0) -> DataFrame:
    """Hours of a kind whose count exceeds the mean of the ``trailing`` hours before by ``sigmas`` deviations.

    Hours without a row count as 0, from the kind's first hour on; hours with fewer than
    ``trailing`` hours behind them are not judged.  Rows are counted per hour first, so the window
    only sees hours; sums over a range of time need no rows for quiet hours.
    """
    hours = audit.groupBy(kind, F.date_trunc("hour", F.col(ts)).cast("timestamp_ntz").alias("hour")).agg(
        F.count("*").alias("n_events")).withColumn("_nth", F.floor(F.unix_seconds(F.col("hour").cast("timestamp")) / 3600))
    before = W.partitionBy(kind).orderBy("_nth").rangeBetween(-trailing, -1)
    n = F.col("n_events")
    scored = hours.withColumns({
        "_sum": F.coalesce(F.sum(n).over(before), F.lit(0)), "_squares": F.coalesce(F.sum(n * n).over(before), F.lit(0)),
        "_age": F.col("_nth") - F.min("_nth").over(W.partitionBy(kind))})
    limit = (F.col("_sum") + sigmas * F.sqrt((trailing * F.col("_squares") - F.col("_sum") * F.col("_sum")).cast("double"))) / trailing
    return scored.filter((F.col("_age") >= trailing) & (n > limit)).select(
        kind, "hour", "n_events", F.round(limit, 4).alias("threshold"))
