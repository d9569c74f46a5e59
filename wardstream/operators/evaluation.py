"""Labelled data, detection quality and run summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def labelled(texts: DataFrame, labels: DataFrame, on: str, text: str, label: str) -> DataFrame:
    """Text and label columns under the names of the prompt data set."""
    return texts.join(labels, on).select(on, F.col(text).alias("prompt"), F.col(label).alias("is_malicious"))


def sample_order(row_id: str) -> Column:
    return F.md5(F.col(row_id).cast("string"))


def balanced_sample(prompts: DataFrame, row_id: str, n: int = 500) -> DataFrame:
    """``n`` rows per class in digest order, or every row when a class has fewer.

    Each class is a top-n: map tasks keep at most ``n`` rows.
    """
    label = F.col("is_malicious")
    bad, good = prompts.agg(F.count_if(label == 1), F.count_if(label == 0)).first()
    if min(bad, good) < n:
        return prompts.filter(label.isin(0, 1))

    def top(value: int) -> DataFrame:
        return prompts.filter(label == value).orderBy(sample_order(row_id), row_id).limit(n)

    return top(1).unionByName(top(0))


def shuffled(prompts: DataFrame, row_id: str) -> DataFrame:
    return prompts.orderBy(sample_order(row_id), row_id)


def evaluation_log(prompts: DataFrame, verdicts: DataFrame, on: str) -> DataFrame:
    """Each prompt with its verdict; a request counts as blocked on status 403."""
    seen = verdicts.select(on, "status", "reason")
    blocked = F.coalesce(F.col("status") == 403, F.lit(False))
    return prompts.join(seen, on, "left").select(
        on, (F.col("is_malicious") == 1).alias("ground_truth"), blocked.alias("blocked"), "reason",
        F.when(F.col("status").isNull(), "no verdict").when(F.col("status") == 503, "unavailable").alias("error"))


def _counts() -> list[Column]:
    truth, blocked, ok = F.col("ground_truth"), F.col("blocked"), F.col("error").isNull()
    return [
        F.count_if(ok & ~truth & ~blocked).alias("tn"), F.count_if(ok & ~truth & blocked).alias("fp"),
        F.count_if(ok & truth & ~blocked).alias("fn"), F.count_if(ok & truth & blocked).alias("tp"),
        F.count_if(~ok).alias("n_errors"),
    ]


def confusion_matrix(log: DataFrame) -> DataFrame:
    return log.agg(*_counts())


def detection_quality(log: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Precision, recall and F1, zero where a denominator is zero."""
    def ratio(a: Column, b: Column) -> Column:
        return F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)

    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    counted = log.groupBy(*(by or [])).agg(*_counts())
    return counted.select(
        *(by or []), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def latency_summary(runs: DataFrame, latency: str) -> DataFrame:
    return runs.agg(F.count("*").alias("n_processed"), F.round(F.sum(latency), 4).alias("total_ms"),
                    F.round(F.avg(latency), 6).alias("avg_ms"))


#: Ids that share a list of verdicts, and the most verdicts that one list holds.
LIST_SIZE = 1000


def _tallies(ts: str | None) -> list[Column]:
    verdict, passed = F.col("verdict"), F.col("verdict") == "PASS"
    counts = [
        F.count_if(passed).alias("n_passed"),
        F.count_if(verdict.isin("BLOCK", "REJECTED", "RATE_LIMIT")).alias("n_blocked"),
        F.count_if(~passed).alias("n_failed"),
        F.count("*").alias("n_total"),
    ]
    return counts if ts is None else [*counts, F.timestamp_diff("MILLISECOND", F.min(ts), F.max(ts)).alias("wall_ms")]


def scenario_summary(verdicts: DataFrame, *by: str, ts: str | None = None) -> DataFrame:
    """Passed, blocked, not passed and total per category (without ``by``: of the whole run).

    ``n_failed`` counts every verdict but a pass, queued requests and errors included;
    with ``ts``, ``wall_ms`` is the time from the first to the last request.
    """
    return verdicts.groupBy(*by).agg(*_tallies(ts))


def verdict_lists(verdicts: DataFrame, category: str, row_id: str, ts: str | None = None, size: int = LIST_SIZE) -> DataFrame:
    """Every verdict of a category in the order of the ids, as arrays, with the counts of each array.

    A category may hold any number of requests, so its list is cut: ``block`` is the id over
    ``size``, and blocks with more than ``size`` rows, as repeated ids give, have several ``part``s.
    Rows without an id are a block with a NULL number.  Rows of one id go by verdict.
    """
    order = W.partitionBy(category, "block").orderBy(row_id, "verdict")
    placed = verdicts.withColumn("block", F.floor(F.col(row_id) / size)).withColumn("_place", F.row_number().over(order) - 1)
    ordered = F.array_sort(F.collect_list(F.struct("_place", "verdict")))
    return placed.groupBy(category, "block", F.floor(F.col("_place") / size).alias("part")).agg(
        *_tallies(ts), F.transform(ordered, lambda v: v["verdict"]).alias("verdicts"))


def run_summary(verdicts: DataFrame, category: str, stage: str, row_id: str, ts: str = "ts", size: int = LIST_SIZE) -> DataFrame:
    """One table for a run: its totals, those of each category and each stage, and the verdict lists of the categories.

    ``level`` says what a row is about: run, category, stage or verdicts; columns that do not belong to it are NULL.
    ``verdicts`` is read once for each level, so it should be a narrow, written table.
    """
    levels = [
        scenario_summary(verdicts, ts=ts).withColumn("level", F.lit("run")),
        scenario_summary(verdicts, category, ts=ts).withColumn("level", F.lit("category")),
        scenario_summary(verdicts, stage, ts=ts).withColumn("level", F.lit("stage")),
        verdict_lists(verdicts, category, row_id, ts, size).withColumn("level", F.lit("verdicts")),
    ]
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), levels)
    return whole.select("level", category, stage, "block", "part", "n_passed", "n_blocked", "n_failed", "n_total", "wall_ms", "verdicts")
