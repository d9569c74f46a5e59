"""The human review queue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pending(queue: DataFrame) -> DataFrame:
    return queue.filter(F.col("status") == "pending").orderBy(F.desc("created_at"), F.desc("id"))


def resolve(queue: DataFrame, decisions: DataFrame) -> DataFrame:
    """Queue rows with the newest decision; ``decisions`` is ``(id, status, reviewed_by, reviewed_at)``."""
    newest = decisions.groupBy("id").agg(
        F.max(F.struct("reviewed_at", "status", "reviewed_by")).alias("_d"))
    return queue.join(newest, "id", "left").withColumns({
        "status": F.coalesce("_d.status", "status"),
        "reviewed_by": F.col("_d.reviewed_by"), "reviewed_at": F.col("_d.reviewed_at"),
    }).drop("_d")


def queued(decided: DataFrame) -> DataFrame:
    """Pending review rows of the verdicts that wait for a human; ``id`` is that of the request.

    A request stopped at the input is shown as the guard read it and has no answer yet (an empty
    text); one stopped at the output is shown with the sanitised prompt and the answer.
    """
    output = F.col("stage") == "output"
    return decided.filter(F.col("action_taken") == "QUEUED_FOR_REVIEW").select(
        "id", F.col("ts").alias("created_at"), "session_id",
        F.when(output, F.col("in_prompt")).otherwise(F.col("norm_text")).alias("masked_prompt"),
        F.when(output, F.col("text")).otherwise("").alias("llm_response"),
        F.col("stage").alias("guard_stage"),
        F.when(output, F.col("out_confidence")).otherwise(F.col("in_confidence")).alias("guard_score"),
        F.col("reason").alias("guard_reason"), F.lit("pending").alias("status"))


def split(queue: DataFrame) -> DataFrame:
    """Rows per view: pending and resolved."""
    state = F.when(F.col("status") == "pending", "pending").otherwise("resolved")
    return queue.groupBy(state.alias("state")).agg(F.count("*").alias("n_reviews"))
