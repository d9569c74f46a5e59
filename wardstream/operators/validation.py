"""Conversation shape rules, the turn to screen, and text written back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, pii
from ..functions.text import truncate_output


def shape_check(messages: DataFrame, max_messages: int = fixed.MAX_MESSAGES,
                max_system: int = fixed.MAX_SYSTEM_CHARS, max_message: int = fixed.MAX_MESSAGE_CHARS,
                max_total: int = fixed.MAX_TOTAL_CHARS) -> DataFrame:
    """One row per conversation with its first violation, NULL when it is well formed.

    Every measure is a map-side combined aggregate, so a conversation of any length
    reaches the reducers as one row per task.
    """
    role, text, turn, n = F.col("role"), F.col("text"), F.col("turn"), F.col("_chars")
    cap = F.when(role == "system", F.lit(max_system)).otherwise(F.lit(max_message))
    faults = ["invalid_role", "invalid_content", "message_too_long"]
    fault = (
        F.when(role.isNull() | ~role.isin(*fixed.ROLES), F.lit(1)).when(text.isNull(), F.lit(2))
        .when(n > cap, F.lit(3))
    )
    # Lengths and codes instead of texts: rows stay narrow and the aggregation hash-based.
    narrow = messages.withColumn("_chars", F.length(text)).select(
        "conv_id", "turn", F.coalesce(n, F.lit(0)).alias("_chars"), fault.alias("_code"),
        (role == "assistant").alias("_assistant"), (role == "system").alias("_system"))
    code = F.col("_code")
    stats = narrow.groupBy("conv_id").agg(
        F.count("*").alias("n_messages"),
        F.sum("_chars").cast("long").alias("n_chars"),
        F.min_by(code, F.when(code.isNotNull(), turn)).alias("_fault"),
        F.min_by("_assistant", turn).alias("_first"),
        F.count_if("_system").alias("_systems"),
    )
    named = F.get(F.array(*[F.lit(f) for f in faults]), F.col("_fault") - 1)
    violation = (
        F.when(F.col("n_messages") > max_messages, F.lit("too_many_messages"))
        .when(F.col("_fault").isNotNull(), named)
        .when(F.col("n_chars") > max_total, F.lit("input_too_long"))
        .when(F.col("_first"), F.lit("starts_with_assistant"))
        .when(F.col("_systems") > 1, F.lit("multiple_system_messages"))
    )
    return stats.withColumn("violation", violation).drop("_fault", "_first", "_systems")


def latest_user_turn(messages: DataFrame) -> DataFrame:
    """The last user message per conversation; NULL text where there is none."""
    user = F.when(F.col("role") == "user", F.col("turn"))
    return messages.groupBy("conv_id").agg(
        F.max(user).alias("turn"), F.max_by("text", user).alias("text")
    )


def masked_conversations(messages: DataFrame, per_turn: bool = False) -> DataFrame:
    """Messages with every user turn replaced by the redacted latest user turn.

    With ``per_turn`` each user turn keeps its own redacted text instead.  The join has
    one right row per conversation; adaptive skew handling splits long conversations.
    """
    if per_turn:
        masked = pii.redact(messages, "text", out="safe")
    else:
        latest = pii.redact(latest_user_turn(messages), "text", out="safe").select("conv_id", "safe")
        masked = messages.join(latest, "conv_id", "left")
    text = F.when(F.col("role") == "user", F.col("safe")).otherwise(F.col("text"))
    return masked.select("conv_id", "turn", "role", text.alias("text"))


def truncated(messages: DataFrame, limit: int = fixed.MAX_OUTPUT_CHARS,
              marker: str = "\n\n[Output truncated]") -> DataFrame:
    """Assistant turns cut to ``limit`` characters plus a marker."""
    return messages.filter(F.col("role") == "assistant").select(
        "conv_id", "turn",
        truncate_output(F.col("text"), limit, marker).alias("text"),
        (F.length("text") > limit).alias("was_truncated"),
    )


def message_lists(messages: DataFrame, block_turns: int = fixed.MAX_MESSAGES) -> DataFrame:
    """Whole conversations as ordered arrays of messages, one row per ``block_turns`` turn numbers.

    ``block`` numbers the parts of a conversation in order and ``n_messages`` counts the messages
    of a part, so a conversation of any length is spread over many tasks and arrays stay short.
    Messages of one turn go by role and text; those without a turn are a part with a NULL block.
    """
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return messages.groupBy("conv_id", F.floor(F.col("turn") / block_turns).alias("block")).agg(
        F.count("*").alias("n_messages"),
        F.transform(ordered, lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content")))
        .alias("messages"),
    )
