"""The staged screening of a request history.

Stages see only the requests that the stages before let through: blocked encodings use
no rate-limit token, cached answers do not enter the session window, and so on.
Decisions travel as narrow tables; the texts are shuffled once, by request id.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import truncate_output
from ..session import cut_lineage
from . import guards, ratelimit, rules as rule_ops, scoring, screening, sessions, similarity


@dataclass(frozen=True)
class Settings:
    max_message: int = fixed.MAX_MESSAGE_CHARS
    max_output: int = fixed.MAX_OUTPUT_CHARS
    cache_threshold: float = fixed.CACHE_THRESHOLD
    drift_limit: float = fixed.DRIFT_THRESHOLD
    escalation_limit: float = fixed.ESCALATION_THRESHOLD
    bucket: dict = field(default_factory=dict)


def verdicts(requests: DataFrame, cached: DataFrame, rules: DataFrame, settings: Settings | None = None) -> DataFrame:
    """Every request with its deciding ``stage``, ``status``, ``action_taken`` and ``reason``.

    ``requests`` has one user message each: id, session_id, ts, prompt, the model columns
    of the guards, and the answer in ``text``; ids increase with time.  Answers are cut to
    ``max_output`` characters and a marker before any guard or record reads them.  ``cached`` are the
    stored entries (entry_id, prompt), of which those older than a request can answer it.
    Every request that reaches the cache and session stages is embedded there; entries are
    embedded in the same way.
    """
    s = settings or Settings()
    long_prompt = F.when(F.length("prompt") > s.max_message, F.lit("message_too_long"))
    gated = requests.withColumn("text", truncate_output(F.col("text"), s.max_output)).withColumn("violation", long_prompt).withColumn(
        "raw_prompt", F.when(F.col("violation").isNull(), F.col("prompt"))).drop("prompt")
    # Several stages read the normalised prompts; writing them beats decoding them again.
    screened = cut_lineage(screening.screen(gated, "raw_prompt"))

    open_rows = screened.filter(F.col("violation").isNull() & ~F.col("norm_blocked")).select("id", "session_id", "ts")
    limited = cut_lineage(
        ratelimit.replay(open_rows, "session_id", "ts", "id", **s.bucket).select("id", "session_id", "allowed"))
    # vectors are a narrow table of their own, so that no later join carries texts
    vectors = cut_lineage(scoring.embed(
        screened.filter(F.col("violation").isNull() & ~F.col("norm_blocked")).select("id", "norm_text"), "norm_text").drop("norm_text"))
    known = limited.filter("allowed").join(vectors, "id")
    entries = scoring.embed(cached, "prompt").drop("prompt")
    found = similarity.nearest(known, entries, "id", "entry_id", "entry_id", query_order="id")
    hit = F.coalesce(F.col("similarity") >= s.cache_threshold, F.lit(False))
    lookups = cut_lineage(found.select(F.col("query_id").alias("id"), hit.alias("cache_hit")))
    turns = known.join(lookups.filter(~F.col("cache_hit")), "id", "left_semi").select("session_id", "id", "embedding")
    scored = sessions.score_turns(turns, "session_id", "id", drift_limit=s.drift_limit,
                                  escalation_limit=s.escalation_limit)

    df = (
        screened.join(limited.select("id", "allowed"), "id", "left")
        .join(lookups, "id", "left")
        .join(scored.select("id", "suspicious", F.col("reason").alias("session_reason"), "drift", "escalation"), "id", "left")
    )
    alive = (
        F.col("violation").isNull() & ~F.col("norm_blocked") & F.coalesce("allowed", F.lit(True))
        & ~F.coalesce("cache_hit", F.lit(False)) & ~F.coalesce("suspicious", F.lit(False))
    )
    df = df.withColumn("_guarded", F.when(alive, F.col("norm_text")))
    df = guards.input_guard(df, "_guarded", "raw_prompt").drop("_guarded")
    answered = F.when(alive & ~F.col("in_action").isin("BLOCK", "REVIEW") & F.col("llm_available"), F.col("text"))
    df = rule_ops.with_violation(df.withColumn("_answer", answered), rules, "id", "_answer")
    has_policy = F.lit(not rules.filter("length(description) > 0").isEmpty())
    return guards.staged_verdict(guards.output_guard(df, has_policy)).drop("_answer", "rule_reason")


def audit_fields(decided: DataFrame) -> DataFrame:
    """Verdicts that are audited, with the fields of an audit record."""
    stage, action = F.col("stage"), F.col("action_taken")
    details = (
        F.when(stage == "normalise", "Encoding Attack Detected").when(stage == "session", "Session Guard triggered")
        .when(stage == "input", "Injection Blocked").when(stage == "cache", "Served from cache")
        .when(stage == "llm", "LLM service unavailable")
        .when(action == "CANARY_LEAK_FLAGGED", "Canary leak detected in LLM output")
        .otherwise("Evaluated semantically")
    )
    passed = action.isin("PASSED", "CANARY_LEAK_FLAGGED")
    output = F.when(passed, F.col("text")).when(action == "QUEUED_FOR_REVIEW", "queued").when(
        action == "CACHE_HIT", "cached").otherwise("blocked")
    after_input = stage.isin("llm", "output", "done")
    return guards.audited(decided).select(
        "id", "ts", F.when(after_input, F.col("in_prompt")).otherwise(F.col("norm_text")).alias("masked_prompt"),
        (after_input & (F.col("in_action") == "SANITIZE")).alias("redacted"), details.alias("details"),
        "action_taken", "reason", output.alias("final_output"),
        F.when(passed, F.length("text")).otherwise(0).alias("total_tokens"), "canary_id")
