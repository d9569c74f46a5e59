"""Input and output guard decisions over tables, and the staged request verdict.

Model scores and judge texts are columns of the input; NULL stands for a model that
was not asked or gave nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, injection, pii
from ..functions.bind import bind
from ..functions.verdicts import block_outcome


def classifier_gate(label: Column, score: Column, threshold: float = fixed.CLASSIFIER_THRESHOLD) -> Column:
    """ESCALATE for a confident injection, else PASS."""
    hit = F.coalesce((label == fixed.CLASSIFIER_LABEL) & (score > threshold), F.lit(False))
    return F.when(hit, F.lit("ESCALATE")).otherwise(F.lit("PASS"))


def input_guard(prompts: DataFrame, text: str = "prompt", raw_text: str | None = None) -> DataFrame:
    """Adds ``in_action``, ``in_reason``, ``in_confidence``, ``in_prompt``, ``in_types``, ``in_count``.

    Reads ``clf_label``, ``clf_score``, ``judge_action``, ``judge_reason`` and
    ``judge_confidence``.  ``raw_text`` is scanned for phrases as well, because folding
    lookalikes rewrites the letters of Cyrillic phrases.
    """
    df = pii.redact(prompts, text, out="_safe")
    phrase = injection.multilang_hit(F.col(text))
    if raw_text:
        phrase = F.coalesce(phrase, injection.multilang_hit(F.col(raw_text)))
    df = bind(bind(df, "_marker", injection.indirect_marker(F.col(text))), "_lang", phrase)
    df = df.withColumns({
        "_route": pii.route(F.col("_safe_types")),
        "_gate": classifier_gate(F.col("clf_label"), F.col("clf_score")),
    })
    asked = (F.col("_route") == "A") | ((F.col("_route") == "C") & (F.col("_gate") == "ESCALATE"))
    stopped = F.col("_marker").isNotNull() | F.col("_lang").isNotNull()
    # A judge that should have answered but did not fails closed.
    judged = F.coalesce("judge_action", F.lit("BLOCK"))
    types = F.array_join("_safe_types", ", ")
    df = df.withColumns({
        "in_action": F.when(stopped, "BLOCK").when(asked, judged)
        .when(F.col("_route") == "B", "SANITIZE").otherwise("PASS"),
        "in_reason": F.when(F.col("_marker").isNotNull(),
                            F.concat(F.lit("Indirect prompt injection detected (pattern: "), "_marker", F.lit(")")))
        .when(F.col("_lang").isNotNull(), F.concat(F.lit("Multilingual injection detected ["), "_lang", F.lit("]")))
        .when(asked, F.coalesce("judge_reason", F.lit("judge unavailable")))
        .when(F.col("_route") == "B", F.concat(F.lit("PII detected: "), types))
        .otherwise(F.lit("Cleared specialized injection classifier.")),
        "in_confidence": F.when(stopped | ~asked, F.lit(1.0)).otherwise(
            F.when(F.col("judge_action").isNull(), F.lit(0.0)).otherwise(F.coalesce("judge_confidence", F.lit(1.0)))),
        "in_prompt": F.when(stopped, F.lit("")).otherwise(F.col("_safe")),
        "in_types": F.when(stopped, F.array().cast("array<string>")).otherwise(F.col("_safe_types")),
        "in_count": F.when(stopped, F.lit(0).cast("long")).otherwise(F.col("_safe_count")),
    })
    return df.drop("_safe", "_safe_types", "_safe_count", "_safe_made", "_marker", "_lang", "_route", "_gate")


def contradiction_gate(score: Column, has_policy: Column | None = None,
                       threshold: float = fixed.CONTRADICTION_THRESHOLD) -> Column:
    """True where the contradiction score blocks; a missing score never does."""
    hit = F.coalesce(score >= threshold, F.lit(False))
    return hit if has_policy is None else hit & has_policy


def contradiction_label(contradicts: Column, consistent: Column) -> Column:
    return F.when(contradicts > consistent, F.lit("contradicts policy")).otherwise(F.lit("consistent with policy"))


def output_guard(responses: DataFrame, has_policy: Column | None = None) -> DataFrame:
    """Adds ``out_action``, ``out_reason``, ``out_confidence``.

    Without a policy (``has_policy`` false) the contradiction score is not asked.
    Reads ``rule_reason`` (the first broken rule), ``contra_score``, ``out_judge_action``,
    ``out_judge_reason`` and ``out_judge_confidence``.
    """
    rule = F.col("rule_reason").isNotNull()
    contra = contradiction_gate(F.col("contra_score"), has_policy)
    return responses.withColumns({
        "out_action": F.when(rule | contra, "BLOCK").otherwise(F.coalesce("out_judge_action", F.lit("BLOCK"))),
        "out_reason": F.when(rule, F.col("rule_reason")).when(
            contra, F.concat(F.lit("contradicts policy, score "), F.format_string("%.2f", "contra_score")))
        .otherwise(F.coalesce("out_judge_reason", F.lit("judge unavailable"))),
        "out_confidence": F.when(rule, F.lit(1.0)).when(contra, F.col("contra_score"))
        .when(F.col("out_judge_action").isNull(), F.lit(0.0))
        .otherwise(F.coalesce("out_judge_confidence", F.lit(1.0))),
    })


def staged_verdict(requests: DataFrame) -> DataFrame:
    """First stage that stops each request: adds ``stage``, ``status``, ``action_taken``, ``reason``.

    Reads ``violation``, ``norm_blocked``, ``norm_reason``, ``allowed``, ``cache_hit``,
    ``suspicious``, ``session_reason``, ``in_action``, ``in_reason``, ``in_confidence``,
    ``llm_available``, ``canary_leak``, ``out_action``, ``out_reason``, ``out_confidence``.
    """
    c = F.col
    yes, no = F.lit(True), F.lit(False)
    shape = c("violation").isNotNull()
    encoding = F.coalesce(c("norm_blocked"), no)
    throttled = ~F.coalesce(c("allowed"), yes)
    cached = F.coalesce(c("cache_hit"), no)
    drift = F.coalesce(c("suspicious"), no)
    blocked_in = c("in_action") == "BLOCK"
    review_in = c("in_action") == "REVIEW"
    down = ~F.coalesce(c("llm_available"), yes)
    blocked_out = c("out_action") == "BLOCK"
    review_out = c("out_action") == "REVIEW"
    gate_in, gate_out = block_outcome(c("in_confidence")), block_outcome(c("out_confidence"))
    queued = F.lit("QUEUED_FOR_REVIEW")
    stage = (
        F.when(shape, "shape").when(encoding, "normalise").when(throttled, "rate_limit")
        .when(cached, "cache").when(drift, "session").when(blocked_in | review_in, "input")
        .when(down, "llm").when(blocked_out | review_out, "output").otherwise("done")
    )
    action = (
        F.when(shape, "REJECTED").when(encoding, "BLOCKED").when(throttled, "RATE_LIMITED")
        .when(cached, "CACHE_HIT").when(drift, "BLOCKED")
        .when(blocked_in, gate_in).when(review_in, queued).when(down, "LLM_UNAVAILABLE")
        .when(blocked_out, gate_out).when(review_out, queued)
        .when(F.coalesce(c("canary_leak"), no), "CANARY_LEAK_FLAGGED").otherwise("PASSED")
    )
    reason = (
        F.when(shape, c("violation")).when(encoding, F.concat(F.lit("Encoding attack: "), c("norm_reason")))
        .when(throttled, "Rate limit exceeded").when(cached, "Served from cache").when(drift, c("session_reason"))
        .when(blocked_in | review_in, c("in_reason")).when(down, "LLM service unavailable")
        .when(blocked_out | review_out, c("out_reason"))
        .when(F.coalesce(c("canary_leak"), no), "Canary phrase in the answer").otherwise("Cleared all semantic guards")
    )
    df = requests.withColumns({"stage": stage, "action_taken": action, "reason": reason})
    status = (
        F.when(c("action_taken") == "REJECTED", 400).when(c("action_taken") == "BLOCKED", 403)
        .when(c("action_taken") == "RATE_LIMITED", 429).when(c("action_taken") == queued, 202)
        .when(c("action_taken") == "LLM_UNAVAILABLE", 503).otherwise(200)
    )
    return df.withColumn("status", status)


def audited(verdicts: DataFrame) -> DataFrame:
    """Rows that get an audit record: everything but rejected and throttled requests."""
    return verdicts.filter(~F.col("action_taken").isin("REJECTED", "RATE_LIMITED"))
