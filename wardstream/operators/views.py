"""Dashboard projections of audit, rule and suggestion tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPERATOR_CODES = {
    "<=": "LESS_THAN_EQ", ">=": "GREATER_THAN_EQ", "<": "LESS_THAN",
    ">": "GREATER_THAN", "==": "EQUALS", "!=": "NOT_EQUALS",
}
STAGES = ["Input Normalisation", "Session Guard", "Input Guard", "Main LLM", "Hallucination Detector", "Output Guard"]


def audit_rows(verdicts: DataFrame) -> DataFrame:
    """Verdicts as audit records with their four JSON columns."""
    return verdicts.select(
        "id", "ts",
        F.to_json(F.array(F.struct(F.lit("user").alias("role"), F.col("masked_prompt").alias("content"))))
        .alias("masked_input"),
        F.to_json(F.struct(F.col("redacted").alias("redacted"), F.col("details").alias("details")))
        .alias("sanitization_results"),
        F.to_json(F.struct(F.col("action_taken").isin("PASSED", "CANARY_LEAK_FLAGGED", "CACHE_HIT").alias("is_valid"),
                           "action_taken", "reason")).alias("validation_status"),
        F.to_json(F.struct(F.col("final_output").alias("content"))).alias("final_output"),
        "total_tokens", "canary_id",
    )


def events(audit: DataFrame) -> DataFrame:
    """Audit rows as dashboard events: action, stage, description, types, confidence, latency."""
    def san(key: str) -> Column:
        return F.get_json_object("sanitization_results", f"$.{key}")

    def val(key: str) -> Column:
        return F.get_json_object("validation_status", f"$.{key}")

    df = audit.withColumns({
        "_taken": val("action_taken"), "_san": san("action"), "_pii": F.coalesce(san("has_pii") == "true", F.lit(False)),
        "_susp": F.coalesce(san("suspicious") == "true", F.lit(False)),
        "_types": F.from_json(san("detected_types"), "array<string>"),
        "_why": F.coalesce(val("reason"), san("reason")),
        "_conf": F.coalesce(val("confidence"), san("confidence")).try_cast("double"),
    })
    taken, sanitised = F.coalesce("_taken", F.lit("")), F.coalesce("_san", F.lit(""))
    cleaned = (sanitised == "SANITIZE") | F.col("_pii")
    action = (
        F.when((taken == "BLOCKED") | (sanitised == "BLOCK"), "BLOCK")
        .when(taken.isin("QUEUED", "QUEUED_FOR_REVIEW") | (sanitised == "QUEUED"), "QUEUED")
        .when(cleaned, "SANITIZE").otherwise("PASS")
    )
    stage = (
        F.when(taken == "BLOCKED", "Output Guard").when(sanitised == "BLOCK", "Input Guard")
        .when(cleaned, "PII Sanitizer").when(F.col("_susp"), "Session Guard").otherwise("Pipeline")
    )
    tokens = F.coalesce("total_tokens", F.lit(0)).cast("long")
    return df.select(
        F.concat(F.lit("evt_"), F.col("id").cast("string")).alias("id"), "ts", action.alias("action"),
        F.coalesce("session_id", F.lit("unknown")).alias("session_id"), tokens.alias("latency_num"),
        F.when(tokens != 0, F.concat(tokens.cast("string"), F.lit("t"))).otherwise("-").alias("latency"),
        stage.alias("guard_stage"),
        F.coalesce("_why", F.when(action == "PASS", "Request passed all guards.").otherwise("Guard triggered."))
        .alias("description"),
        F.col("_conf").alias("confidence"),
        F.coalesce(F.array_join("_types", ", "), "_taken").alias("trigger_rule"),
    )


def search(view: DataFrame, needle: str = "", action: str = "ALL") -> DataFrame:
    """Case-insensitive substring over id, session, stage or description, and an action filter."""
    wanted = F.lit(needle.lower())
    found = F.lit(False)
    for name in ("id", "session_id", "guard_stage", "description"):
        found = found | F.contains(F.lower(name), wanted)
    out = view.filter(found)
    return out if action == "ALL" else out.filter(F.col("action") == action)


def tail(audit: DataFrame, n: int = 50, order: str = "ts", row_id: str = "id") -> DataFrame:
    """The newest ``n`` rows without prompt and answer texts."""
    hidden = [c for c in ("masked_input", "final_output") if c in audit.columns]
    return audit.drop(*hidden).orderBy(F.desc(order), F.desc(row_id)).limit(n)


def recent_activity(view: DataFrame, n: int = 5) -> DataFrame:
    result = (
        F.when(F.col("action") == "BLOCK", "Blocked").when(F.col("action") == "SANITIZE", "Sanitized")
        .when(F.col("action") == "QUEUED", "Flagged").otherwise("Pass")
    )
    return view.orderBy(F.desc("ts"), F.desc("id")).limit(n).select(
        "id", F.date_format("ts", "HH:mm:ss").alias("time"), "session_id", "guard_stage",
        result.alias("result"), "action", "latency")


def activity_lookup(activity: DataFrame, view: DataFrame) -> DataFrame:
    """The newest event of each activity row's session."""
    newest = view.groupBy("session_id").agg(F.max(F.struct("ts", "id", "description")).alias("_e"))
    return activity.join(newest, "session_id", "left").select(
        F.col("id").alias("activity_id"), "session_id", F.col("_e.id").alias("event_id"), "_e.description")


def rule_view(rules: DataFrame) -> DataFrame:
    """Rules with display operator code and kind."""
    codes = F.create_map(*[F.lit(x) for pair in OPERATOR_CODES.items() for x in pair])
    return rules.withColumns({
        "operator_code": F.coalesce(F.try_element_at(codes, "operator"), F.lit("EQUALS")),
        "kind": F.when(F.col("target_field") == "semantic_rule", "semantic").otherwise("numeric"),
    })


def backend_operator(code: Column) -> Column:
    back = F.create_map(*[F.lit(x) for op, name in OPERATOR_CODES.items() for x in (name, op)])
    return F.coalesce(F.try_element_at(back, code), F.lit("=="))


def suggestion_bands(suggestions: DataFrame) -> DataFrame:
    percent = F.col("confidence") * 100
    return suggestions.withColumn(
        "band", F.when(percent >= 80, "high").when(percent >= 60, "medium").otherwise("low"))


def stage_trace(verdicts: DataFrame, row_id: str = "id") -> DataFrame:
    """Per request and stage: pass, block, warn or skip.

    The deciding ``stage`` says where a request ended.  Verdicts without that column are read
    from status and reason.
    """
    why = F.lower(F.coalesce("reason", F.lit("")))
    status = F.col("status")

    def says(*words: str) -> Column:
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(why, F.lit(w))
        return hit

    def trace(first: str, *rest: str) -> Column:
        names = ["Input Validation", *STAGES]
        return F.array(*[
            F.struct(F.lit(i).alias("stage_no"), F.lit(n).alias("stage"), F.lit(s).alias("outcome"))
            for i, (n, s) in enumerate(zip(names, [first, *rest]))])

    traces = (
        F.when(status == 400, trace("block", *["skip"] * 6))
        .when(says("encoding", "homoglyph", "zero-width"), trace("pass", "block", *["skip"] * 5))
        .when(says("session", "crescendo", "drift"), trace("pass", "pass", "block", *["skip"] * 4))
        .when((status == 403) & ~says("hallucin", "output", "refund"), trace("pass", "pass", "pass", "block", *["skip"] * 3))
        .when(says("hallucin"), trace("pass", "pass", "pass", "pass", "pass", "block", "skip"))
        .when(status == 403, trace(*["pass"] * 6, "block"))
        .when(status == 202, trace("pass", "pass", "pass", "warn", *["skip"] * 3))
        .otherwise(trace(*["pass"] * 7))
    )
    if "stage" in verdicts.columns:
        places = {"shape": 0, "normalise": 1, "rate_limit": 1, "session": 2, "input": 3, "llm": 4, "output": 6}
        result = F.when(status == 202, "warn").otherwise("block")
        place = F.create_map(*[F.lit(x) for pair in places.items() for x in pair])
        at = F.coalesce(F.try_element_at(place, "stage"), F.lit(len(STAGES) + 1))
        # a throttled request passed normalisation and went no further; a cached one skips all after that
        at = F.when(F.col("stage").isin("rate_limit", "cache"), F.lit(2)).otherwise(at)
        result = F.when(F.col("stage").isin("rate_limit", "cache"), "skip").otherwise(result)
        traces = F.array(*[
            F.struct(F.lit(i).alias("stage_no"), F.lit(n).alias("stage"),
                     F.when(F.lit(i) < at, "pass").when(F.lit(i) == at, result).otherwise("skip").alias("outcome"))
            for i, n in enumerate(["Input Validation", *STAGES])])
    return verdicts.select(row_id, F.inline(traces))
