"""Queries over business rules, learned rules and the review queue."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.verdicts import block_outcome
from ..operators import guards, review, rule_counts, rules, views
from ..sources import tables
from . import derived as d, oracle_parts as o
from .registry import query

_INGEST_SQL = f"""
    SELECT id, target_field, operator, rule_value, trim(description) AS description,
        CASE WHEN NOT regexp_matches(target_field, '{fixed.RULE_FIELD_PATTERN}') THEN 'target_field'
             WHEN operator NOT IN ('<=', '>=', '<', '>', '==', '!=') THEN 'operator'
             WHEN NOT isfinite(rule_value) THEN 'rule_value'
             WHEN length(trim(description)) > 500 THEN 'description' END AS rejected_because
    FROM ({d.sql(d.raw_rules)})"""
_RULES_SQL = f"SELECT * EXCLUDE (rejected_because) FROM ({_INGEST_SQL}) WHERE rejected_because IS NULL"


def _ingested(spark, folder):
    return rules.ingest(d.load(spark, folder, d.raw_rules))


def _rules(spark, folder):
    return rules.accepted(_ingested(spark, folder))


@query("rule_ingest", f"SELECT id, description, rejected_because FROM ({_INGEST_SQL})")
def rule_ingest(spark, folder):
    return _ingested(spark, folder).select("id", "description", "rejected_because")


@query("rule_fields", f"SELECT id, target_field AS field, operator, rule_value AS value, description FROM ({_RULES_SQL})")
def rule_fields(spark, folder):
    return tables.rule_fields(_rules(spark, folder))


@query("rules_after_delete", f"""
    SELECT id, target_field, operator, rule_value FROM ({_RULES_SQL})
    WHERE id NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45)""")
def rules_after_delete(spark, folder):
    gone = tables.table(spark, folder, "lineitem").filter("l_returnflag = 'R' AND l_quantity > 45").select(
        F.col("l_partkey").alias("id")).distinct()
    return rules.delete(_rules(spark, folder), gone).select("id", "target_field", "operator", "rule_value")


@query("rule_view", f"""
    SELECT id, CASE operator WHEN '<=' THEN 'LESS_THAN_EQ' WHEN '>=' THEN 'GREATER_THAN_EQ' WHEN '<' THEN 'LESS_THAN'
        WHEN '>' THEN 'GREATER_THAN' WHEN '==' THEN 'EQUALS' WHEN '!=' THEN 'NOT_EQUALS' ELSE 'EQUALS' END AS operator_code,
        CASE WHEN target_field = 'semantic_rule' THEN 'semantic' ELSE 'numeric' END AS kind, operator AS operator_back
    FROM ({_RULES_SQL})""")
def rule_view(spark, folder):
    seen = views.rule_view(_rules(spark, folder))
    return seen.select("id", "operator_code", "kind", views.backend_operator(F.col("operator_code")).alias("operator_back"))


@query("policy_context", f"SELECT substring(string_agg(description, '; ' ORDER BY id), 1, 200) AS context FROM ({_RULES_SQL})")
def policy_context(spark, folder):
    return rules.policy_context(_rules(spark, folder))


@query("policy_lines", f"SELECT id, '- ' || description AS line FROM ({_RULES_SQL})")
def policy_lines(spark, folder):
    return rules.policy_lines(_rules(spark, folder))


# --- amounts against rules -----------------------------------------------------
# Limits a company would set, one per order priority, from the order table itself.
_LIMITS_SQL = """
    SELECT row_number() OVER (ORDER BY o_orderpriority) AS id, 'refund' AS target_field,
        CASE row_number() OVER (ORDER BY o_orderpriority) WHEN 1 THEN '!=' WHEN 2 THEN '<=' WHEN 3 THEN '>' WHEN 4 THEN '<' ELSE '==' END AS operator,
        CAST(CASE row_number() OVER (ORDER BY o_orderpriority) WHEN 2 THEN 900 WHEN 3 THEN 5 WHEN 4 THEN 500 ELSE 40 END AS DOUBLE) AS rule_value,
        concat('limit for ', o_orderpriority) AS description
    FROM (SELECT DISTINCT o_orderpriority FROM orders)"""
_RESPONSES_SQL = d.sql(d.responses)
_AMOUNTS_SQL = o.amount_rows(_RESPONSES_SQL, "id", "text")
_FIRST_SQL = o.first_violation(_AMOUNTS_SQL, _LIMITS_SQL, "id")


def _limits(spark, folder):
    named = tables.table(spark, folder, "orders").select("o_orderpriority").distinct()
    rank = F.element_at(F.create_map(*[F.lit(x) for p, i in [
        ("1-URGENT", 1), ("2-HIGH", 2), ("3-MEDIUM", 3), ("4-NOT SPECIFIED", 4), ("5-LOW", 5)] for x in (p, i)]), F.col("o_orderpriority"))
    operator = F.element_at(F.array(*[F.lit(x) for x in ("!=", "<=", ">", "<", "==")]), F.col("id").cast("int"))
    value = F.element_at(F.array(*[F.lit(float(x)) for x in (40, 900, 5, 500, 40)]), F.col("id").cast("int"))
    return named.withColumn("id", rank.cast("long")).select(
        "id", F.lit("refund").alias("target_field"), operator.alias("operator"), value.alias("rule_value"),
        F.concat(F.lit("limit for "), "o_orderpriority").alias("description"))


def _responses(spark, folder):
    return d.load(spark, folder, d.responses)


@query("extract_amounts", f"SELECT id, position, amount FROM ({_AMOUNTS_SQL})")
def extract_amounts(spark, folder):
    return rules.extracted_amounts(_responses(spark, folder), "id", "text")


@query("rule_violations", f"""
    SELECT a.id, position, amount, r.id AS rule_id, operator, rule_value, description
    FROM ({_AMOUNTS_SQL}) a, ({_LIMITS_SQL}) r WHERE {o.BROKEN}""")
def rule_violations(spark, folder):
    answers = _responses(spark, folder).withColumnRenamed("id", "response_id")
    return rules.violations(answers, _limits(spark, folder), "response_id", "text").withColumnRenamed("response_id", "id")


_COUNTED_SQL = f"""
    SELECT -id AS id, operator, rule_value, description FROM ({_LIMITS_SQL})
    UNION ALL SELECT id, operator, rule_value, description FROM ({_RULES_SQL})"""


@query("rule_violation_counts", f"""
    SELECT r.id AS rule_id, any_value(operator) AS operator, any_value(rule_value) AS rule_value, any_value(description) AS description,
        count(a.id) AS n_amounts, count(DISTINCT a.id) AS n_responses
    FROM ({_COUNTED_SQL}) r LEFT JOIN ({_AMOUNTS_SQL}) a ON {o.BROKEN}
    WHERE operator IN ('<=', '>=', '<', '>', '==') GROUP BY r.id""")
def rule_violation_counts(spark, folder):
    """The limits, with negative ids, and all accepted rules."""
    columns = ["id", "operator", "rule_value", "description"]
    limits = _limits(spark, folder).withColumn("id", -F.col("id")).select(columns)
    counted = limits.unionByName(_rules(spark, folder).select(columns))
    return rule_counts.violation_counts(_responses(spark, folder), counted, "text")


@query("first_violation", f"SELECT id, rule_id, amount, description, reason FROM ({_FIRST_SQL})")
def first_violation(spark, folder):
    return rules.first_violations(_responses(spark, folder), _limits(spark, folder), "id", "text")


@query("contradiction_gate", f"""
    SELECT id, contra_score >= 0.4 AS blocks, CASE WHEN contra_score > consistent_score THEN 'contradicts policy'
        ELSE 'consistent with policy' END AS label FROM ({_RESPONSES_SQL})""")
def contradiction_gate(spark, folder):
    return _responses(spark, folder).select(
        "id", guards.contradiction_gate(F.col("contra_score")).alias("blocks"),
        guards.contradiction_label(F.col("contra_score"), F.col("consistent_score")).alias("label"))


@query("confidence_gate", f"""
    SELECT id, CASE WHEN guard_score > 0.45 AND guard_score < 0.75 THEN 'QUEUED_FOR_REVIEW' ELSE 'BLOCKED' END AS outcome
    FROM ({d.sql(d.reviews)})""")
def confidence_gate(spark, folder):
    return d.load(spark, folder, d.reviews).select("id", block_outcome(F.col("guard_score")).alias("outcome"))


@query("output_guard", f"""
    SELECT id, out_action, out_reason, out_confidence FROM ({o.output_guard(_RESPONSES_SQL, _FIRST_SQL, 'id')})""")
def output_guard(spark, folder):
    answers = rules.with_violation(_responses(spark, folder), _limits(spark, folder), "id", "text")
    return guards.output_guard(answers).select("id", "out_action", "out_reason", "out_confidence")


# --- learned rules --------------------------------------------------------------
_MINED_SQL = f"""
    SELECT id, json_extract_string(c, '$.target_field') AS target_field, json_extract_string(c, '$.operator') AS operator,
        TRY_CAST(json_extract_string(c, '$.suggested_value') AS DOUBLE) AS suggested_value,
        json_extract_string(c, '$.description') AS description, TRY_CAST(json_extract_string(c, '$.confidence') AS DOUBLE) AS confidence
    FROM (SELECT id, unnest(CAST(body AS JSON[])) AS c FROM (
        SELECT id, CASE WHEN json_valid(regexp_extract(mined, '(?s)\\[.*\\]', 0)) THEN regexp_extract(mined, '(?s)\\[.*\\]', 0)::JSON END AS body
        FROM ({d.sql(d.judge_texts)})) WHERE body IS NOT NULL)"""
_CANDIDATES_SQL = f"""
    SELECT * FROM ({_MINED_SQL}) WHERE confidence > 0.6 AND suggested_value IS NOT NULL AND target_field IS NOT NULL
        AND operator IS NOT NULL AND description IS NOT NULL"""


def _candidates(spark, folder):
    return rules.candidates(d.load(spark, folder, d.judge_texts), "id", "mined")


@query("rule_candidates", _CANDIDATES_SQL)
def rule_candidates(spark, folder):
    return _candidates(spark, folder)


@query("learned_rules", f"""
    SELECT id AS source_log_id, target_field, operator, suggested_value, description, confidence, 'pending' AS status
    FROM ({_CANDIDATES_SQL}) WHERE id IN (SELECT event_id FROM events WHERE event_type = 'error')""")
def learned_rules(spark, folder):
    blocked = d.load(spark, folder, d.audit).filter("action_taken = 'BLOCKED'")
    return rules.learned(blocked, _candidates(spark, folder), "id")


_SUGGESTED_SQL, _DECIDED_SQL = d.sql(d.suggestions), d.sql(d.decisions)
_STATUS_SQL = f"""
    SELECT s.id, coalesce(n.status, s.status) AS status FROM ({_SUGGESTED_SQL}) s
    LEFT JOIN (SELECT id, arg_max(status, decided_at) AS status FROM ({_DECIDED_SQL}) GROUP BY id) n ON n.id = s.id"""


def _suggestions(spark, folder):
    return d.load(spark, folder, d.suggestions)


def _decisions(spark, folder):
    return d.load(spark, folder, d.decisions)


@query("suggestion_status", _STATUS_SQL)
def suggestion_status(spark, folder):
    return rules.latest_status(_suggestions(spark, folder), _decisions(spark, folder)).select("id", "status")


@query("pending_suggestions", f"""
    SELECT s.id, s.target_field, s.confidence FROM ({_SUGGESTED_SQL}) s JOIN ({_STATUS_SQL}) t ON t.id = s.id
    WHERE t.status = 'pending' ORDER BY s.confidence DESC, s.id""")
def pending_suggestions(spark, folder):
    current = rules.latest_status(_suggestions(spark, folder), _decisions(spark, folder))
    return rules.pending(current).select("id", "target_field", "confidence")


@query("promoted_rules", f"""
    SELECT id, target_field, operator, rule_value, description, CAST(NULL AS BIGINT) AS source_suggestion FROM ({_RULES_SQL})
    UNION ALL SELECT CAST(-1 - id AS BIGINT), target_field, operator, suggested_value, description, id FROM ({_SUGGESTED_SQL})
    WHERE id IN (SELECT id FROM ({_DECIDED_SQL}) WHERE status = 'approved')""")
def promoted_rules(spark, folder):
    return rules.promote(_rules(spark, folder), _suggestions(spark, folder), _decisions(spark, folder))


@query("uncovered_suggestions", f"""
    SELECT id, target_field FROM ({_SUGGESTED_SQL})
    WHERE target_field NOT IN (SELECT target_field FROM ({_RULES_SQL}))""")
def uncovered_suggestions(spark, folder):
    return rules.uncovered(_suggestions(spark, folder), _rules(spark, folder)).select("id", "target_field")


@query("suggestion_bands", f"""
    SELECT id, CASE WHEN confidence * 100 >= 80 THEN 'high' WHEN confidence * 100 >= 60 THEN 'medium' ELSE 'low' END AS band
    FROM ({_SUGGESTED_SQL})""")
def suggestion_bands(spark, folder):
    return views.suggestion_bands(_suggestions(spark, folder)).select("id", "band")


# --- review queue -----------------------------------------------------------------
_REVIEWS_SQL, _RESOLUTIONS_SQL = d.sql(d.reviews), d.sql(d.review_decisions)


@query("pending_reviews", f"""
    SELECT id, created_at, session_id, guard_score FROM ({_REVIEWS_SQL}) WHERE status = 'pending' ORDER BY created_at DESC, id DESC""")
def pending_reviews(spark, folder):
    return review.pending(d.load(spark, folder, d.reviews)).select("id", "created_at", "session_id", "guard_score")


_RESOLVED_SQL = f"""
    SELECT q.id, coalesce(n.status, q.status) AS status, n.reviewed_by, n.reviewed_at FROM ({_REVIEWS_SQL}) q LEFT JOIN (
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY reviewed_at DESC, status DESC, reviewed_by DESC) AS k
        FROM ({_RESOLUTIONS_SQL})) WHERE k = 1) n ON n.id = q.id"""


def _resolved(spark, folder):
    return review.resolve(d.load(spark, folder, d.reviews), d.load(spark, folder, d.review_decisions))


@query("resolved_reviews", _RESOLVED_SQL)
def resolved_reviews(spark, folder):
    return _resolved(spark, folder).select("id", "status", "reviewed_by", "reviewed_at")


@query("review_split", f"""
    SELECT CASE WHEN status = 'pending' THEN 'pending' ELSE 'resolved' END AS state, count(*) AS n_reviews
    FROM ({_RESOLVED_SQL}) GROUP BY 1""")
def review_split(spark, folder):
    return review.split(_resolved(spark, folder))
