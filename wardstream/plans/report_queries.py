"""Queries over audit rows: metrics, dashboard views, time windows."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from ..operators import evaluation, metrics, views
from ..sources import tables
from . import derived as d
from .registry import query
from .rule_queries import _RULES_SQL, _rules

_AUDIT, _REVIEWS = d.sql(d.audit), d.sql(d.reviews)


def _audit(spark, folder):
    return d.load(spark, folder, d.audit)


def _metrics(spark, folder):
    return metrics.ops_metrics(_audit(spark, folder), d.load(spark, folder, d.reviews))


_METRICS_SQL = f"""
    SELECT (SELECT count(*) FROM a) AS total_requests,
        (SELECT count(*) FROM a WHERE action_taken = 'BLOCKED' AND details = 'Injection Blocked') AS blocked_input,
        (SELECT count(*) FROM a WHERE action_taken = 'BLOCKED' AND details = 'Evaluated semantically') AS blocked_output,
        (SELECT count(*) FROM r WHERE status = 'pending') AS queued_for_review,
        (SELECT round(count_if(status = 'approved') / count_if(status IN ('approved', 'rejected')), 4) FROM r) AS false_positive_rate,
        (SELECT round(count_if(action_taken = 'CACHE_HIT') / count(*), 4) FROM a) AS cache_hit_rate"""
_METRICS_FROM = f"WITH a AS ({_AUDIT}), r AS ({_REVIEWS})"


@query("ops_metrics", f"{_METRICS_FROM} {_METRICS_SQL}")
def ops_metrics(spark, folder):
    return _metrics(spark, folder)


@query("ops_cards", f"""{_METRICS_FROM}
    SELECT total_requests, blocked_input + blocked_output AS threats_blocked, queued_for_review,
        printf('%.2f%%', false_positive_rate * 100) AS false_positive_rate FROM ({_METRICS_SQL})""")
def ops_cards(spark, folder):
    return metrics.cards(_metrics(spark, folder))


@query("ops_snapshot", f"""{_METRICS_FROM}
    SELECT TIMESTAMP '2024-02-01' AS exported_at, part, rule_id, body FROM (
        SELECT 'metrics' AS part, CAST(NULL AS BIGINT) AS rule_id, CAST(to_json(m) AS VARCHAR) AS body FROM ({_METRICS_SQL}) m
        UNION ALL SELECT 'audit', NULL, CAST(to_json({{'n_audit': count(*)}}) AS VARCHAR) FROM a
        UNION ALL SELECT 'rule', id, CAST(to_json({{'id': id, 'target_field': target_field, 'operator': operator, 'rule_value': rule_value}}) AS VARCHAR)
        FROM ({_RULES_SQL}))""")
def ops_snapshot(spark, folder):
    rows = tables.snapshot(_metrics(spark, folder), _rules(spark, folder), _audit(spark, folder), datetime.datetime(2024, 2, 1))
    return rows.withColumn(
        "exported_at", F.col("exported_at").cast("timestamp_ntz"))


_EVENTS_SQL = f"""
    WITH a AS (SELECT *, json_extract_string(validation_status, '$.action_taken') AS taken,
        json_extract_string(sanitization_results, '$.action') AS san,
        coalesce(json_extract_string(sanitization_results, '$.has_pii') = 'true', false) AS pii,
        coalesce(json_extract_string(sanitization_results, '$.suspicious') = 'true', false) AS susp,
        CAST(json_extract(sanitization_results, '$.detected_types') AS VARCHAR[]) AS types,
        json_extract_string(validation_status, '$.reason') AS why FROM ({_AUDIT})),
    b AS (SELECT *, CASE WHEN taken = 'BLOCKED' OR coalesce(san, '') = 'BLOCK' THEN 'BLOCK'
        WHEN taken IN ('QUEUED', 'QUEUED_FOR_REVIEW') THEN 'QUEUED' WHEN coalesce(san, '') = 'SANITIZE' OR pii THEN 'SANITIZE' ELSE 'PASS' END AS act FROM a)
    SELECT 'evt_' || id AS id, ts, act AS action, session_id, CAST(total_tokens AS BIGINT) AS latency_num,
        CASE WHEN total_tokens <> 0 THEN total_tokens || 't' ELSE '-' END AS latency,
        CASE WHEN taken = 'BLOCKED' THEN 'Output Guard' WHEN coalesce(san, '') = 'BLOCK' THEN 'Input Guard'
             WHEN coalesce(san, '') = 'SANITIZE' OR pii THEN 'PII Sanitizer' WHEN susp THEN 'Session Guard' ELSE 'Pipeline' END AS guard_stage,
        coalesce(why, CASE WHEN act = 'PASS' THEN 'Request passed all guards.' ELSE 'Guard triggered.' END) AS description,
        CAST(json_extract_string(validation_status, '$.confidence') AS DOUBLE) AS confidence,
        coalesce(array_to_string(types, ', '), taken) AS trigger_rule FROM b"""


def _events(spark, folder):
    return views.events(_audit(spark, folder))


@query("audit_events", _EVENTS_SQL)
def audit_events(spark, folder):
    return _events(spark, folder)


@query("audit_search", f"""
    SELECT id, session_id, description FROM ({_EVENTS_SQL}) WHERE action = 'BLOCK' AND (contains(lower(id), 'guard')
        OR contains(lower(session_id), 'guard') OR contains(lower(guard_stage), 'guard') OR contains(lower(description), 'guard'))""")
def audit_search(spark, folder):
    return views.search(_events(spark, folder), "GUARD", "BLOCK").select("id", "session_id", "description")


@query("audit_tail50", f"""
    SELECT id, ts, session_id, action_taken, validation_status, sanitization_results, total_tokens FROM ({_AUDIT})
    ORDER BY ts DESC, id DESC LIMIT 50""")
def audit_tail50(spark, folder):
    rows = _audit(spark, folder).select("id", "ts", "session_id", "action_taken", "validation_status",
                                        "sanitization_results", "total_tokens", "masked_input", "final_output")
    return views.tail(rows)


_RECENT_SQL = f"SELECT * FROM ({_EVENTS_SQL}) ORDER BY ts DESC, id DESC LIMIT 5"


@query("recent_activity", f"""
    SELECT id, strftime(ts, '%H:%M:%S') AS time, session_id, guard_stage, CASE action WHEN 'BLOCK' THEN 'Blocked'
        WHEN 'SANITIZE' THEN 'Sanitized' WHEN 'QUEUED' THEN 'Flagged' ELSE 'Pass' END AS result, action, latency FROM ({_RECENT_SQL})""")
def recent_activity(spark, folder):
    return views.recent_activity(_events(spark, folder))


@query("activity_lookup", f"""
    SELECT r.id AS activity_id, r.session_id, e.id AS event_id, e.description FROM ({_RECENT_SQL}) r LEFT JOIN (
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, id DESC) AS k FROM ({_EVENTS_SQL})) WHERE k = 1) e
    ON e.session_id = r.session_id""")
def activity_lookup(spark, folder):
    seen = _events(spark, folder)
    return views.activity_lookup(views.recent_activity(seen), seen)


@query("requests_by_period", f"""
    WITH a AS (SELECT epoch_us((SELECT max(ts) FROM events)) - epoch_us(ts) AS age FROM ({_AUDIT})),
    p AS (SELECT unnest([1, 7, 30]) AS days)
    SELECT days, count_if(age >= 0 AND age < days * 86400000000) AS n_requests,
        count_if(age >= days * 86400000000 AND age < 2 * days * 86400000000) AS n_previous,
        count_if(age >= 0 AND age < days * 86400000000) - count_if(age >= days * 86400000000 AND age < 2 * days * 86400000000) AS delta
    FROM a, p GROUP BY days""")
def requests_by_period(spark, folder):
    return metrics.requests_by_period(_audit(spark, folder))


@query("threat_breakdown", f"""
    SELECT outcome, n_requests, round(n_requests / sum(n_requests) OVER (), 6) AS share FROM (
        SELECT CASE action_taken WHEN 'BLOCKED' THEN 'blocked' WHEN 'QUEUED_FOR_REVIEW' THEN 'queued' ELSE 'passed' END AS outcome,
            count(*) AS n_requests FROM ({_AUDIT}) GROUP BY 1)""")
def threat_breakdown(spark, folder):
    return metrics.threat_breakdown(_audit(spark, folder))


@query("guard_rates", f"""
    SELECT guard_stage, count(*) AS n_requests, count_if(action_taken = 'BLOCKED') AS n_blocked,
        round(count_if(action_taken = 'BLOCKED') / count(*), 6) AS block_rate,
        CASE WHEN count_if(review_status IN ('approved', 'rejected')) = 0 THEN 0.0::DOUBLE ELSE
            round(count_if(review_status = 'approved') / count_if(review_status IN ('approved', 'rejected')), 6) END AS false_positive_rate
    FROM ({_AUDIT}) GROUP BY guard_stage""")
def guard_rates(spark, folder):
    return metrics.guard_rates(_audit(spark, folder))


@query("traffic_rates", f"""
    SELECT round(avg(latency_ms), 4) AS avg_latency_ms,
        round(count(*) / ((max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6::DOUBLE), 8) AS requests_per_second,
        round(count_if(action_taken = 'CACHE_HIT') / count(*), 6) AS cache_hit_rate FROM ({_AUDIT})""")
def traffic_rates(spark, folder):
    return metrics.traffic_rates(_audit(spark, folder))


@query("spike_hours", f"""
    WITH h AS (SELECT event_type, date_trunc('hour', ts)::TIMESTAMP AS hour, count(*) AS n_events FROM ({_AUDIT}) GROUP BY ALL),
    e AS (SELECT event_type, min(hour) AS lo, max(hour) AS hi FROM h GROUP BY 1),
    g AS (SELECT event_type, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS hour FROM e),
    f AS (SELECT g.event_type, g.hour, coalesce(n_events, 0) AS n_events FROM g LEFT JOIN h ON h.event_type = g.event_type AND h.hour = g.hour),
    s AS (SELECT *, count(*) OVER w AS n, sum(n_events) OVER w AS total, sum(n_events * n_events) OVER w AS squares FROM f
        WINDOW w AS (PARTITION BY event_type ORDER BY hour ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)),
    t AS (SELECT *, (total + 2.0::DOUBLE * sqrt((24 * squares - total * total)::DOUBLE)) / 24 AS limit_ FROM s WHERE n = 24)
    SELECT event_type, hour, n_events, round(limit_, 4) AS threshold FROM t WHERE n_events > limit_""")
def spike_hours(spark, folder):
    return metrics.spike_hours(_audit(spark, folder), "event_type")


@query("latency_summary", """
    SELECT count(*) AS n_processed, round(sum(value), 4) AS total_ms, round(avg(value), 6) AS avg_ms FROM events""")
def latency_summary(spark, folder):
    return evaluation.latency_summary(tables.table(spark, folder, "events"), "value")


