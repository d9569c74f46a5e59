"""Queries over the staged verdicts: audit, stage traces, evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.verdicts import status_verdict
from ..operators import evaluation, requests, review, scoring, views
from ..session import cut_lineage
from ..sources.tables import table
from . import derived as d, oracle_parts as o
from .registry import query
from .rule_queries import _LIMITS_SQL, _limits

# Answers of the test tables have at most 24 characters; this limit cuts some of them.
_MAX_OUTPUT = 20
# The driver's texts share few words, so the limits of a session are set to values that some
# requests reach and others do not.
_SETTINGS = requests.Settings(
    cache_threshold=0.90, drift_limit=1.0, escalation_limit=0.02, max_output=_MAX_OUTPUT,
    bucket={"capacity": 3, "refill_tokens": 1, "refill_seconds": 600})


def _verdicts(spark, folder):
    history = d.load(spark, folder, d.requests).withColumn("canary_id", F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 8))
    stored = d.load(spark, folder, d.requests).filter("id % 3 = 0").select(F.col("id").alias("entry_id"), "prompt")
    return requests.verdicts(history, stored, _limits(spark, folder), _SETTINGS)


def _verdict_sql() -> str:
    base = f"""SELECT * EXCLUDE (prompt, text), substring(sha256(CAST(id AS STRING)), 1, 8) AS canary_id,
        CASE WHEN length(text) > {_MAX_OUTPUT} THEN substring(text, 1, {_MAX_OUTPUT}) || chr(10) || chr(10) || '[Output truncated]' ELSE text END AS text,
        CASE WHEN length(prompt) > 4000 THEN 'message_too_long' END AS violation,
        CASE WHEN length(prompt) <= 4000 THEN prompt END AS raw_prompt FROM ({d.sql(d.requests)})"""
    limited = o.bucket_replay(
        "SELECT id AS rid, session_id AS bkey, ts FROM screened WHERE violation IS NULL AND NOT norm_blocked", 3, 600)
    vecs = o.text_vectors("SELECT id, norm_text FROM screened WHERE violation IS NULL AND NOT norm_blocked", "id", "norm_text")
    entries = o.text_vectors(f"SELECT id AS entry_id, prompt FROM ({d.sql(d.requests)}) WHERE id % 3 = 0 ORDER BY id LIMIT 5000", "entry_id", "prompt")
    found = """SELECT k.id, coalesce(max(CASE WHEN e.entry_id < k.id THEN round(list_cosine_similarity(k.e, e.e), 9) END) >= 0.9, false) AS cache_hit
        FROM known k LEFT JOIN entries e ON true GROUP BY k.id"""
    scored = o.session_scores(
        "SELECT session_id, k.id AS turn, k.e AS embedding FROM known k JOIN lookups l ON l.id = k.id WHERE NOT l.cache_hit", 1.0, 0.02)
    joined = """SELECT s.*, l.allowed, c.cache_hit, t.suspicious, t.reason AS session_reason,
            s.violation IS NULL AND NOT s.norm_blocked AND coalesce(l.allowed, true) AND NOT coalesce(c.cache_hit, false) AND NOT coalesce(t.suspicious, false) AS alive
        FROM screened s LEFT JOIN limited l ON l.rid = s.id LEFT JOIN lookups c ON c.id = s.id LEFT JOIN scored t ON t.turn = s.id"""
    guarded = o.input_guard("SELECT *, CASE WHEN alive THEN norm_text END AS guarded FROM joined", "guarded", "raw_prompt")
    answers = """SELECT *, CASE WHEN alive AND in_action NOT IN ('BLOCK', 'REVIEW') AND llm_available THEN text END AS answer FROM guarded"""
    amounts = o.amount_rows("SELECT id, answer FROM answers WHERE answer IS NOT NULL", "id", "answer")
    final = o.output_guard("SELECT * FROM answers", o.first_violation(amounts, _LIMITS_SQL, "id"), "id")
    gate = "CASE WHEN {c} > 0.45 AND {c} < 0.75 THEN 'QUEUED_FOR_REVIEW' ELSE 'BLOCKED' END"
    stages = [  # condition, stage, action, reason
        ("violation IS NOT NULL", "'shape'", "'REJECTED'", "violation"),
        ("norm_blocked", "'normalise'", "'BLOCKED'", "'Encoding attack: ' || norm_reason"),
        ("NOT coalesce(allowed, true)", "'rate_limit'", "'RATE_LIMITED'", "'Rate limit exceeded'"),
        ("coalesce(cache_hit, false)", "'cache'", "'CACHE_HIT'", "'Served from cache'"),
        ("coalesce(suspicious, false)", "'session'", "'BLOCKED'", "session_reason"),
        ("in_action = 'BLOCK'", "'input'", gate.format(c="in_confidence"), "in_reason"),
        ("in_action = 'REVIEW'", "'input'", "'QUEUED_FOR_REVIEW'", "in_reason"),
        ("NOT llm_available", "'llm'", "'LLM_UNAVAILABLE'", "'LLM service unavailable'"),
        ("out_action = 'BLOCK'", "'output'", gate.format(c="out_confidence"), "out_reason"),
        ("out_action = 'REVIEW'", "'output'", "'QUEUED_FOR_REVIEW'", "out_reason"),
        ("canary_leak", "'done'", "'CANARY_LEAK_FLAGGED'", "'Canary phrase in the answer'"),
        ("true", "'done'", "'PASSED'", "'Cleared all semantic guards'"),
    ]

    def case(i: int) -> str:
        return "CASE " + " ".join(f"WHEN {s[0]} THEN {s[i]}" for s in stages) + " END"

    return f"""WITH screened AS ({o.normalised(base, 'raw_prompt')}), limited AS ({limited}),
        vecs AS ({vecs}), entries AS ({entries}),
        known AS (SELECT l.rid AS id, l.bkey AS session_id, v.e FROM limited l JOIN vecs v ON v.id = l.rid WHERE l.allowed),
        lookups AS ({found}), scored AS ({scored}), joined AS ({joined}), guarded AS ({guarded}), answers AS ({answers}),
        final AS ({final}),
        staged AS (SELECT *, {case(1)} AS stage, {case(2)} AS action_taken, {case(3)} AS reason FROM final),
        verdicts AS (SELECT *, CASE action_taken WHEN 'REJECTED' THEN 400 WHEN 'BLOCKED' THEN 403 WHEN 'RATE_LIMITED' THEN 429
            WHEN 'QUEUED_FOR_REVIEW' THEN 202 WHEN 'LLM_UNAVAILABLE' THEN 503 ELSE 200 END AS status FROM staged)"""


_VERDICTS = _verdict_sql()


@query("request_verdict", f"{_VERDICTS} SELECT id, session_id, stage, status, action_taken, reason FROM verdicts")
def request_verdict(spark, folder):
    return _verdicts(spark, folder).select("id", "session_id", "stage", "status", "action_taken", "reason")


@query("audit_labels", f"{_VERDICTS} SELECT stage, action_taken, count(*) AS n_requests FROM verdicts GROUP BY ALL")
def audit_labels(spark, folder):
    return _verdicts(spark, folder).groupBy("stage", "action_taken").agg(F.count("*").alias("n_requests"))


@query("audit_rows", f"""{_VERDICTS},
    f AS (SELECT id, ts, CASE WHEN stage IN ('llm', 'output', 'done') THEN in_prompt ELSE norm_text END AS masked_prompt,
        stage IN ('llm', 'output', 'done') AND in_action = 'SANITIZE' AS redacted,
        CASE stage WHEN 'normalise' THEN 'Encoding Attack Detected' WHEN 'session' THEN 'Session Guard triggered'
            WHEN 'input' THEN 'Injection Blocked' WHEN 'cache' THEN 'Served from cache' WHEN 'llm' THEN 'LLM service unavailable'
            ELSE CASE WHEN action_taken = 'CANARY_LEAK_FLAGGED' THEN 'Canary leak detected in LLM output' ELSE 'Evaluated semantically' END END AS details,
        action_taken, reason, CASE action_taken WHEN 'PASSED' THEN text WHEN 'CANARY_LEAK_FLAGGED' THEN text
            WHEN 'QUEUED_FOR_REVIEW' THEN 'queued' WHEN 'CACHE_HIT' THEN 'cached' ELSE 'blocked' END AS final_output,
        CAST(CASE WHEN action_taken IN ('PASSED', 'CANARY_LEAK_FLAGGED') THEN length(text) ELSE 0 END AS INTEGER) AS total_tokens, canary_id
        FROM verdicts WHERE action_taken NOT IN ('REJECTED', 'RATE_LIMITED'))
    SELECT id, ts, CAST(json_array(json_object('role', 'user', 'content', masked_prompt)) AS VARCHAR) AS masked_input,
        CAST(json_object('redacted', redacted, 'details', details) AS VARCHAR) AS sanitization_results,
        CAST(json_object('is_valid', action_taken IN ('PASSED', 'CANARY_LEAK_FLAGGED', 'CACHE_HIT'), 'action_taken', action_taken, 'reason', reason) AS VARCHAR) AS validation_status,
        CAST(json_object('content', final_output) AS VARCHAR) AS final_output, total_tokens, canary_id FROM f""")
def audit_rows(spark, folder):
    return views.audit_rows(requests.audit_fields(_verdicts(spark, folder)))


@query("review_rows", f"""{_VERDICTS}
    SELECT id, ts AS created_at, session_id, CASE WHEN stage = 'output' THEN in_prompt ELSE norm_text END AS masked_prompt,
        CASE WHEN stage = 'output' THEN text ELSE '' END AS llm_response, stage AS guard_stage,
        CASE WHEN stage = 'output' THEN out_confidence ELSE in_confidence END AS guard_score, reason AS guard_reason, 'pending' AS status
    FROM verdicts WHERE action_taken = 'QUEUED_FOR_REVIEW'""")
def review_rows(spark, folder):
    return review.queued(_verdicts(spark, folder))


_STAGE_LIST = ["Input Validation", *views.STAGES]
_ENDS = {"shape": 0, "normalise": 1, "rate_limit": 2, "cache": 2, "session": 2, "input": 3, "llm": 4, "output": 6}
_END_SQL = "CASE stage " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in _ENDS.items()) + " ELSE 7 END"


@query("stage_trace", f"""{_VERDICTS}
    SELECT id, CAST(i AS INTEGER) AS stage_no, {_STAGE_LIST}[i + 1] AS stage,
        CASE WHEN i < last THEN 'pass' WHEN i > last OR stage IN ('rate_limit', 'cache') THEN 'skip' WHEN status = 202 THEN 'warn' ELSE 'block' END AS outcome
    FROM (SELECT id, status, stage, {_END_SQL} AS last FROM verdicts), generate_series(0, 6) g(i)""")
def stage_trace(spark, folder):
    return views.stage_trace(_verdicts(spark, folder))


@query("status_verdict", f"""{_VERDICTS}
    SELECT id, CASE status WHEN 200 THEN 'PASS' WHEN 403 THEN 'BLOCK' WHEN 202 THEN 'QUEUED' WHEN 400 THEN 'REJECTED'
        WHEN 429 THEN 'RATE_LIMIT' WHEN 503 THEN 'ERROR' END AS verdict, substring(reason, 1, 120) AS detail FROM verdicts""")
def status_verdict_query(spark, folder):
    return _verdicts(spark, folder).select(
        "id", status_verdict(F.col("status")).alias("verdict"), F.substring("reason", 1, 120).alias("detail"))


_TALLIES_SQL = """count_if(verdict = 'PASS') AS n_passed, count_if(verdict IN ('BLOCK', 'REJECTED', 'RATE_LIMIT')) AS n_blocked,
    count_if(verdict <> 'PASS') AS n_failed, count(*) AS n_total, epoch_ms(max(ts)) - epoch_ms(min(ts)) AS wall_ms"""


@query("scenario_summary", f"""{_VERDICTS},
    labelled AS MATERIALIZED (SELECT id, ts, stage, {d.category("id", "violation")} AS category,
        CASE status WHEN 200 THEN 'PASS' WHEN 403 THEN 'BLOCK' WHEN 202 THEN 'QUEUED' WHEN 400 THEN 'REJECTED'
            WHEN 429 THEN 'RATE_LIMIT' WHEN 503 THEN 'ERROR' END AS verdict FROM verdicts),
    placed AS (SELECT *, row_number() OVER (PARTITION BY category, block ORDER BY id, verdict) - 1 AS place
        FROM (SELECT *, CAST(floor(id / {evaluation.LIST_SIZE}) AS BIGINT) AS block FROM labelled))
    SELECT 'run' AS level, CAST(NULL AS VARCHAR) AS category, CAST(NULL AS VARCHAR) AS stage, CAST(NULL AS BIGINT) AS block,
        CAST(NULL AS BIGINT) AS part, {_TALLIES_SQL}, CAST(NULL AS VARCHAR) AS verdicts FROM labelled
    UNION ALL SELECT 'category', category, NULL, NULL, NULL, {_TALLIES_SQL}, NULL FROM labelled GROUP BY category
    UNION ALL SELECT 'stage', NULL, stage, NULL, NULL, {_TALLIES_SQL}, NULL FROM labelled GROUP BY stage
    UNION ALL SELECT 'verdicts', category, NULL, block, CAST(floor(place / {evaluation.LIST_SIZE}) AS BIGINT), {_TALLIES_SQL},
        string_agg(verdict, ',' ORDER BY place) FROM placed GROUP BY ALL""")
def scenario_summary(spark, folder):
    labelled = _verdicts(spark, folder).select(
        "id", "ts", "stage", F.expr(d.category("id", "violation")).alias("category"), status_verdict(F.col("status")).alias("verdict"))
    # Counts and lists read a narrow table instead of deciding every request again.
    rows = evaluation.run_summary(cut_lineage(labelled), "category", "stage", "id")
    return rows.withColumn("verdicts", F.array_join("verdicts", ","))


# --- evaluation -------------------------------------------------------------------
def _labelled(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text", "source")
    return evaluation.labelled(docs, table(spark, folder, "labels"), "doc_id", "text", "toxic")


def _log(spark, folder):
    return evaluation.evaluation_log(
        _labelled(spark, folder).select("doc_id", "is_malicious"), _verdicts(spark, folder).withColumnRenamed("id", "doc_id"), "doc_id")


_LOG_SQL = """SELECT l.doc_id, l.toxic = 1 AS ground_truth, coalesce(v.status = 403, false) AS blocked, v.reason,
    CASE WHEN v.status IS NULL THEN 'no verdict' WHEN v.status = 503 THEN 'unavailable' END AS error
    FROM labels l LEFT JOIN verdicts v ON v.id = l.doc_id"""
_COUNTS_SQL = """count_if(error IS NULL AND NOT ground_truth AND NOT blocked) AS tn, count_if(error IS NULL AND NOT ground_truth AND blocked) AS fp,
    count_if(error IS NULL AND ground_truth AND NOT blocked) AS fn, count_if(error IS NULL AND ground_truth AND blocked) AS tp,
    count_if(error IS NOT NULL) AS n_errors"""


@query("labelled_prompts", "SELECT doc_id, text AS prompt, toxic AS is_malicious FROM documents JOIN labels USING (doc_id)")
def labelled_prompts(spark, folder):
    return _labelled(spark, folder)


@query("evaluation_log", f"{_VERDICTS} {_LOG_SQL}")
def evaluation_log(spark, folder):
    return _log(spark, folder)


@query("confusion_matrix", f"{_VERDICTS} SELECT {_COUNTS_SQL} FROM ({_LOG_SQL})")
def confusion_matrix(spark, folder):
    return evaluation.confusion_matrix(_log(spark, folder))


@query("detection_quality", f"""{_VERDICTS}
    SELECT source, CASE WHEN tp + fp = 0 THEN 0.0::DOUBLE ELSE round(tp / (tp + fp), 6) END AS precision,
        CASE WHEN tp + fn = 0 THEN 0.0::DOUBLE ELSE round(tp / (tp + fn), 6) END AS recall,
        CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0::DOUBLE ELSE round(2 * tp / (2 * tp + fp + fn), 6) END AS f1
    FROM (SELECT source, {_COUNTS_SQL} FROM ({_LOG_SQL}) g JOIN documents d ON d.doc_id = g.doc_id GROUP BY source)""")
def detection_quality(spark, folder):
    sources = table(spark, folder, "documents").select("doc_id", "source")
    return evaluation.detection_quality(_log(spark, folder).join(sources, "doc_id"), ["source"])


def _sample_sql(n: int) -> str:
    return f"""
        WITH p AS (SELECT doc_id, toxic AS is_malicious, row_number() OVER (PARTITION BY toxic ORDER BY md5(CAST(doc_id AS STRING)), doc_id) AS rn
            FROM documents JOIN labels USING (doc_id)),
        c AS (SELECT least(count_if(is_malicious = 1), count_if(is_malicious = 0)) AS smallest FROM p)
        SELECT doc_id, is_malicious FROM p, c WHERE smallest < {n} OR rn <= {n}"""


@query("balanced_sample", _sample_sql(40))
def balanced_sample(spark, folder):
    return evaluation.balanced_sample(_labelled(spark, folder).select("doc_id", "is_malicious"), "doc_id", 40)


@query("balanced_sample_fallback", _sample_sql(500))
def balanced_sample_fallback(spark, folder):
    """At the small scales a class has fewer than 500 rows, so every row is kept."""
    rows = evaluation.balanced_sample(_labelled(spark, folder).select("doc_id", "is_malicious"), "doc_id", 500)
    return evaluation.shuffled(rows, "doc_id")


@query("trained_scores")
def trained_scores(spark, folder):
    """A classifier trained on the labelled texts; scores differ in the last digits between runs."""
    rows = _labelled(spark, folder)
    return scoring.apply(scoring.train(rows), rows).select("doc_id", "clf_label", F.round("clf_score", 4).alias("clf_score"))
