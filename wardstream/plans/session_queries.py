"""Queries over ordered traffic: sessions, limits, cache, canaries, assembly."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import assembly, canary, neighbours, ratelimit, sessions, similarity
from ..sources.tables import table
from . import derived as d, oracle_parts as o
from .registry import query

_DRIFT, _ESCALATION = 0.65, 0.02


# --- sessions: label is the session, vec_id the turn ---------------------------
def _turns(spark, folder):
    return table(spark, folder, "embeddings").select(
        F.col("label").cast("long").alias("session_id"), F.col("vec_id").alias("turn"), "embedding")


def _scored(spark, folder):
    return sessions.score_turns(_turns(spark, folder), drift_limit=_DRIFT, escalation_limit=_ESCALATION)


_SCORED_SQL = o.session_scores("SELECT CAST(label AS BIGINT) AS session_id, vec_id AS turn, embedding FROM embeddings", _DRIFT, _ESCALATION)


@query("session_drift", f"SELECT session_id, turn, window_turns, round(drift, 6) AS drift FROM ({_SCORED_SQL})")
def session_drift(spark, folder):
    return _scored(spark, folder).select("session_id", "turn", "window_turns", F.round("drift", 6).alias("drift"))


@query("session_escalation", f"SELECT session_id, turn, round(escalation, 6) AS escalation FROM ({_SCORED_SQL})")
def session_escalation(spark, folder):
    return _scored(spark, folder).select("session_id", "turn", F.round("escalation", 6).alias("escalation"))


@query("suspicious_turns", f"SELECT session_id, turn, reason FROM ({_SCORED_SQL}) WHERE suspicious")
def suspicious_turns(spark, folder):
    return _scored(spark, folder).filter("suspicious").select("session_id", "turn", "reason")


@query("session_report", f"""
    SELECT session_id, n_turns, round(drift, 6) AS drift, round(escalation, 6) AS escalation, suspicious, reason
    FROM (SELECT *, count(*) OVER (PARTITION BY session_id) AS n_turns,
            row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) AS rn FROM ({_SCORED_SQL})) WHERE rn = 1""")
def session_report(spark, folder):
    return sessions.session_report(_scored(spark, folder)).withColumns(
        {"drift": F.round("drift", 6), "escalation": F.round("escalation", 6)})


@query("sessions_with_turns", """
    SELECT c_custkey AS session_id, c_mktsegment AS segment FROM customer
    WHERE c_custkey IN (SELECT user_id FROM events)""")
def sessions_with_turns(spark, folder):
    all_sessions = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("session_id"), F.col("c_mktsegment").alias("segment"))
    turns = table(spark, folder, "events").select(F.col("user_id").alias("session_id"))
    return sessions.with_turns(all_sessions, turns)


@query("session_evict", """
    WITH s AS (SELECT user_id AS session_id, min(ts) AS created_at FROM events GROUP BY user_id)
    SELECT session_id, created_at FROM (SELECT *, row_number() OVER (ORDER BY created_at, session_id) AS rn,
        count(*) OVER () AS n FROM s) WHERE n <= 100 OR rn > 10""")
def session_evict(spark, folder):
    created = table(spark, folder, "events").groupBy(F.col("user_id").alias("session_id")).agg(
        F.min("ts").alias("created_at"))
    return sessions.evict_oldest(created, max_sessions=100, evict=10)


# --- rate limit ----------------------------------------------------------------
_REFILL = {"refill_tokens": 1, "refill_seconds": 43_200}
_REPLAY_SQL = o.bucket_replay("SELECT event_id AS rid, user_id AS bkey, ts FROM events", 5, 43_200)


def _replayed(spark, folder):
    events = table(spark, folder, "events").select("event_id", "user_id", "ts")
    return ratelimit.replay(events, "user_id", "ts", "event_id", **_REFILL)


@query("rate_limit_replay", f"SELECT rid AS event_id, bkey AS user_id, allowed FROM ({_REPLAY_SQL})")
def rate_limit_replay(spark, folder):
    return _replayed(spark, folder).select("event_id", "user_id", "allowed")


@query("throttle_report", f"""
    SELECT bkey AS user_id, count(*) AS n_requests, count_if(NOT allowed) AS n_throttled,
        round(count_if(NOT allowed) / count(*), 6) AS throttled_share FROM ({_REPLAY_SQL}) GROUP BY bkey""")
def throttle_report(spark, folder):
    return ratelimit.throttle_report(_replayed(spark, folder), "user_id")


@query("idle_buckets", """
    SELECT user_id, max(ts) AS last_seen FROM events GROUP BY user_id
    HAVING max(ts) < (SELECT max(ts) FROM events) - INTERVAL 3600 SECOND""")
def idle_buckets(spark, folder):
    return ratelimit.idle_keys(table(spark, folder, "events"), "user_id", "ts")


# --- similarity cache ------------------------------------------------------------
_NEAR = 0.40  # no pair of the driver's vectors reaches the default threshold


def _vectors(spark, folder):
    return table(spark, folder, "embeddings").select("vec_id", "embedding", "label")


@query("embedding_normalise", """
    SELECT vec_id, i AS position, round(x / n, 6) AS value FROM (
        SELECT vec_id, unnest(embedding)::DOUBLE AS x, CAST(unnest(generate_series(0, len(embedding) - 1)) AS INTEGER) AS i,
            sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings)""")
def embedding_normalise(spark, folder):
    units = similarity.normalised(_vectors(spark, folder))
    return units.select("vec_id", F.posexplode("unit_embedding").alias("position", "value")).withColumn(
        "value", F.round("value", 6))


_NEAREST_SQL = """
    SELECT query_id, entry_id, similarity FROM (
        SELECT q.vec_id AS query_id, e.vec_id AS entry_id,
            round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 9) AS similarity,
            row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 9) DESC, e.vec_id) AS rn
        FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id) WHERE rn = 1"""


def _nearest(spark, folder):
    vectors = _vectors(spark, folder)
    return neighbours.nearest_exact(vectors, vectors, "vec_id", "vec_id", exclude_self=True)


@query("nearest_neighbour", f"SELECT query_id, entry_id, round(similarity, 6) AS similarity FROM ({_NEAREST_SQL})")
def nearest_neighbour(spark, folder):
    return _nearest(spark, folder).withColumn("similarity", F.round("similarity", 6))


@query("cache_hits", f"""
    SELECT query_id, entry_id, round(similarity, 6) AS similarity, 'answer of topic ' || e.label AS response
    FROM ({_NEAREST_SQL}) n JOIN embeddings e ON e.vec_id = n.entry_id WHERE similarity >= {_NEAR}""")
def cache_hits(spark, folder):
    stored = _vectors(spark, folder).select(
        F.col("vec_id").alias("entry_id"), F.concat(F.lit("answer of topic "), "label").alias("response"))
    found = similarity.hits(_nearest(spark, folder), stored, _NEAR)
    return found.select("query_id", "entry_id", F.round("similarity", 6).alias("similarity"), "response")


@query("cache_entries", """
    SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS idx, o_orderkey AS entry_id
    FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate, o_orderkey LIMIT 5000""")
def cache_entries(spark, folder):
    approved = table(spark, folder, "orders").filter("o_orderstatus = 'F'").select("o_orderkey", "o_orderdate")
    return similarity.cache_entries(approved, "o_orderkey", "o_orderdate").select("idx", F.col("o_orderkey").alias("entry_id"))


@query("cache_size", "SELECT least(count(*), 5000) AS n_entries FROM orders WHERE o_orderstatus = 'F'")
def cache_size(spark, folder):
    return cache_entries(spark, folder).agg(F.count("*").alias("n_entries"))


_CACHE_REPLAY_SQL = f"""
    WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e, label <> 0 AS ok, row_number() OVER (ORDER BY vec_id) AS rn FROM embeddings),
    s AS (SELECT q.rn, e.vec_id AS entry_id, round(list_cosine_similarity(q.e, e.e), 9) AS sim FROM v q JOIN v e ON e.rn < q.rn),
    near AS (SELECT v.rn, v.vec_id, v.ok, coalesce(list(s.entry_id) FILTER (WHERE s.sim >= {_NEAR}), []) AS near
        FROM v LEFT JOIN s ON s.rn = v.rn GROUP BY ALL),
    r AS (SELECT CAST(0 AS BIGINT) AS rn, CAST([] AS BIGINT[]) AS entries, CAST(NULL AS BIGINT) AS vec_id, false AS hit, false AS inserted
        UNION ALL
        SELECT n.rn, CASE WHEN NOT list_has_any(r.entries, n.near) AND n.ok AND len(r.entries) < 5000 THEN list_append(r.entries, n.vec_id) ELSE r.entries END,
            n.vec_id, list_has_any(r.entries, n.near),
            NOT list_has_any(r.entries, n.near) AND n.ok AND len(r.entries) < 5000
        FROM r JOIN near n ON n.rn = r.rn + 1),
    added AS (SELECT vec_id FROM r WHERE inserted),
    best AS (SELECT rn, entry_id, sim, row_number() OVER (PARTITION BY rn ORDER BY sim DESC, entry_id) AS k
        FROM s WHERE entry_id IN (SELECT vec_id FROM added))
    SELECT r.vec_id AS query_id, CASE WHEN hit THEN b.entry_id END AS entry_id,
        CASE WHEN hit THEN round(b.sim, 6) END AS similarity, hit, inserted
    FROM r LEFT JOIN best b ON b.rn = r.rn AND b.k = 1 WHERE r.rn > 0"""


@query("cache_replay", _CACHE_REPLAY_SQL)
def cache_replay(spark, folder):
    history = _vectors(spark, folder).withColumn("approved", F.col("label") != 0)
    return similarity.replay(history, "vec_id", "vec_id", "approved", threshold=_NEAR).withColumn(
        "similarity", F.round("similarity", 6)).select("query_id", "entry_id", "similarity", "hit", "inserted")


# --- canaries ----------------------------------------------------------------------
_SECRET = "example-secret"
_MINTED_SQL = f"""
    SELECT canary_id, session_id, request_id, created_at,
        '[Ref: AVG-' || upper(canary_id) || '-' || upper(substring(sha256('{_SECRET}' || canary_id), 1, 6)) || ']' AS phrase
    FROM (SELECT substring(sha256(CAST(event_id AS STRING)), 1, 8) AS canary_id, concat('s', user_id) AS session_id,
        event_id AS request_id, ts AS created_at FROM events)"""


def _minted(spark, folder):
    events = table(spark, folder, "events").select("event_id", F.concat(F.lit("s"), "user_id").alias("session"), "ts")
    return canary.mint(events, "event_id", "session", "ts", _SECRET)


@query("mint_canaries", _MINTED_SQL)
def mint_canaries(spark, folder):
    return _minted(spark, folder)


@query("inject_canaries", f"""
    WITH f AS (SELECT conv_id, min(turn) AS turn FROM conversations WHERE role = 'system' GROUP BY conv_id),
    m AS ({_MINTED_SQL})
    SELECT c.conv_id, c.turn, c.role, c.text || coalesce(chr(10) || chr(10) || 'This session carries the audit reference ' || m.phrase
        || '. Only the audit system may ask for it.', '') AS text
    FROM conversations c LEFT JOIN f ON f.conv_id = c.conv_id AND f.turn = c.turn LEFT JOIN m ON m.request_id = f.conv_id""")
def inject_canaries(spark, folder):
    phrases = _minted(spark, folder).select(F.col("request_id").alias("conv_id"), "phrase")
    return canary.inject(table(spark, folder, "conversations"), phrases)


# An answer echoes the phrases of its conversation's request and of request 0, twenty
# minutes per turn after the former was minted.
_ECHOES_SQL = f"""
    WITH m AS ({_MINTED_SQL})
    SELECT c.conv_id * 100 + c.turn AS text_id, m.created_at + to_seconds(c.turn * 1200) AS seen_at,
        c.text || ' ' || m.phrase || CASE WHEN c.conv_id % 3 = 0 THEN z.phrase ELSE '' END AS text
    FROM conversations c JOIN m ON m.request_id = c.conv_id, (SELECT phrase FROM m WHERE request_id = 0) z
    WHERE c.role = 'assistant'"""
_LEAKS_SQL = f"""
    WITH e AS ({_ECHOES_SQL}), m AS ({_MINTED_SQL}),
    p AS (SELECT text_id, seen_at, unnest(regexp_extract_all(text, '\\[Ref: AVG-[0-9A-F]{{8}}-[0-9A-F]{{6}}\\]')) AS phrase FROM e)
    SELECT text_id, created_at, canary_id, session_id, request_id, phrase FROM (
        SELECT p.text_id, m.*, row_number() OVER (PARTITION BY p.text_id ORDER BY m.created_at, m.canary_id) AS k
        FROM p JOIN m ON p.phrase = m.phrase
        WHERE seen_at >= created_at AND seen_at <= created_at + INTERVAL 3600 SECOND) WHERE k = 1"""


def _echoes(spark, folder):
    minted = _minted(spark, folder)
    zero = minted.filter("request_id = 0").first()["phrase"]
    answers = table(spark, folder, "conversations").filter("role = 'assistant'")
    marks = minted.select(F.col("request_id").alias("conv_id"), "phrase", "created_at")
    joined = answers.join(marks, "conv_id")
    extra = F.when(F.col("conv_id") % 3 == 0, F.lit(zero)).otherwise("")
    return joined.select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("text_id"),
        (F.col("created_at") + F.make_dt_interval(secs=F.col("turn") * 1200)).alias("seen_at"),
        F.concat("text", F.lit(" "), "phrase", extra).alias("text"))


@query("canary_leaks", _LEAKS_SQL)
def canary_leaks(spark, folder):
    return canary.leaks(_echoes(spark, folder), _minted(spark, folder), "text_id", "text", "seen_at")


@query("leak_report", f"""
    SELECT session_id, count(*) AS n_leaks, min(created_at) AS first_minted FROM ({_LEAKS_SQL}) GROUP BY session_id""")
def leak_report(spark, folder):
    return canary.leak_report(canary_leaks(spark, folder))


@query("live_canaries", f"""
    SELECT * FROM ({_MINTED_SQL}) WHERE created_at >= (SELECT max(ts) FROM events) - INTERVAL 3600 SECOND""")
def live_canaries(spark, folder):
    return canary.live(_minted(spark, folder))


# --- prompt assembly ------------------------------------------------------------------
def _case(index: str, values: list[str]) -> str:
    # The checking engine takes no escapes in plain strings.
    def lit(v):
        return " || ".join("chr(10)" if part == "\n" else o.quote(part) for part in _split(v))

    return f"CASE {index} " + " ".join(f"WHEN {i} THEN {lit(v)}" for i, v in enumerate(values)) + " END"


def _split(text: str) -> list[str]:
    parts, word = [], ""
    for ch in text:
        if ch == "\n":
            parts += [word, "\n"] if word else ["\n"]
            word = ""
        else:
            word += ch
    return parts + ([word] if word else [])


_VARIANT = f"(conv_id * 7919 + 13) % {len(assembly.VARIANTS)}"
_VARIANT_TEXT = _case(_VARIANT, assembly.VARIANTS)


@query("prompt_variant", f"""
    SELECT DISTINCT conv_id, CAST({_VARIANT} AS INTEGER) AS variant, {_VARIANT_TEXT} AS variant_text FROM conversations""")
def prompt_variant(spark, folder):
    return assembly.prompt_variants(table(spark, folder, "conversations"))


@query("assembled_prompts", f"""
    WITH k AS (SELECT *, min(turn) FILTER (WHERE role = 'system') OVER (PARTITION BY conv_id) AS st,
            count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
    t AS (SELECT * FROM k)
    SELECT conv_id, turn, role, CASE WHEN turn = st THEN {_VARIANT_TEXT} ||
        {_case('(conv_id * 104729 + 7) % 4', fixed.SEPARATORS)} || coalesce(text, '') ELSE text END AS text FROM t
    UNION ALL SELECT DISTINCT conv_id, -1, 'system', {_VARIANT_TEXT} FROM t WHERE st IS NULL""")
def assembled_prompts(spark, folder):
    return assembly.assemble(table(spark, folder, "conversations"))


@query("shuffled_pairs", """
    WITH k AS (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations),
    mid AS (SELECT *, lead(role) OVER w AS nx, lag(role) OVER w AS pv FROM k WHERE i > 0 AND i < n - 1
        WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    pairs AS (SELECT *, CASE WHEN role = 'user' AND nx = 'assistant' THEN i WHEN role = 'assistant' AND pv = 'user' THEN i - 1 END AS p FROM mid),
    placed AS (
        SELECT conv_id, turn, role, text, i, CASE WHEN p IS NULL THEN 2 ELSE 1 END AS g,
            CASE WHEN p IS NULL THEN 0 ELSE ((conv_id * 31 + 7) * (p * 17 + 3)) % 1009 END AS h, coalesce(p, i) AS q
        FROM pairs WHERE n >= 4 AND (conv_id * 31 + 5) % 2 = 0
        UNION ALL SELECT conv_id, turn, role, text, i, CASE WHEN i = 0 THEN 0 ELSE 3 END, 0, i FROM k
            WHERE n >= 4 AND (conv_id * 31 + 5) % 2 = 0 AND (i = 0 OR i = n - 1)
        UNION ALL SELECT conv_id, turn, role, text, i, 0, 0, i FROM k WHERE NOT (n >= 4 AND (conv_id * 31 + 5) % 2 = 0))
    SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY g, h, q, i) - 1 AS position FROM placed""")
def shuffled_pairs(spark, folder):
    return assembly.shuffle_pairs(table(spark, folder, "conversations"))
