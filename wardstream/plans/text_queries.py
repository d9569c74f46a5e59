"""Queries over texts: personal data, normalisation, injection, language."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed, injection, text as textfn
from ..functions.verdicts import judge_fields
from ..operators import guards, language, privacy, screening, validation
from ..sources.tables import spread, table
from . import derived as d, oracle_parts as o
from .registry import query

# --- personal data -----------------------------------------------------------
_PII_SQL = o.pii_steps(d.sql(d.pii_texts), "text", fixed.PII_PATTERNS)


def _pii(spark, folder):
    return privacy.redact(d.load(spark, folder, d.pii_texts), "text")


@query("pii_redact", f"SELECT doc_id, redacted FROM ({_PII_SQL})")
def pii_redact(spark, folder):
    return _pii(spark, folder).select("doc_id", "redacted")


@query("pii_types", f"SELECT doc_id, array_to_string(redacted_types, ',') AS pii_types, len(redacted_types) > 0 AS has_pii FROM ({_PII_SQL})")
def pii_types(spark, folder):
    return _pii(spark, folder).select("doc_id", F.array_join("redacted_types", ",").alias("pii_types"), "has_pii")


@query("pii_counts", f"SELECT doc_id, redacted_count AS n_matches, redacted_made AS n_replaced FROM ({_PII_SQL})")
def pii_counts(spark, folder):
    return _pii(spark, folder).select(
        "doc_id", F.col("redacted_count").alias("n_matches"), F.col("redacted_made").alias("n_replaced"))


@query("pii_route", f"SELECT doc_id, {o.route('redacted_types')} AS pii_route FROM ({_PII_SQL})")
def pii_route(spark, folder):
    return _pii(spark, folder).select("doc_id", "pii_route")


@query("pii_incidence", f"""
    SELECT source, lang, pii_type, count(*) AS n_rows
    FROM (SELECT source, lang, unnest(redacted_types) AS pii_type FROM ({_PII_SQL})) GROUP BY ALL""")
def pii_incidence(spark, folder):
    return privacy.incidence(_pii(spark, folder), "doc_id", ["source", "lang"])


def _hits_sql() -> str:
    kinds = ", ".join(
        f"CASE WHEN list_contains(redacted_types, '{k}') THEN {{'kind': '{k}', 'n': len(regexp_extract_all(text, {o.quote(o.re2(p))}))}} END"
        for k, p in fixed.PII_PATTERNS.items())
    return f"""
    WITH f AS (SELECT source, lang, redacted_count, [{kinds}] AS hits FROM ({_PII_SQL}) WHERE len(redacted_types) > 0),
    e AS (SELECT source, lang, h.kind AS pii_type, h.n AS n FROM (SELECT source, lang, unnest(hits) AS h FROM f) WHERE h IS NOT NULL
        UNION ALL SELECT source, lang, 'any', redacted_count FROM f)
    SELECT CASE GROUPING(source, lang) WHEN 0 THEN 'source,lang' WHEN 1 THEN 'source' WHEN 2 THEN 'lang' ELSE 'all' END AS level,
        source, lang, pii_type, count(*) AS n_rows, CAST(sum(n) AS BIGINT) AS n_hits
    FROM e GROUP BY GROUPING SETS ((pii_type, source, lang), (pii_type, source), (pii_type, lang), (pii_type))"""


@query("pii_hits", _hits_sql())
def pii_hits(spark, folder):
    return privacy.hit_levels(_pii(spark, folder), "text", ["source", "lang"])


@query("pii_redact_library")
def pii_redact_library(spark, folder):
    """The lookarounds of this list have no counterpart in the checking SQL."""
    df = privacy.redact(d.load(spark, folder, d.pii_texts), "text", fixed.PII_LIBRARY_PATTERNS)
    return df.select("doc_id", "redacted", F.array_join("redacted_types", ",").alias("pii_types"),
                     F.col("redacted_made").alias("n_replaced"))


_PAGE_PII_SQL = o.pii_steps("SELECT page_id, html FROM pages", "html", fixed.PII_PATTERNS)


@query("pii_pages", f"""
    SELECT page_id, redacted, array_to_string(redacted_types, ',') AS pii_types,
        redacted_count AS n_matches FROM ({_PAGE_PII_SQL})""")
def pii_pages(spark, folder):
    df = privacy.redact(spread(table(spark, folder, "pages").select("page_id", "html")), "html")
    return df.select("page_id", "redacted", F.array_join("redacted_types", ",").alias("pii_types"),
                     F.col("redacted_count").alias("n_matches"))


# --- normalisation -----------------------------------------------------------
_NORM_SQL = o.normalised(d.sql(d.prompts), "prompt")


def _screened(spark, folder):
    return screening.screen(d.load(spark, folder, d.prompts))


@query("norm_screen", f"""
    SELECT doc_id, norm_text, array_to_string(norm_encodings, ',') AS encodings, norm_homoglyph,
        array_to_string(norm_keywords, ',') AS keywords FROM ({_NORM_SQL})""")
def norm_screen(spark, folder):
    return _screened(spark, folder).select(
        "doc_id", "norm_text", F.array_join("norm_encodings", ",").alias("encodings"), "norm_homoglyph",
        F.array_join("norm_keywords", ",").alias("keywords"))


@query("norm_risk", f"SELECT doc_id, norm_risk FROM ({_NORM_SQL})")
def norm_risk(spark, folder):
    return _screened(spark, folder).select("doc_id", "norm_risk")


@query("encoding_attack_rows", f"SELECT doc_id, norm_reason, norm_risk FROM ({_NORM_SQL}) WHERE norm_blocked")
def encoding_attack_rows(spark, folder):
    return screening.blocked_rows(_screened(spark, folder)).select("doc_id", "norm_reason", "norm_risk")


@query("norm_summary_by_lang", f"""
    SELECT lang, count(*) AS n_prompts, count_if(len(norm_encodings) > 0) AS n_encoded,
        count_if(norm_homoglyph) AS n_homoglyph, count_if(len(norm_keywords) > 0) AS n_keyword,
        count_if(norm_blocked) AS n_blocked, round(avg(norm_risk), 6) AS avg_risk
    FROM ({_NORM_SQL}) GROUP BY lang""")
def norm_summary_by_lang(spark, folder):
    return screening.summary(_screened(spark, folder), "lang")


@query("keyword_hits", f"""
    SELECT keyword, count(*) AS n_prompts
    FROM (SELECT unnest({o.keyword_list('prompt')}) AS keyword FROM ({d.sql(d.prompts)})) GROUP BY keyword""")
def keyword_hits(spark, folder):
    return screening.keyword_hits(d.load(spark, folder, d.prompts))


@query("page_entities")
def page_entities(spark, folder):
    """Entity decoding over raw pages; the checking SQL has no such function."""
    pages = spread(table(spark, folder, "pages").select("page_id", "html"))
    decoded = textfn.decode_once(pages, "html", "decoded")
    return decoded.select("page_id", F.col("decoded_kind").alias("kind"), F.length("decoded").alias("n_chars"))


# --- injection ---------------------------------------------------------------
@query("indirect_injection", f"""
    SELECT page_id, marker FROM (SELECT page_id, {o.indirect_marker('html')} AS marker
    FROM ({d.sql(d.pages_planted)})) WHERE marker IS NOT NULL""")
def indirect_injection(spark, folder):
    pages = d.load(spark, folder, d.pages_planted)
    return pages.select("page_id", injection.indirect_marker(F.col("html")).alias("marker")).filter("marker is not null")


@query("multilang_injection", f"""
    SELECT doc_id, tag FROM (SELECT doc_id, {o.multilang('prompt')} AS tag
    FROM ({d.sql(d.prompts)})) WHERE tag IS NOT NULL""")
def multilang_injection(spark, folder):
    prompts = d.load(spark, folder, d.prompts)
    return prompts.select("doc_id", injection.multilang_hit(F.col("prompt")).alias("tag")).filter("tag is not null")


@query("classifier_gate", f"""
    SELECT id, CASE WHEN clf_label = 'INJECTION' AND clf_score > 0.7 THEN 'ESCALATE' ELSE 'PASS' END AS decision
    FROM ({d.sql(d.requests)})""")
def classifier_gate(spark, folder):
    requests = d.load(spark, folder, d.requests)
    return requests.select("id", guards.classifier_gate(F.col("clf_label"), F.col("clf_score")).alias("decision"))


_GUARDED_SQL = o.input_guard(o.normalised(d.sql(d.requests), "prompt"), "norm_text", "prompt")


@query("input_guard", f"SELECT id, in_action, in_reason, in_confidence, in_prompt, in_types, in_count FROM ({_GUARDED_SQL})")
def input_guard(spark, folder):
    screened = screening.screen(d.load(spark, folder, d.requests))
    return guards.input_guard(screened, "norm_text", "prompt").select(
        "id", "in_action", "in_reason", "in_confidence", "in_prompt", F.array_join("in_types", ",").alias("in_types"), "in_count")


_WORDS_SQL = "regexp_extract_all(lower(text), '[\\p{L}]+')"
_PROFILE_SQL = f"""
    words AS (SELECT doc_id, lang, unnest({_WORDS_SQL}) AS word FROM documents),
    counts AS (SELECT lang, word, count(*) AS n FROM words GROUP BY ALL),
    ranked AS (SELECT lang AS tag, word, n / sum(n) OVER (PARTITION BY lang) AS weight,
        row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS r FROM counts),
    scored AS (SELECT doc_id, tag, round(sum(weight), 9) AS score FROM words JOIN ranked USING (word) WHERE r <= 200 GROUP BY ALL),
    best AS (SELECT doc_id, tag FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, tag) AS k FROM scored) WHERE k = 1),
    tagged AS (SELECT d.doc_id, d.lang, coalesce(b.tag, 'unknown') AS tag FROM documents d LEFT JOIN best b ON d.doc_id = b.doc_id)"""


def _tagged(spark, folder):
    docs = spread(table(spark, folder, "documents").select("doc_id", "lang", "text"))
    return language.tag(docs, language.profiles(docs, "text", "lang"), "doc_id", "text")


@query("lang_tag", f"WITH {_PROFILE_SQL} SELECT doc_id, tag FROM tagged")
def lang_tag(spark, folder):
    return _tagged(spark, folder).select("doc_id", "tag")


@query("lang_tag_accuracy", f"""WITH {_PROFILE_SQL}
    SELECT lang, count(*) AS n_texts, count_if(tag = lang) AS n_correct,
        round(count_if(tag = lang) / count(*), 6) AS accuracy FROM tagged GROUP BY lang""")
def lang_tag_accuracy(spark, folder):
    return language.accuracy(_tagged(spark, folder), "lang")


# --- conversations -----------------------------------------------------------
_LIMITS = {"max_messages": 6, "max_system": 200, "max_message": 600, "max_total": 1500}


@query("conv_shape_check", """
    WITH m AS (SELECT *, CASE WHEN role IS NULL OR role NOT IN ('user', 'assistant', 'system') THEN 'invalid_role'
            WHEN text IS NULL THEN 'invalid_content'
            WHEN length(text) > CASE WHEN role = 'system' THEN 200 ELSE 600 END THEN 'message_too_long' END AS fault
        FROM conversations),
    s AS (SELECT conv_id, count(*) AS n_messages, CAST(sum(coalesce(length(text), 0)) AS BIGINT) AS n_chars,
            arg_min(fault, turn) FILTER (WHERE fault IS NOT NULL) AS fault, arg_min(role, turn) AS first_role,
            count_if(role = 'system') AS systems FROM m GROUP BY conv_id)
    SELECT conv_id, n_messages, n_chars, CASE WHEN n_messages > 6 THEN 'too_many_messages' WHEN fault IS NOT NULL THEN fault
        WHEN n_chars > 1500 THEN 'input_too_long' WHEN first_role = 'assistant' THEN 'starts_with_assistant'
        WHEN systems > 1 THEN 'multiple_system_messages' END AS violation FROM s""")
def conv_shape_check(spark, folder):
    return validation.shape_check(table(spark, folder, "conversations"), **_LIMITS)


@query("latest_user_turn", """
    SELECT conv_id, max(turn) FILTER (WHERE role = 'user') AS turn, arg_max(text, turn) FILTER (WHERE role = 'user') AS text
    FROM conversations GROUP BY conv_id""")
def latest_user_turn(spark, folder):
    return validation.latest_user_turn(table(spark, folder, "conversations"))


_LATEST_SQL = o.pii_steps(
    "SELECT conv_id, arg_max(text, turn) FILTER (WHERE role = 'user') AS text FROM conversations GROUP BY conv_id",
    "text", fixed.PII_PATTERNS)


@query("masked_conversations", f"""
    SELECT c.conv_id, c.turn, c.role, CASE WHEN c.role = 'user' THEN l.redacted ELSE c.text END AS text
    FROM conversations c LEFT JOIN ({_LATEST_SQL}) l ON c.conv_id = l.conv_id""")
def masked_conversations(spark, folder):
    return validation.masked_conversations(table(spark, folder, "conversations"))


@query("truncate_outputs", """
    SELECT conv_id, turn, CASE WHEN length(text) > 300 THEN substring(text, 1, 300) || ' [cut]' ELSE text END AS text,
        length(text) > 300 AS was_truncated FROM conversations WHERE role = 'assistant'""")
def truncate_outputs(spark, folder):
    return validation.truncated(table(spark, folder, "conversations"), 300, " [cut]")


@query("message_lists", """
    SELECT conv_id, CAST(floor(turn / 6) AS BIGINT) AS block, count(*) AS n_messages,
        string_agg(role || '=' || text, '|' ORDER BY turn, role, text) AS messages FROM conversations GROUP BY 1, 2""")
def message_lists(spark, folder):
    lists = validation.message_lists(table(spark, folder, "conversations"), 6)
    joined = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit("="), m["content"])), "|")
    return lists.select("conv_id", "block", "n_messages", joined.alias("messages"))


# --- judge text --------------------------------------------------------------
@query("judge_verdicts", f"""
    WITH b AS (SELECT id, CASE WHEN regexp_extract(judge, '(?s)\\{{.*\\}}', 0) <> '' THEN regexp_extract(judge, '(?s)\\{{.*\\}}', 0) ELSE judge END AS body
        FROM ({d.sql(d.judge_texts)})),
    v AS (SELECT id, CASE WHEN json_valid(body) THEN body END AS js FROM b)
    SELECT id, js IS NOT NULL AS valid,
        CASE WHEN js IS NULL THEN 'BLOCK' WHEN json_extract_string(js, '$.action') IN ('PASS', 'BLOCK', 'SANITIZE')
            THEN json_extract_string(js, '$.action') ELSE 'REVIEW' END AS action,
        CASE WHEN js IS NULL THEN 'judge output is not valid JSON' ELSE coalesce(json_extract_string(js, '$.reason'), '') END AS reason,
        CASE WHEN js IS NULL THEN 0.0::DOUBLE ELSE coalesce(TRY_CAST(json_extract_string(js, '$.confidence') AS DOUBLE), 1.0::DOUBLE) END AS confidence
    FROM v""")
def judge_verdicts(spark, folder):
    texts = d.load(spark, folder, d.judge_texts)
    return texts.select("id", *[c.alias(n) for n, c in judge_fields(F.col("judge")).items()])
