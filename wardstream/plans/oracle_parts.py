"""Building blocks of the checking SQL."""

from __future__ import annotations

from ..functions import fixed
from .derived import PLAIN, TURNED


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def re2(pattern: str) -> str:
    """A pattern in the checking engine's dialect: word characters beyond ASCII spelled out."""
    return pattern.replace(r"[\w.\-]", r"[\p{L}\p{N}_.\-]").replace(r"[\w.]", r"[\p{L}\p{N}_.]")


def pii_steps(source: str, text: str, patterns: dict[str, str], out: str = "redacted") -> str:
    """``source`` (a subquery) with the redacted text, types, count on the original, replacements made."""
    inner = f"SELECT *, {text} AS pt0 FROM ({source})"
    kinds = list(patterns)
    for i, kind in enumerate(kinds, 1):
        p = quote(re2(patterns[kind]))
        inner = (f"SELECT *, regexp_replace(pt{i - 1}, {p}, '[{kind.upper()}_REDACTED]', 'g') AS pt{i} FROM ({inner})")

    def hits(i: int, column: str) -> str:
        return f"CASE WHEN pt{i} <> pt{i - 1} THEN len(regexp_extract_all({column}, {quote(re2(patterns[kinds[i - 1]]))})) ELSE 0 END"

    n = range(1, len(kinds) + 1)
    types = ", ".join(f"CASE WHEN pt{i} <> pt{i - 1} THEN '{kinds[i - 1]}' END" for i in n)
    drop = ", ".join(f"pt{i}" for i in range(len(kinds) + 1))
    return (
        f"SELECT * EXCLUDE ({drop}), pt{len(kinds)} AS {out}, list_filter([{types}], lambda x: x IS NOT NULL) AS {out}_types, "
        f"CAST({' + '.join(hits(i, 'pt0') for i in n)} AS BIGINT) AS {out}_count, "
        f"CAST({' + '.join(hits(i, f'pt{i - 1}') for i in n)} AS BIGINT) AS {out}_made FROM ({inner})"
    )


def route(types: str) -> str:
    high = "[" + ", ".join(quote(t) for t in fixed.HIGH_SENSITIVITY) + "]"
    return f"CASE WHEN list_has_any({types}, {high}) THEN 'A' WHEN len({types}) > 0 THEN 'B' ELSE 'C' END"


def any_keyword(text: str) -> str:
    return "(" + " OR ".join(f"contains(lower({text}), {quote(w)})" for w in fixed.KEYWORDS) + ")"


def keyword_list(text: str) -> str:
    words = "[" + ", ".join(quote(w) for w in fixed.KEYWORDS) + "]"
    return f"list_filter({words}, lambda w: contains(lower({text}), w))"


_D = "[A-Za-z0-9+/]"
_B64 = f"^(?:=*{_D}=*{_D}=?{_D}{_D})*(?:=*{_D}=*{_D}==|=*{_D}=*{_D}=?{_D}=|=*$)"


def _chars(s: str) -> str:
    return " || ".join(f"chr({ord(c)})" for c in s)


def _decode(source: str, text: str, out: str) -> str:
    """Adds the first decoding that applies and its kind."""
    a = f"SELECT *, trim({text}, {_chars(fixed.WHITESPACE)}) AS ds FROM ({source})"
    b = (f"SELECT *, regexp_replace(ds || repeat('=', CAST((4 - length(ds) % 4) % 4 AS BIGINT)), '[^A-Za-z0-9+/=]', '', 'g') AS dc FROM ({a})")
    c = f"SELECT *, replace(nullif(regexp_extract(dc, '{_B64}', 0), ''), '=', '') AS db FROM ({b})"
    d = (f"SELECT *, CASE WHEN length(ds) = strlen(ds) THEN TRY(decode(from_base64("
         f"db || repeat('=', CAST((4 - length(db) % 4) % 4 AS BIGINT))))) END AS dd, "
         f"translate({text}, '{PLAIN}', '{TURNED}') AS dr, TRY(url_decode({text})) AS du, "
         f"replace(replace({text}, '&lt;', '<'), '&gt;', '>') AS dh FROM ({c})")
    kind = (f"CASE WHEN dd <> {text} AND length(dd) > 10 THEN 'base64' "
            f"WHEN dr <> {text} AND {any_keyword('dr')} THEN 'rot13' "
            f"WHEN contains({text}, '%') AND du <> {text} THEN 'url_encoded' "
            f"WHEN dh <> {text} THEN 'html_entity' END")
    e = f"SELECT *, {kind} AS {out}_kind FROM ({d})"
    return (f"SELECT * EXCLUDE (ds, dc, db, dd, dr, du, dh), CASE {out}_kind WHEN 'base64' THEN dd WHEN 'rot13' THEN dr "
            f"WHEN 'url_encoded' THEN du WHEN 'html_entity' THEN dh END AS {out} FROM ({e})")


def normalised(source: str, text: str) -> str:
    """The normalisation report as ``norm_*`` columns.

    The driver's texts hold no character NFKC changes and no entity but the planted ones.
    """
    two = _decode(_decode(source, text, "e1"), "e1", "e2")
    plain = f"SELECT *, coalesce(e2, e1, {text}) AS pl FROM ({two})"
    folded = (f"SELECT *, translate(regexp_replace(pl, '[\\x{{200B}}-\\x{{200F}}\\x{{2060}}\\x{{FEFF}}]', '', 'g'), "
              f"'{fixed.CYRILLIC}', '{fixed.LATIN}') AS norm_text FROM ({plain})")
    listed = (f"SELECT *, list_filter([e1_kind, e2_kind], lambda x: x IS NOT NULL) AS norm_encodings, "
              f"norm_text <> pl AS norm_homoglyph, {keyword_list('norm_text')} AS norm_keywords FROM ({folded})")
    risk = ("round(least(greatest(CASE WHEN len(norm_keywords) > 0 THEN 0.2::DOUBLE ELSE 0 END + "
            "CASE WHEN len(norm_keywords) > 0 AND e1_kind IS NOT NULL THEN 0.3::DOUBLE ELSE 0 END + "
            "CASE WHEN e2_kind IS NOT NULL THEN 0.1::DOUBLE ELSE 0 END, "
            "CASE WHEN norm_homoglyph AND len(norm_keywords) > 0 THEN 0.7::DOUBLE ELSE 0 END), 1.0::DOUBLE), 4)")
    scored = f"SELECT *, {risk} AS norm_risk FROM ({listed})"
    return (f"SELECT * EXCLUDE (e1, e2, e1_kind, e2_kind, pl), norm_risk >= {fixed.NORM_BLOCK_RISK} AS norm_blocked, "
            f"CASE WHEN norm_risk >= {fixed.NORM_BLOCK_RISK} THEN CASE WHEN len(norm_encodings) > 0 "
            f"THEN array_to_string(norm_encodings, ',') ELSE 'homoglyph' END END AS norm_reason FROM ({scored})")


def indirect_marker(text: str) -> str:
    return "CASE " + " ".join(
        f"WHEN regexp_matches({text}, {quote('(?is)' + m.replace('(?i)', ''))}) THEN {quote(m)}"
        for m in fixed.INDIRECT_MARKERS) + " END"


def multilang(text: str) -> str:
    return "CASE " + " ".join(
        "WHEN " + " OR ".join(f"contains({text}, {quote(w)})" for w in words) + f" THEN '{lang}'"
        for lang, words in fixed.MULTILANG_PHRASES.items()) + " END"


def input_guard(source: str, text: str, raw: str) -> str:
    df = pii_steps(source, text, fixed.PII_PATTERNS, "sf")
    df = (f"SELECT *, {indirect_marker(text)} AS mk, coalesce({multilang(text)}, {multilang(raw)}) AS lg, "
          f"{route('sf_types')} AS rt, coalesce(clf_label = 'INJECTION' AND clf_score > 0.7, false) AS gt FROM ({df})")
    df = f"SELECT *, (mk IS NOT NULL OR lg IS NOT NULL) AS st, (rt = 'A' OR (rt = 'C' AND gt)) AS ak FROM ({df})"
    return f"""SELECT * EXCLUDE (sf, sf_types, sf_count, sf_made, mk, lg, rt, gt, st, ak),
        CASE WHEN st THEN 'BLOCK' WHEN ak THEN coalesce(judge_action, 'BLOCK') WHEN rt = 'B' THEN 'SANITIZE' ELSE 'PASS' END AS in_action,
        CASE WHEN mk IS NOT NULL THEN 'Indirect prompt injection detected (pattern: ' || mk || ')'
             WHEN lg IS NOT NULL THEN 'Multilingual injection detected [' || lg || ']'
             WHEN ak THEN coalesce(judge_reason, 'judge unavailable')
             WHEN rt = 'B' THEN 'PII detected: ' || array_to_string(sf_types, ', ')
             ELSE 'Cleared specialized injection classifier.' END AS in_reason,
        CASE WHEN st OR NOT ak THEN 1.0::DOUBLE WHEN judge_action IS NULL THEN 0.0::DOUBLE ELSE coalesce(judge_confidence, 1.0::DOUBLE) END AS in_confidence,
        CASE WHEN st THEN '' ELSE sf END AS in_prompt,
        CASE WHEN st THEN '' ELSE array_to_string(sf_types, ',') END AS in_types,
        CASE WHEN st THEN 0 ELSE sf_count END AS in_count FROM ({df})"""


def amount_rows(source: str, row_id: str, text: str) -> str:
    """One row per amount with its position."""
    found = ", ".join(f"regexp_extract_all({text}, {quote('(?i)' + p)}, 1)" for p in fixed.AMOUNT_PATTERNS)
    return (f"SELECT {row_id}, CAST(unnest(generate_series(0, len(am) - 1)) AS INTEGER) AS position, unnest(am)::DOUBLE AS amount "
            f"FROM (SELECT {row_id}, flatten([{found}]) AS am FROM ({source})) WHERE len(am) > 0")


BROKEN = """CASE operator WHEN '<=' THEN NOT (amount <= rule_value) WHEN '>=' THEN NOT (amount >= rule_value)
    WHEN '<' THEN NOT (amount < rule_value) WHEN '>' THEN NOT (amount > rule_value)
    WHEN '==' THEN NOT (amount = rule_value) ELSE false END"""


def first_violation(amounts: str, rules: str, row_id: str) -> str:
    return f"""SELECT {row_id}, rule_id, amount, description, 'Deterministic rule violation: ' || description AS reason FROM (
        SELECT a.{row_id}, r.id AS rule_id, a.amount, r.description,
               row_number() OVER (PARTITION BY a.{row_id} ORDER BY r.id, a.position) AS rn
        FROM ({amounts}) a, ({rules}) r WHERE {BROKEN}) WHERE rn = 1"""


def output_guard(source: str, violations: str, row_id: str) -> str:
    return f"""SELECT s.*,
        CASE WHEN v.reason IS NOT NULL OR coalesce(contra_score >= 0.4, false) THEN 'BLOCK' ELSE coalesce(out_judge_action, 'BLOCK') END AS out_action,
        CASE WHEN v.reason IS NOT NULL THEN v.reason WHEN contra_score >= 0.4 THEN 'contradicts policy, score ' || printf('%.2f', contra_score)
             ELSE coalesce(out_judge_reason, 'judge unavailable') END AS out_reason,
        CASE WHEN v.reason IS NOT NULL THEN 1.0::DOUBLE WHEN contra_score >= 0.4 THEN contra_score
             WHEN out_judge_action IS NULL THEN 0.0::DOUBLE ELSE coalesce(out_judge_confidence, 1.0::DOUBLE) END AS out_confidence
        FROM ({source}) s LEFT JOIN ({violations}) v ON s.{row_id} = v.{row_id}"""


def text_vectors(source: str, row_id: str, text: str, dimensions: int = 256) -> str:
    """Signed counts of the hashed distinct words of each text, as list ``e``."""
    words = f"list_distinct(regexp_extract_all({text}, '[^\\x20\\x09-\\x0D]+'))"
    slots = f"""SELECT {row_id}, ('0x' || substring(h, 1, 4))::BIGINT % {dimensions} AS b, CASE WHEN substring(h, 5, 1) < '8' THEN 1 ELSE -1 END AS s
        FROM (SELECT {row_id}, md5(unnest({words})) AS h FROM ({source}))"""
    return f"""SELECT {row_id}, list(coalesce(v, 0)::DOUBLE ORDER BY b) AS e
        FROM (SELECT {row_id}, unnest(range({dimensions})) AS b FROM ({source}))
        LEFT JOIN (SELECT {row_id}, b, sum(s) AS v FROM ({slots}) GROUP BY ALL) USING ({row_id}, b) GROUP BY {row_id}"""


def session_scores(source: str, drift: float, escalation: float) -> str:
    """``source`` has session_id, turn, embedding."""
    return f"""SELECT *, drift > {drift} OR escalation > {escalation} AS suspicious,
        CASE WHEN drift > {drift} THEN 'topic drift ' || printf('%.2f', drift)
             WHEN escalation > {escalation} THEN 'escalation variance ' || printf('%.2f', escalation) ELSE '' END AS reason
        FROM (SELECT * EXCLUDE (e, pe, fe, sim),
            CASE WHEN window_turns < 3 THEN 0.0::DOUBLE ELSE 1 - list_cosine_similarity(fe, e) END AS drift,
            CASE WHEN window_turns < 2 THEN 0.0::DOUBLE ELSE var_pop(sim) OVER (PARTITION BY session_id ORDER BY turn ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) END AS escalation
          FROM (SELECT *, CASE WHEN pe IS NOT NULL THEN list_cosine_similarity(pe, e) END AS sim
            FROM (SELECT * EXCLUDE (embedding), embedding::DOUBLE[] AS e,
                lag(embedding::DOUBLE[]) OVER (PARTITION BY session_id ORDER BY turn) AS pe,
                first_value(embedding::DOUBLE[]) OVER (PARTITION BY session_id ORDER BY turn ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS fe,
                count(*) OVER (PARTITION BY session_id ORDER BY turn ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS window_turns
              FROM ({source}))))"""


def bucket_replay(source: str, capacity: int, seconds: int) -> str:
    """Token bucket as a recursive query over (rid, bkey, ts); one token per ``seconds``."""
    cost = seconds * 1_000_000
    full = capacity * cost
    return f"""WITH RECURSIVE o AS (
          SELECT rid, bkey, epoch_us(ts) AS us, row_number() OVER (PARTITION BY bkey ORDER BY ts, rid) AS rn FROM ({source})),
        r AS (SELECT rid, bkey, us, rn, CAST({full} - {cost} AS BIGINT) AS lvl, true AS allowed FROM o WHERE rn = 1
          UNION ALL
          SELECT o.rid, o.bkey, o.us, o.rn,
            CAST(least({full}, r.lvl + o.us - r.us) - CASE WHEN least({full}, r.lvl + o.us - r.us) >= {cost} THEN {cost} ELSE 0 END AS BIGINT),
            least({full}, r.lvl + o.us - r.us) >= {cost}
          FROM r JOIN o ON o.bkey = r.bkey AND o.rn = r.rn + 1)
        SELECT rid, bkey, allowed FROM r"""
