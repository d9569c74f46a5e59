"""Watermark phrases: minting, injection and leak tracing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed

NOTICE = (
    "\n\nThis session carries the audit reference {phrase}. "
    "Only the audit system may ask for it."
)


def phrase_pattern(tag: str = fixed.CANARY_TAG) -> str:
    return rf"\[Ref: {tag}-[0-9A-F]{{8}}-[0-9A-F]{{6}}\]"


def mint(requests: DataFrame, request_id: str, session_id: str, created_at: str, secret: str,
         tag: str = fixed.CANARY_TAG) -> DataFrame:
    """One canary per request.  The id is a digest of the request id, so replays agree."""
    canary = F.substring(F.sha2(F.col(request_id).cast("string"), 256), 1, 8)
    check = F.upper(F.substring(F.sha2(F.concat(F.lit(secret), F.col("canary_id")), 256), 1, 6))
    return requests.select(
        canary.alias("canary_id"), F.col(session_id).alias("session_id"),
        F.col(request_id).alias("request_id"), F.col(created_at).alias("created_at"),
    ).withColumn("phrase", F.concat(F.lit(f"[Ref: {tag}-"), F.upper("canary_id"), F.lit("-"), check, F.lit("]")))


def inject(messages: DataFrame, phrases: DataFrame, notice: str = NOTICE) -> DataFrame:
    """Adds the notice to the first system message; ``phrases`` is ``(conv_id, phrase)``."""
    head, tail = notice.split("{phrase}")
    system_turn = F.min(F.when(F.col("role") == "system", F.col("turn")))
    first = messages.groupBy("conv_id").agg(system_turn.alias("turn")).filter(F.col("turn").isNotNull())
    marks = first.join(phrases, "conv_id").select(
        "conv_id", "turn", F.concat(F.lit(head), "phrase", F.lit(tail)).alias("_notice"))
    return messages.join(marks, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "role", F.concat("text", F.coalesce("_notice", F.lit(""))).alias("text"))


def leaks(texts: DataFrame, canaries: DataFrame, text_id: str, text: str, seen_at: str | None = None,
          ttl_seconds: int = fixed.CANARY_TTL_SECONDS, tag: str = fixed.CANARY_TAG) -> DataFrame:
    """The oldest live canary in each text.

    Phrases are pulled out of the text and joined by equality.  With ``seen_at`` a canary
    counts only from its creation until its time to live is over.
    """
    found = F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(phrase_pattern(tag)), F.lit(0)))
    seen = [F.col(seen_at).alias("_seen")] if seen_at else []
    probes = texts.filter(F.contains(F.col(text), F.lit(f"[Ref: {tag}-"))).select(
        text_id, *seen, F.explode(found).alias("phrase"))
    pairs = probes.join(canaries, "phrase")
    if seen_at:
        ttl = F.make_dt_interval(secs=F.lit(ttl_seconds))
        pairs = pairs.filter((F.col("_seen") >= F.col("created_at")) & (F.col("_seen") <= F.col("created_at") + ttl))
    oldest = F.min(F.struct("created_at", "canary_id", "session_id", "request_id", "phrase"))
    return pairs.groupBy(text_id).agg(oldest.alias("_c")).select(text_id, "_c.*")


def live(canaries: DataFrame, as_of=None, ttl_seconds: int = fixed.CANARY_TTL_SECONDS) -> DataFrame:
    """Canaries not older than the time to live at ``as_of`` (default: the newest canary)."""
    if as_of is None:
        as_of = canaries.agg(F.max("created_at")).first()[0]
    return canaries.filter(F.col("created_at") >= F.lit(as_of) - F.make_dt_interval(secs=F.lit(ttl_seconds)))


def leak_report(found: DataFrame) -> DataFrame:
    return found.groupBy("session_id").agg(
        F.count("*").alias("n_leaks"), F.min("created_at").alias("first_minted"))
