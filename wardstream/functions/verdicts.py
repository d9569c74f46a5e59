"""Decision columns: gates, labels and judge text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def block_outcome(confidence: Column, low: float = fixed.REVIEW_LOW,
                  high: float = fixed.REVIEW_HIGH) -> Column:
    """A block strictly between the two thresholds goes to a human."""
    queued = (confidence > low) & (confidence < high)
    return F.when(queued, F.lit("QUEUED_FOR_REVIEW")).otherwise(F.lit("BLOCKED"))


def judge_fields(text: Column) -> dict[str, Column]:
    """Judge text to ``action``, ``reason``, ``confidence``, ``valid``.

    The JSON is what lies between the first ``{`` and the last ``}``.  Text that does
    not parse blocks with confidence 0 (fail closed); an action other than the known
    ones becomes REVIEW; a missing confidence is 1.
    """
    sliced = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    body = F.when(F.length(sliced) > 0, sliced).otherwise(text)
    valid = F.coalesce(F.startswith(F.ltrim(body), F.lit("{")), F.lit(False)) & (
        F.try_parse_json(body).isNotNull()
    )
    action = F.get_json_object(body, "$.action")
    known = action.isin("PASS", "BLOCK", "SANITIZE")
    return {
        "valid": valid,
        "action": F.when(~valid, F.lit("BLOCK")).when(known, action).otherwise(F.lit("REVIEW")),
        "reason": F.when(~valid, F.lit("judge output is not valid JSON")).otherwise(
            F.coalesce(F.get_json_object(body, "$.reason"), F.lit(""))),
        "confidence": F.when(~valid, F.lit(0.0)).otherwise(
            F.coalesce(F.get_json_object(body, "$.confidence").try_cast("double"), F.lit(1.0))),
    }


def status_verdict(status: Column) -> Column:
    return (
        F.when(status == 200, "PASS").when(status == 403, "BLOCK").when(status == 202, "QUEUED")
        .when(status == 400, "REJECTED").when(status == 429, "RATE_LIMIT").when(status == 503, "ERROR")
        .otherwise(F.concat(F.lit("HTTP_"), status.cast("string")))
    )
