"""Business rules: ingest, evaluation, and rules learned from blocked answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, money
from ..functions.bind import bind
from .skew import lookup_join

RULE_BLOCK = 1_000  # rules per array
BROADCAST_BLOCKS = 100


def ingest(rules: DataFrame) -> DataFrame:
    """Adds ``rejected_because`` (NULL when accepted); the description comes out trimmed."""
    value = F.col("rule_value")
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    trimmed = F.btrim("description", F.lit(fixed.WHITESPACE))
    reason = (
        F.when(~F.coalesce(F.col("target_field").rlike(fixed.RULE_FIELD_PATTERN), F.lit(False)), "target_field")
        .when(~F.coalesce(F.col("operator").isin(*fixed.RULE_OPERATORS), F.lit(False)), "operator")
        .when(~finite, "rule_value")
        .when(F.length(trimmed) > fixed.MAX_DESCRIPTION_CHARS, "description")
    )
    return rules.withColumns({"description": trimmed, "rejected_because": reason})


def accepted(ingested: DataFrame) -> DataFrame:
    return ingested.filter(F.col("rejected_because").isNull()).drop("rejected_because")


def delete(rules: DataFrame, deletions: DataFrame) -> DataFrame:
    return rules.join(deletions.select("id"), "id", "left_anti")


def extracted_amounts(responses: DataFrame, row_id: str, text: str) -> DataFrame:
    """One row per amount with its position in pattern order."""
    return responses.select(row_id, F.posexplode(money.amounts(F.col(text))).alias("position", "amount"))


def _rule_blocks(rules: DataFrame) -> tuple[DataFrame, int]:
    """Numeric rules packed by id into arrays of bounded length, and the number of blocks."""
    numeric = rules.filter(F.col("operator").isin(*fixed.NUMERIC_OPERATORS)).select(
        F.col("id").cast("long").alias("id"), "operator", F.col("rule_value").cast("double").alias("rule_value"),
        F.coalesce("description", F.lit("")).alias("description"))
    n = numeric.count()
    if n <= RULE_BLOCK:
        placed = numeric.withColumn("_block", F.lit(0))
    else:
        # Blocks only have to be small and keep whole rules; hashing the id does both.
        placed = numeric.withColumn("_block", F.pmod(F.xxhash64("id"), F.lit(-(-n // RULE_BLOCK))).cast("int"))
    packed = F.array_sort(F.collect_list(F.struct("id", "operator", "rule_value", "description")))
    return placed.groupBy("_block").agg(packed.alias("_rules")), max(1, -(-n // RULE_BLOCK))


def _against_rules(rows: DataFrame, rules: DataFrame, spread: str) -> DataFrame:
    blocks, n_blocks = _rule_blocks(rules)
    targets = rows.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    if n_blocks <= BROADCAST_BLOCKS:
        return targets.join(F.broadcast(blocks), "_block")
    return lookup_join(targets, blocks, ["_block"], "inner", F.col(spread), max_rows=BROADCAST_BLOCKS)


def violations(responses: DataFrame, rules: DataFrame, row_id: str, text: str) -> DataFrame:
    """Every (amount, rule) pair that breaks the rule, whatever field the rule names."""
    found = _against_rules(extracted_amounts(responses, row_id, text), rules, row_id)
    broken = F.filter("_rules", lambda r: money.violates(r["operator"], F.col("amount"), r["rule_value"]))
    return found.select(row_id, "position", "amount", F.inline(broken)).withColumnRenamed("id", "rule_id")


def first_violations(responses: DataFrame, rules: DataFrame, row_id: str, text: str) -> DataFrame:
    """The first broken rule per response, in (rule, amount) order.

    An operator is broken by some amount exactly when it is broken by the smallest or
    the largest one, so a response is tested once per rule, not once per amount.
    """
    found = _first_in_block(_against_rules(_with_extremes(responses.select(row_id, text), text), rules, row_id))
    first = F.min(F.struct("_v.id", "_v.amount", "_v.description"))
    return found.filter(F.col("_v").isNotNull()).groupBy(row_id).agg(first.alias("_v")).select(
        row_id, F.col("_v.id").alias("rule_id"), "_v.amount", "_v.description", _reason("_v").alias("reason"))


def _with_extremes(responses: DataFrame, text: str) -> DataFrame:
    found = bind(responses, "_amounts", money.amounts(F.col(text)))
    return found.withColumns({"_low": F.array_min("_amounts"), "_high": F.array_max("_amounts")})


def _first_in_block(rows: DataFrame) -> DataFrame:
    """Adds ``_v``: the first rule of ``_rules`` that the amounts break, with the first such amount."""
    def broken(r):
        return money.violates(r["operator"], F.col("_low"), r["rule_value"]) | money.violates(
            r["operator"], F.col("_high"), r["rule_value"])

    hit = F.get(F.filter("_rules", broken), F.lit(0))
    rows = bind(rows, "_hit", F.when(F.size("_amounts") > 0, hit))
    amount = F.get(F.filter("_amounts", lambda a: money.violates(F.col("_hit.operator"), a, F.col("_hit.rule_value"))), F.lit(0))
    first = F.struct("_hit.id", amount.alias("amount"), "_hit.description")
    return rows.withColumn("_v", F.when(F.col("_hit").isNotNull(), first)).drop("_hit", "_low", "_high", "_amounts", "_rules")


def _reason(violation: str) -> Column:
    return F.concat(F.lit("Deterministic rule violation: "), F.col(f"{violation}.description"))


def with_violation(responses: DataFrame, rules: DataFrame, row_id: str, text: str) -> DataFrame:
    """Adds ``rule_reason``, NULL where no rule is broken.

    Up to one array of rules is broadcast to the responses as they stand: no shuffle.
    """
    blocks, n_blocks = _rule_blocks(rules)
    if n_blocks > 1:
        found = first_violations(responses, rules, row_id, text)
        return responses.join(found.select(row_id, F.col("reason").alias("rule_reason")), row_id, "left")
    rows = _with_extremes(responses, text).withColumn("_block", F.lit(0))
    tested = _first_in_block(rows.join(F.broadcast(blocks), "_block", "left"))
    return tested.withColumn("rule_reason", _reason("_v")).drop("_v", "_block")


def policy_context(rules: DataFrame, limit: int = 200) -> DataFrame:
    """The start of all descriptions joined by ``"; "``, as one text of ``limit`` characters.

    Every rule after the first adds at least the separator, so no more than
    ``limit // 2 + 1`` rules, lowest ids first, can take part.
    """
    first = rules.orderBy("id").limit(limit // 2 + 1)
    ordered = F.array_sort(F.collect_list(F.struct("id", F.coalesce("description", F.lit("")).alias("d"))))
    return first.agg(ordered.alias("_r")).select(
        F.substring(F.array_join(F.transform("_r", lambda r: r["d"]), "; "), 1, limit).alias("context"))


def policy_lines(rules: DataFrame) -> DataFrame:
    """The bullet list of the policy, one line per rule."""
    return rules.select("id", F.concat(F.lit("- "), F.coalesce("description", F.lit(""))).alias("line"))


def candidates(texts: DataFrame, row_id: str, text: str, min_confidence: float = fixed.CANDIDATE_CONFIDENCE) -> DataFrame:
    """Rule candidates in model output: complete items above the confidence limit.

    The JSON array is what lies between the first ``[`` and the last ``]``.  An item whose
    numbers do not parse is dropped alone.
    """
    body = F.regexp_extract(F.col(text), r"(?s)\[.*\]", 0)
    item = F.col("_item")
    fields = {k: F.get_json_object(item, f"$.{k}") for k in ("target_field", "operator", "description")}
    numbers = {k: F.get_json_object(item, f"$.{k}").try_cast("double") for k in ("suggested_value", "confidence")}
    rows = texts.select(row_id, F.explode(F.from_json(body, "array<string>")).alias("_item")).withColumns(
        {**fields, **numbers}).drop("_item")
    return rows.dropna(subset=[*fields, "suggested_value"]).filter(F.col("confidence") > min_confidence)


def learned(blocked: DataFrame, mined: DataFrame, log_id: str) -> DataFrame:
    """Candidates of blocked answers as pending suggestions with their source log id."""
    return mined.join(blocked.select(log_id), log_id, "left_semi").withColumnRenamed(
        log_id, "source_log_id").withColumn("status", F.lit("pending"))


def latest_status(suggestions: DataFrame, decisions: DataFrame) -> DataFrame:
    """Suggestions with their newest decided status; ``decisions`` is ``(id, status, decided_at)``."""
    newest = decisions.groupBy("id").agg(F.max(F.struct("decided_at", "status")).getField("status").alias("_status"))
    return suggestions.join(newest, "id", "left").withColumn(
        "status", F.coalesce("_status", "status")).drop("_status")


def pending(suggestions: DataFrame) -> DataFrame:
    return suggestions.filter(F.col("status") == "pending").orderBy(F.desc("confidence"), "id")


def promote(rules: DataFrame, suggestions: DataFrame, decisions: DataFrame) -> DataFrame:
    """Active rules plus one rule per suggestion approved at least once.

    A new rule has the id ``-1 - suggestion id``: it meets no older rule's, and a second
    approval adds nothing.
    """
    approved = decisions.filter(F.col("status") == "approved").select("id").distinct()
    added = suggestions.join(approved, "id", "left_semi").select(
        (-1 - F.col("id").cast("long")).alias("id"), "target_field", "operator",
        F.col("suggested_value").alias("rule_value"), "description", F.col("id").alias("source_suggestion"))
    return rules.withColumn("source_suggestion", F.lit(None).cast("long")).unionByName(added)


def uncovered(suggestions: DataFrame, rules: DataFrame) -> DataFrame:
    """Suggestions whose field no active rule names."""
    fields = rules.select("target_field").distinct()
    return suggestions.join(fields, "target_field", "left_anti")


