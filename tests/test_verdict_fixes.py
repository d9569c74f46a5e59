"""Rows that used to vanish, jobs that used to die, and verdicts that were traced to the wrong stage."""

from __future__ import annotations

import datetime

import numpy as np
from pyspark.sql import functions as F

from wardstream.functions import money, pii
from wardstream.operators import assembly, guards, ratelimit, rules, similarity, views


def test_digits_of_other_scripts(spark):
    card = "".join(chr(0x966 + int(c)) if c.isdigit() else c for c in "card 4532-1234-5678-9012")
    got = pii.redact(spark.createDataFrame([(card,)], "t string"), "t").first()
    assert got.redacted_types == ["credit_card"]
    amounts = spark.createDataFrame([("refund of $१०० or $20",), ("none",)], "t string").select(money.amounts(F.col("t")).alias("a")).collect()
    assert [r.a for r in amounts] == [[100.0, 20.0], []]


def test_requests_without_a_key_share_a_bucket(spark):
    at = datetime.datetime(2024, 1, 1)
    rows = [(i, None if i % 2 else "s", at) for i in range(8)]
    df = spark.createDataFrame(rows, "id long, k string, ts timestamp")
    for capacity in (2, 10):  # both ways to join
        got = {r.id: r.allowed for r in ratelimit.replay(df, "k", "ts", "id", capacity=capacity).collect()}
        assert got == {i: i // 2 < capacity for i in range(8)}


def test_a_full_cache_skips_later_entries(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(5001)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    found = similarity.nearest(df.filter("id = 5000"), df, "id", "id", "id").first()
    unit = np.array([v for _, v in rows])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    assert found.entry_id == int(np.argmax(np.round(unit[:5000] @ unit[5000], 9)))


def test_long_conversations_are_assembled_whole(spark):
    df = spark.range(5000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.lit("t").alias("text"))
    assert assembly.assemble(df).count() == 5001
    got = assembly.shuffle_pairs(df, always=True)
    assert got.count() == 5000 and got.select("position").distinct().count() == 5000


def test_trace_ends_at_the_deciding_stage(spark):
    rows = [(1, "output", 403, "limit broken"), (2, "session", 403, "escalation"), (3, "input", 202, "unsure"), (4, "done", 200, "ok"), (5, "cache", 200, "x")]
    df = spark.createDataFrame(rows, "id long, stage string, status int, reason string")
    got = {(r.id, r.stage_no): r.outcome for r in views.stage_trace(df).collect()}
    assert [got[1, i] for i in range(7)] == ["pass"] * 6 + ["block"]
    assert [got[2, i] for i in range(4)] == ["pass", "pass", "block", "skip"]
    assert got[3, 3] == "warn" and got[3, 4] == "skip" and {got[4, i] for i in range(7)} == {"pass"} and got[5, 2] == "skip"


def test_unreadable_confidence_and_missing_policy(spark):
    row = ("1", datetime.datetime(2024, 1, 1), "s", '{"confidence": "high"}', '{"action_taken": "PASSED"}', 3)
    audit = spark.createDataFrame([row], "id string, ts timestamp, session_id string, sanitization_results string, validation_status string, total_tokens int")
    assert views.events(audit).first().confidence is None
    answers = spark.createDataFrame([(None, 0.9, "PASS", None, 1.0)],
                                    "rule_reason string, contra_score double, out_judge_action string, out_judge_reason string, out_judge_confidence double")
    assert guards.output_guard(answers, F.lit(False)).first().out_action == "PASS"
    assert guards.output_guard(answers, F.lit(True)).first().out_action == "BLOCK"


def test_rules_without_field_are_rejected_and_promoted_ones_have_ids(spark):
    schema = "id long, target_field string, operator string, rule_value double, description string"
    got = rules.ingest(spark.createDataFrame([(1, None, "<=", 1.0, "d"), (2, "refund", None, 1.0, "d")], schema)).orderBy("id").collect()
    assert [r.rejected_because for r in got] == ["target_field", "operator"]
    suggestions = spark.createDataFrame([(7, "refund", "<=", 5.0, "d")], "id long, target_field string, operator string, suggested_value double, description string")
    decisions = spark.createDataFrame([(7, "approved")] * 2, "id long, status string")
    added = rules.promote(spark.createDataFrame([], schema), suggestions, decisions).collect()
    assert [(r.id, r.source_suggestion) for r in added] == [(-8, 7)]
