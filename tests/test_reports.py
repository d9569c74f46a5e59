"""Hits per type at several levels, and review rows of queued verdicts, against plain Python."""

from __future__ import annotations

import datetime
import re
from collections import defaultdict

import duckdb

import __spark_entry__ as contract
from wardstream.functions import fixed
from wardstream.operators import evaluation, privacy, review

TEXTS = [
    ("a", "en", "write to x@example.com or y@example.com"),
    ("a", "fr", "x@example.com, call 9876543210"),
    ("b", "en", "nothing 12"),
    ("b", None, "z@example.com"),
    (None, "en", "z@example.com z@example.com"),
    ("b", "en", None),
    ("b", "en", ""),
]


def test_hits_per_type_and_level(spark):
    df = spark.createDataFrame([(i, *t) for i, t in enumerate(TEXTS)], "doc_id long, source string, lang string, text string")
    redacted = privacy.redact(df, "text")
    types = {r.doc_id: r.redacted_types for r in redacted.collect()}
    want = defaultdict(lambda: [0, 0])
    for i, (source, lang, text) in enumerate(TEXTS):
        own = {k: len(re.findall(fixed.PII_PATTERNS[k], text)) for k in types[i]}
        if own:
            own["any"] = sum(own.values())
        for kind, n in own.items():
            for key in (("source,lang", source, lang), ("source", source, None), ("lang", None, lang), ("all", None, None)):
                want[(*key, kind)][0] += 1
                want[(*key, kind)][1] += n
    rows = privacy.hit_levels(redacted, "text", ["source", "lang"]).collect()
    assert len({r[:4] for r in map(tuple, rows)}) == len(rows)
    assert {(r.level, r.source, r.lang, r.pii_type): [r.n_rows, r.n_hits] for r in rows} == dict(want)
    assert want[("all", None, None, "email")] == [4, 6]


def test_hits_of_one_column_and_of_no_rows(spark):
    df = spark.createDataFrame([("a", "x@example.com")], "source string, text string")
    redacted = privacy.redact(df, "text")
    assert sorted(map(tuple, privacy.hit_levels(redacted, "text", ["source"]).collect()), key=str) == sorted(
        [("source", "a", "email", 1, 1), ("source", "a", "any", 1, 1), ("all", None, "email", 1, 1), ("all", None, "any", 1, 1)], key=str)
    assert privacy.hit_levels(redacted.limit(0), "text", ["source"]).count() == 0


def test_queued_verdicts_become_pending_reviews(spark):
    at = datetime.datetime(2024, 1, 1)
    shape = ("id long, ts timestamp, session_id string, stage string, action_taken string, reason string, norm_text string, "
             "in_prompt string, text string, in_confidence double, out_confidence double")
    df = spark.createDataFrame([
        (1, at, "s", "input", "QUEUED_FOR_REVIEW", "odd", "norm", "safe", "answer", 0.5, None),
        (2, at, "s", "output", "QUEUED_FOR_REVIEW", "rule", "norm", "safe", "answer", None, 0.6),
        (3, at, "s", "output", "BLOCKED", "rule", "norm", "safe", "answer", None, 0.9),
        (4, at, None, "done", "PASSED", "fine", "norm", "safe", "answer", None, None)], shape)
    got = sorted(map(tuple, review.queued(df).collect()))
    assert got == [(1, at, "s", "norm", "", "input", 0.5, "odd", "pending"), (2, at, "s", "safe", "answer", "output", 0.6, "rule", "pending")]
    assert review.pending(review.queued(df)).count() == 2


def tally(verdicts, times=()):
    passed, times = verdicts.count("PASS"), [t for t in times if t is not None]
    return (passed, sum(v in ("BLOCK", "REJECTED", "RATE_LIMIT") for v in verdicts), len(verdicts) - passed, len(verdicts),
            (max(times) - min(times)) // datetime.timedelta(milliseconds=1) if times else None)


def test_run_summary_has_totals_and_every_verdict_in_order(spark):
    """Ids that repeat, leave gaps, are below zero or null; a category alone in its block, and no rows at all."""
    at = datetime.datetime(2024, 1, 1)
    kinds = ["PASS", "BLOCK", "QUEUED", "REJECTED", "RATE_LIMIT", "ERROR"]
    ids = [*range(7), 3, 3, 3, 3, 40, -2, None, None, None, None]
    rows = [(i, None if i is None else at + datetime.timedelta(seconds=20 * i), ("output", "done")[n % 2], ("pii", "dos")[n % 3 == 0], kinds[n * 5 % 6])
            for n, i in enumerate(ids)]
    df = spark.createDataFrame(rows, "id long, ts timestamp_ntz, stage string, category string, verdict string")
    want = {("run", None, None, None, None): (rows, None)}
    for name in ("pii", "dos"):
        want["category", name, None, None, None] = ([r for r in rows if r[3] == name], None)
        for block in {None if i is None else i // 3 for i in ids}:
            mine = sorted((r for r in rows if r[3] == name and (None if r[0] is None else r[0] // 3) == block), key=lambda r: (r[0] or 0, r[4]))
            want |= {("verdicts", name, None, block, k // 3): (mine[k:k + 3], [r[4] for r in mine[k:k + 3]]) for k in range(0, len(mine), 3)}
    for stage in ("output", "done"):
        want["stage", None, stage, None, None] = ([r for r in rows if r[2] == stage], None)
    assert any(key[4] for key in want)
    found = evaluation.run_summary(df, "category", "stage", "id", size=3).collect()
    got = {tuple(r)[:5]: (tuple(r)[5:10], r.verdicts) for r in found}
    assert len(found) == len(got)
    assert got == {k: (tally([r[4] for r in some], [r[1] for r in some]), listed) for k, (some, listed) in want.items()}
    assert [tuple(r) for r in evaluation.run_summary(df.limit(0), "category", "stage", "id").collect()] == [
        ("run", None, None, None, None, 0, 0, 0, 0, None, None)]


def test_scenarios_are_summed_up_by_category_with_their_verdicts(spark, tmp_path):
    """Totals of the run and of each category, and each category's verdicts by id, beside the counts by stage."""
    words = "where is my order please tell me about the refund of last week".split()
    texts = {i: " ".join(words[i * k % len(words)] for k in range(1, 9)) * (120 if i % 16 == 3 else 1) for i in [*range(1, 120), *range(2000, 2030)]}
    docs = [(i, t, "en", f"src{i % 4}", len(t)) for i, t in texts.items()]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    levels = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    spark.createDataFrame([(i, p) for i, p in enumerate(levels)], "o_orderkey long, o_orderpriority string").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    duck = duckdb.connect()
    for t in ("documents", "orders"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    planted = [*[(n, "encoding") for n in (37, 13, 11, 19, 17, 23, 31)], (41, "multilingual"), (43, "injection"), (47, "multilingual"), (7, "injection"), (5, "pii")]
    lists = defaultdict(list)
    for i, verdict in sorted(duck.execute(f"SELECT id, verdict FROM ({contract.oracle_sql()['status_verdict']})").fetchall()):
        unplanted = "dos" if len(texts[i]) > 4000 else "output_guard" if i % 5 == 1 else "baseline"
        lists[next((name for n, name in planted if i % n == 0), unplanted)].append(verdict)
    assert set(lists) == {"baseline", "pii", "injection", "encoding", "multilingual", "output_guard", "dos"}
    df = contract.queries()["scenario_summary"](spark, str(tmp_path))
    rows = df.collect()
    parts = defaultdict(list)
    for r in sorted((r for r in rows if r.level == "verdicts"), key=lambda r: (r.block, r.part)):
        parts[r.category] += r.verdicts.split(",")
    assert parts == lists
    assert {r.category: tuple(r)[5:9] for r in rows if r.level == "category"} == {c: tally(v)[:4] for c, v in lists.items()}
    assert [tuple(r)[5:10] for r in rows if r.level == "run"] == [(*tally(sum(lists.values(), []))[:4], 20_000 * 2028)]
    stages = duck.execute(f"SELECT stage, sum(n_requests) FROM ({contract.oracle_sql()['audit_labels']}) GROUP BY stage").fetchall()
    assert {r.stage: r.n_total for r in rows if r.level == "stage"} == dict(stages)
    want = duck.execute(contract.oracle_sql()["scenario_summary"])
    columns = [c[0] for c in want.description]
    assert sorted(map(repr, map(tuple, df.select(*columns).collect()))) == sorted(map(repr, want.fetchall()))
