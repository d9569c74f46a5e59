"""Ordered and skewed traffic against brute force."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardstream.operators import (assembly, evaluation, metrics, ratelimit, requests, rule_counts, rules, sessions, similarity, skew,
                                  validation)
from wardstream.plans import catalog
from wardstream.sources import tables


def brute_sessions(turns):
    out = {}
    for session in {s for s, _, _ in turns}:
        held = []
        for _, turn, v in sorted(t for t in turns if t[0] == session):
            held = [*held, np.asarray(v)][-8:]

            def cos(a, b):
                n = np.linalg.norm(a) * np.linalg.norm(b)
                return 1.0 if n == 0 else float(a @ b) / n

            steps = [cos(a, b) for a, b in zip(held, held[1:])]
            out[session, turn] = (round(1 - cos(held[0], held[-1]) if len(held) > 2 else 0.0, 6),
                                  round(float(np.var(steps)) if steps else 0.0, 6))
    return out


@pytest.mark.parametrize("block", [1, 3, 5, 4096])
def test_session_blocks_agree_with_brute_force(spark, block):
    rng = random.Random(block)
    turns = [(s, t, [float(rng.randint(-2, 2)) for _ in range(3)]) for s, n in ((1, 60), (2, 9), (3, 2))
             for t in sorted(rng.sample(range(200), n))]
    df = spark.createDataFrame(turns, "session_id long, turn long, embedding array<double>")
    got = sessions.score_turns(df, block=block).collect()
    have = {(r["session_id"], r["turn"]): (round(r["drift"], 6) + 0.0, round(r["escalation"], 6) + 0.0) for r in got}
    want = brute_sessions(turns)
    assert have.keys() == want.keys() and len(got) == len(turns)
    assert all(have[k] == pytest.approx(want[k], abs=2e-6) for k in want)


def test_session_fixture(spark):
    cases = {1: [(1, 0), (1, 0), (0, 1)], 2: [(1, 0), (0, 1), (1, 0), (1, 0)], 3: [(0, 0), (1, 0), (1, 0)]}
    rows = [(s, i, [float(x) for x in v]) for s, vs in cases.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "session_id long, turn long, embedding array<float>")
    last = {r["session_id"]: r for r in sessions.session_report(sessions.score_turns(df)).collect()}
    assert (last[1]["drift"], last[1]["escalation"], last[1]["suspicious"]) == (1.0, 0.25, True)
    assert last[2]["drift"] == 0.0 and round(last[2]["escalation"], 4) == 0.2222 and last[2]["reason"].startswith("escalation")
    assert (last[3]["drift"], last[3]["escalation"], last[3]["suspicious"]) == (0.0, 0.0, False)


def brute_bucket(rows, capacity, tokens, seconds):
    state, out = {}, {}
    for key, us, i in sorted(rows, key=lambda r: (r[1], r[2])):
        level, last = state.get(key, (capacity * seconds * 1_000_000, us))
        level = min(capacity * seconds * 1_000_000, level + (us - last) * tokens)
        ok = level >= seconds * 1_000_000
        state[key] = (level - seconds * 1_000_000 * ok, us)
        out[i] = bool(ok)
    return out


def frame(spark, rows):
    start = datetime.datetime(2024, 1, 1)
    return spark.createDataFrame(
        [(k, start + datetime.timedelta(microseconds=us), i) for k, us, i in rows], "k string, ts timestamp_ntz, id long")


def test_rate_limit_fixture(spark):
    times = [0, 0, 0, 0, 0, 0, 1, 7, 8, 60]
    df = frame(spark, [("a", t * 1_000_000, i) for i, t in enumerate(times)])
    got = [r["allowed"] for r in ratelimit.replay(df, "k", "ts", "id").orderBy("id").collect()]
    assert got == [True] * 5 + [False, False, True, False, True]


@pytest.mark.parametrize("hot", [5, 40, 10_000])
def test_rate_limit_chunks_agree_with_brute_force(spark, hot):
    rng = random.Random(hot)
    rows, now = [], 0
    for i in range(900):
        now += rng.choice([0, 0, 300_000, 900_000, 2_500_000, 7_000_000, 40_000_000 if rng.random() < 0.05 else 0])
        rows.append((rng.choice("aaaaaabc"), now, i))
    got = ratelimit.replay(frame(spark, rows), "k", "ts", "id", hot_ticks=hot).collect()
    assert {r["id"]: r["allowed"] for r in got} == brute_bucket(rows, 5, 10, 60)


def test_level_function_is_exact():
    rng = random.Random(1)
    for _ in range(150):
        cost, capacity = rng.randint(2, 9), 0
        capacity = cost * rng.randint(1, 5)
        ticks = [(rng.randint(0, 2 * cost), rng.randint(1, 7)) for _ in range(rng.randint(1, 12))]
        pieces = [(0, capacity, 0, 1)]
        for gain, want in ticks:
            pieces = ratelimit.advance(pieces, gain, want, cost, capacity)
        assert [p[0] for p in pieces] == [0, *[p[1] + 1 for p in pieces[:-1]]] and pieces[-1][1] == capacity
        for x in range(capacity + 1):
            level = x
            for gain, want in ticks:
                level = min(capacity, level + gain)
                level -= min(want, level // cost) * cost
            lo, _, value, slope = next(p for p in pieces if p[0] <= x <= p[1])
            assert value + slope * (x - lo) == level


def brute_cache(vectors, ok, threshold, capacity):
    held, out = [], []
    for i, v in enumerate(vectors):
        sims = [round(float(v @ vectors[j]), 9) for j in held]
        best = max(sims, default=-2)
        hit = best >= threshold
        added = not hit and ok[i] and len(held) < capacity
        out.append((i, held[sims.index(best)] if hit else None, hit, added))
        if added:
            held.append(i)
    return out


@pytest.mark.parametrize("capacity", [3, 10, 5000])
def test_cache_replay_agrees_with_brute_force(spark, capacity):
    rng = np.random.default_rng(capacity)
    v = rng.normal(size=(150, 3))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    ok = [bool(x) for x in rng.random(150) < 0.7]
    df = spark.createDataFrame([(i, v[i].tolist(), ok[i]) for i in range(150)], "id long, embedding array<double>, ok boolean")
    got = similarity.replay(df, "id", "id", "ok", threshold=0.9, capacity=capacity).orderBy("query_id").collect()
    assert [(r["query_id"], r["entry_id"], r["hit"], r["inserted"]) for r in got] == brute_cache(v, ok, 0.9, capacity)


def test_lookup_join_paths_agree(spark):
    big = spark.range(2000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"))
    small = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("inner", "left", "left_anti"):
        a = skew.lookup_join(big, small, ["k"], how, F.col("id"))
        b = skew.lookup_join(big, small, ["k"], how, F.col("id"), max_rows=5, salts=4)
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_shape_rules(spark):
    convs = {
        1: [("user", "hi")], 2: [("assistant", "x"), ("user", "y")], 3: [("system", "s"), ("system", "s")],
        4: [("bot", "x"), ("user", None)], 5: [("user", None)], 6: [("system", "x" * 2001)], 7: [("user", "x" * 4001)],
        8: [("user", "x" * 3000)] * 3, 9: [("user", "x")] * 21, 10: [("user", "x" * 4000), ("system", "y" * 2000)],
    }
    rows = [(c, i, r, t) for c, ms in convs.items() for i, (r, t) in enumerate(ms)]
    df = spark.createDataFrame(rows, tables.SCHEMAS["conversations"])
    got = {r["conv_id"]: r["violation"] for r in validation.shape_check(df).collect()}
    assert got == {1: None, 2: "starts_with_assistant", 3: "multiple_system_messages", 4: "invalid_role", 5: "invalid_content",
                   6: "message_too_long", 7: "message_too_long", 8: "input_too_long", 9: "too_many_messages", 10: None}
    lists = {(r["conv_id"], r["block"]): r for r in validation.message_lists(df).collect()}
    assert {k: r["n_messages"] for k, r in lists.items() if k[0] == 9} == {(9, 0): 20, (9, 1): 1} and len(lists) == 11
    assert [m["role"] for m in lists[2, 0]["messages"]] == ["assistant", "user"]


def test_pairs_keep_ends_and_order(spark):
    roles = ["system", "user", "assistant", "user", "user", "assistant", "assistant", "user"]
    rows = [(c, i, r, f"{c}-{i}") for c in range(30) for i, r in enumerate(roles)]
    df = spark.createDataFrame(rows, tables.SCHEMAS["conversations"])
    got = assembly.shuffle_pairs(df, always=True).orderBy("conv_id", "position").collect()
    seen = set()
    for c in range(30):
        order = [r["turn"] for r in got if r["conv_id"] == c]
        assert sorted(order) == list(range(8)) and order[0] == 0 and order[-1] == 7 and order[5:7] == [3, 6]
        assert {tuple(order[1:3]), tuple(order[3:5])} == {(1, 2), (4, 5)}
        seen.add(tuple(order))
    assert len(seen) == 2


def test_rules_beyond_one_block(spark, monkeypatch):
    monkeypatch.setattr(rules, "RULE_BLOCK", 4)
    rng = random.Random(3)
    limits = [(i, "f", rng.choice(["<=", ">=", "<", ">", "==", "!="]), float(rng.randint(1, 60)), f"r{i}") for i in range(30)]
    texts = [(i, " ".join(f"${rng.randint(1, 60)}" for _ in range(rng.randint(0, 3)))) for i in range(60)]
    got = rules.first_violations(spark.createDataFrame(texts, "id long, t string"),
                                 spark.createDataFrame(limits, tables.SCHEMAS["business_rules"]), "id", "t").collect()
    ops = {"<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, ">": lambda a, b: a > b, "==": lambda a, b: a == b}
    want = {}
    for i, t in texts:
        amounts = [float(x[1:]) for x in t.split()]
        first = next(((r[0], a) for r in limits if r[2] in ops for a in amounts if not ops[r[2]](a, r[3])), None)
        if first:
            want[i] = first
    assert {r["id"]: (r["rule_id"], r["amount"]) for r in got} == want
    answers, table = spark.createDataFrame(texts, "id long, t string"), spark.createDataFrame(limits, tables.SCHEMAS["business_rules"])
    many = rules.with_violation(answers, table, "id", "t").collect()
    monkeypatch.setattr(rules, "RULE_BLOCK", 1000)
    one = rules.with_violation(answers, table, "id", "t").collect()
    reasons = {i: f"Deterministic rule violation: r{r[0]}" for i, r in want.items()}
    for rows in (many, one):
        assert {r["id"]: r["rule_reason"] for r in rows} == {i: reasons.get(i) for i, _ in texts}
    no_rules = rules.with_violation(answers, table.filter("id < 0"), "id", "t").collect()
    assert len(no_rules) == 60 and all(r["rule_reason"] is None for r in no_rules)


def test_violation_counts_agree_with_brute_force(spark):
    rng = random.Random(8)
    texts = [" ".join(f"${rng.choice([5, 10, 10.5, 20, 30])}" for _ in range(rng.randrange(5))) for _ in range(80)]
    texts += [None, "", "no number", "$20", "$20", "$20 $20"]
    answers = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    found = {}
    for r in rules.extracted_amounts(answers, "id", "t").collect():
        found.setdefault(r["id"], []).append(r["amount"])
    broken = {"<=": lambda a, v: a > v, ">=": lambda a, v: a < v, "<": lambda a, v: a >= v, ">": lambda a, v: a <= v, "==": lambda a, v: a != v}
    limits = [(1 + 6 * i + j, "f", op, v, "d") for i, v in enumerate((-1.0, 5.0, 10.0, 10.2, 20.0, 1e9)) for j, op in enumerate(broken)]
    limits += [(100, "f", "<=", None, "no value"), (101, "f", "!=", 5.0, "not numeric"), (102, "g", "<=", 10.0, "same value")]
    table = spark.createDataFrame(limits, tables.SCHEMAS["business_rules"])
    got = {r["rule_id"]: (r["n_amounts"], r["n_responses"]) for r in rule_counts.violation_counts(answers, table, "t").collect()}
    want = {}
    for key, _, op, value, _ in limits:
        if op in broken:
            hit = [sum(value is not None and broken[op](a, value) for a in amounts) for amounts in found.values()]
            want[key] = (sum(hit), sum(h > 0 for h in hit))
    assert got == want and any(n > m for n, m in want.values())
    none = rule_counts.violation_counts(answers.filter("id < 0"), table, "t").collect()
    assert len(none) == len(want) and all(r["n_amounts"] == 0 == r["n_responses"] for r in none)
    assert rule_counts.violation_counts(answers, table.filter("id < 0"), "t").count() == 0


def test_violations_are_all_pairs_of_amount_and_broken_rule(spark, tmp_path):
    texts = [(1, "$5 and $20"), (2, "$20 $20"), (3, None), (4, "nothing"), (2, "$10")]
    limits = [(1, "f", "<=", 10.0, "most"), (2, "f", ">", 5.0, "least"), (3, "f", "!=", 5.0, "not numeric"), (4, "g", "==", 20.0, None)]
    answers = spark.createDataFrame(texts, "id long, t string")
    table = spark.createDataFrame(limits, tables.SCHEMAS["business_rules"])
    rows = rules.violations(answers.withColumnRenamed("id", "row"), table, "row", "t").collect()
    assert sorted((r["row"], r["position"], r["amount"], r["rule_id"]) for r in rows) == [
        (1, 0, 5.0, 2), (1, 0, 5.0, 4), (1, 1, 20.0, 1), (2, 0, 10.0, 4), (2, 0, 20.0, 1), (2, 1, 20.0, 1)]
    orders = [(1, 7, "2-HIGH", "F"), (3, 65, "5-LOW", "O"), (8, 4, "5-LOW", "F")]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderpriority string, o_orderstatus string").write.parquet(
        str(tmp_path / "orders.parquet"))
    got = catalog.QUERIES["rule_violations"](spark, str(tmp_path)).collect()
    assert {(r["id"], r["amount"], r["rule_id"]) for r in got} >= {(8, 8.5, 5), (8, 4.0, 5), (1, 7.0, 5)}


def test_quiet_hours_count_as_none(spark):
    start = datetime.datetime(2024, 1, 1)
    counts = {0: 1, 1: 2, 23: 40, 24: 3, 30: 2, 60: 1, 61: 1, 200: 5}
    rows = [("a", start + datetime.timedelta(hours=h, minutes=m)) for h, n in counts.items() for m in range(n)]
    got = metrics.spike_hours(spark.createDataFrame(rows + [("b", start)], "kind string, ts timestamp_ntz"), "kind").collect()
    want = {}
    for h, n in counts.items():
        before = np.array([counts.get(g, 0) for g in range(h - 24, h)])
        if h >= 24 and n > before.mean() + 2 * before.std():
            want[start + datetime.timedelta(hours=h)] = (n, round(float(before.mean() + 2 * before.std()), 4))
    assert {r["hour"]: (r["n_events"], r["threshold"]) for r in got} == want and len(want) == 3


def test_snapshot_has_every_rule(spark):
    limits = spark.createDataFrame([(i, f"f{i}", "<=", float(i), "d") for i in range(12)], tables.SCHEMAS["business_rules"])
    audit = spark.range(7)
    rows = tables.snapshot(audit.agg(F.count("*").alias("n")), limits, audit, datetime.datetime(2024, 2, 1)).collect()
    assert sorted(r["rule_id"] for r in rows if r["part"] == "rule") == list(range(12))
    assert {r["part"]: r["body"] for r in rows if r["part"] != "rule"} == {"metrics": '{"n":7}', "audit": '{"n_audit":7}'}
    empty = tables.snapshot(audit.agg(F.count("*").alias("n")), limits.limit(0), audit.limit(0), datetime.datetime(2024, 2, 1))
    assert sorted(r["part"] for r in empty.collect()) == ["audit", "metrics"]


def test_candidates_and_approval(spark):
    good = '{"target_field":"f","operator":"<=","suggested_value":50.0,"description":"Max","confidence":0.9}'
    texts = [f"[{good}]", good.join("[]").replace("0.9", "0.6"), '[{"target_field":"f"}]', "nothing", f'[5, {good}, "x"]',
             f'[{good.replace("50.0", chr(34) + "many" + chr(34))}, {good}]']
    got = rules.candidates(spark.createDataFrame(list(enumerate(texts)), "id long, t string"), "id", "t").collect()
    assert sorted(r["id"] for r in got) == [0, 4, 5]
    active = spark.createDataFrame([(1, "a", "<=", 1.0, "d")], tables.SCHEMAS["business_rules"])
    wanted = spark.createDataFrame([(7, "b", ">", 2.0, "e", 0.8, "pending")],
                                   "id long, target_field string, operator string, suggested_value double, description string, confidence double, status string")
    twice = spark.createDataFrame([(7, "approved", 1), (7, "approved", 2), (9, "approved", 3)], "id long, status string, decided_at long")
    assert rules.promote(active, wanted, twice).count() == 2


def test_csv_round_trip_and_missing_column(spark, tmp_path):
    df = spark.createDataFrame([('line one\nline "two", é', 1), ("b", 0)], tables.SCHEMAS["labelled_prompts"])
    tables.write_csv(df, str(tmp_path / "p"))
    back = tables.read_prompts_csv(spark, str(tmp_path / "p"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    tables.write_csv(df.drop("is_malicious"), str(tmp_path / "q"))
    with pytest.raises(ValueError):
        tables.read_prompts_csv(spark, str(tmp_path / "q"))


def test_quality_with_empty_denominators(spark):
    log = spark.createDataFrame([(1, False, False, None, None)], "id long, ground_truth boolean, blocked boolean, reason string, error string")
    assert tuple(evaluation.detection_quality(log).first()) == (0.0, 0.0, 0.0)


def test_stages_feed_each_other(spark):
    """A blocked encoding takes no token; a throttled request never reaches the guards."""
    start = datetime.datetime(2024, 1, 1)
    prompts = ["Іgnore all"] * 5 + ["hello"] * 6 + ["x" * 4001]
    rows = [(i, "s", start, p) for i, p in enumerate(prompts)]
    none = {c: F.lit(None).cast(t) for c, t in {
        "clf_label": "string", "clf_score": "double", "judge_action": "string", "judge_reason": "string", "judge_confidence": "double",
        "contra_score": "double", "out_judge_reason": "string", "out_judge_confidence": "double"}.items()}
    history = spark.createDataFrame(rows, "id long, session_id string, ts timestamp_ntz, prompt string").withColumns({
        **none, "llm_available": F.lit(True), "canary_leak": F.lit(False), "text": F.lit("ok"), "out_judge_action": F.lit("PASS")})
    stored = spark.createDataFrame([], "entry_id long, prompt string")
    limits = spark.createDataFrame([(1, "f", "<=", 50.0, "Max")], tables.SCHEMAS["business_rules"])
    got = requests.verdicts(history, stored, limits).orderBy("id").collect()
    assert [r["stage"] for r in got] == ["normalise"] * 5 + ["done"] * 5 + ["rate_limit", "shape"]
    assert [r["status"] for r in got] == [403] * 5 + [200] * 5 + [429, 400]
