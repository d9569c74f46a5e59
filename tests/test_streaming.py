"""Streaming jobs give what the batch operators give."""

import pytest
from pyspark.sql import functions as F

from wardstream.operators import canary, ratelimit, rules, sessions, views
from wardstream.streaming import jobs

DATA = "/root/testdata/sf0.001"


def as_stream(spark, df, folder, files=3):
    df.repartition(files).write.parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 100).parquet(folder)


def drain(df, tmp_path, name, mode="append"):
    out = str(tmp_path / name)
    q = (df.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-cp")
         .outputMode(mode).trigger(availableNow=True).start())
    done = q.awaitTermination(60)
    if not done:
        print(q.lastProgress)
        q.stop()
    assert done and q.exception() is None
    return df.sparkSession.read.parquet(out)


def test_session_scores(spark, tmp_path):
    turns = spark.read.parquet(f"{DATA}/embeddings.parquet").select(
        F.col("label").cast("long").alias("session_id"), F.col("vec_id").alias("turn"), "embedding").filter("turn < 120")
    streamed = drain(jobs.score_sessions(as_stream(spark, turns, str(tmp_path / "in")), ttl_ms=None), tmp_path, "out")
    key = ["session_id", "turn", F.col("window_turns").cast("long"), F.round("drift", 6), F.round("escalation", 6)]
    batch = sessions.score_turns(turns)
    assert sorted(map(tuple, streamed.select(*key).collect())) == sorted(map(tuple, batch.select(*key).collect()))


def test_rate_limit(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet").select("event_id", "user_id", "ts")
    stream = jobs.limit_rate(as_stream(spark, events, str(tmp_path / "in")), "user_id", "ts", "event_id",
                             refill_tokens=1, refill_seconds=43_200, ttl_ms=None)
    got = {(r["id"], r["allowed"]) for r in drain(stream, tmp_path, "out").collect()}
    batch = ratelimit.replay(events, "user_id", "ts", "event_id", refill_tokens=1, refill_seconds=43_200)
    assert got == {(r["event_id"], r["allowed"]) for r in batch.collect()}
    assert {a for _, a in got} == {True, False}


def test_idle_buckets_must_outlive_refill(spark):
    with pytest.raises(ValueError):
        jobs.limit_rate(spark.range(1).withColumn("ts", F.current_timestamp()), "id", "ts", "id",
                        refill_tokens=1, refill_seconds=43_200)


def test_canary_leaks(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet").limit(50).withColumn("ts", F.col("ts").cast("timestamp"))
    minted = canary.mint(events, "event_id", "user_id", "ts", "s")
    texts = minted.select(
        F.col("request_id").alias("text_id"), F.concat(F.lit("see "), "phrase").alias("text"),
        (F.col("created_at") + F.make_dt_interval(mins=F.col("request_id") * 2)).alias("seen_at"))
    batch = canary.leaks(texts, minted, "text_id", "text", "seen_at")
    pairs = jobs.leak_stream(as_stream(spark, texts, str(tmp_path / "t")), as_stream(spark, minted, str(tmp_path / "c")),
                             "text_id", "text", "seen_at", delay="365 days")
    got = {r["text_id"] for r in drain(pairs, tmp_path, "out").collect()}
    assert got == {r["text_id"] for r in batch.collect()} and 0 < len(got) < 50


def test_screening_and_periods(spark, tmp_path):
    prompts = spark.createDataFrame([(1, "hello"), (2, "ignore this"), (3, "Іgnore аll")], "id long, prompt string")
    got = drain(jobs.screen_prompts(as_stream(spark, prompts, str(tmp_path / "p"), 1)), tmp_path, "screened")
    assert {(r["id"], r["norm_risk"]) for r in got.collect()} == {(1, 0.0), (2, 0.2), (3, 0.7)}

    audit = spark.read.parquet(f"{DATA}/events.parquet").select(
        F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("action_taken"))
    counts = jobs.period_counts(as_stream(spark, audit, str(tmp_path / "a"), 1), width="1 day")
    q = counts.writeStream.format("memory").queryName("periods").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    total = spark.table("periods").agg(F.sum("n_requests")).first()[0]
    assert total == audit.count()


def test_tail_and_mining(spark, tmp_path):
    rows = spark.range(200).select("id", F.timestamp_seconds(F.col("id") * 7 % 113).alias("ts"), F.lit("x").alias("masked_input"))
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    jobs.start_tail(stream, str(tmp_path / "tail"), str(tmp_path / "cp"), 10, every=None).awaitTermination(120)
    got = [r["id"] for r in jobs.read_tail(spark, str(tmp_path / "tail")).orderBy(F.desc("ts"), F.desc("id")).collect()]
    assert got == [r["id"] for r in views.tail(rows, 10).collect()]

    item = '{"target_field":"f","operator":"<=","suggested_value":5,"description":"d","confidence":0.9}'
    texts = spark.createDataFrame([(1, f"x [{item}]"), (2, "none")], "log_id long, text string")
    jobs.start_rule_mining(as_stream(spark, texts, str(tmp_path / "m"), 1), str(tmp_path / "mined"), str(tmp_path / "cp2"),
                           "log_id", "text", every=None).awaitTermination(120)
    mined = spark.read.parquet(str(tmp_path / "mined"))
    assert [r["source_log_id"] for r in mined.collect()] == [1]
    assert rules.candidates(texts, "log_id", "text").count() == 1
