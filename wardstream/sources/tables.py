"""Schemas, scans and sinks of the traffic tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _L, _D, _B, _I = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.IntegerType()


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


SCHEMAS = {
    "business_rules": _schema(id=_L, target_field=_S, operator=_S, rule_value=_D, description=_S),
    "audit_logs": _schema(
        id=_L, ts=T.TimestampNTZType(), masked_input=_S, sanitization_results=_S, validation_status=_S,
        final_output=_S, total_tokens=_I, canary_id=_S),
    "suggested_rules": _schema(
        id=_L, created_at=T.TimestampNTZType(), source_log_id=_L, target_field=_S, operator=_S,
        suggested_value=_D, description=_S, confidence=_D, status=_S),
    "review_queue": _schema(
        id=_L, created_at=T.TimestampNTZType(), session_id=_S, masked_prompt=_S, llm_response=_S,
        guard_stage=_S, guard_score=_D, guard_reason=_S, status=_S, reviewed_by=_S,
        reviewed_at=T.TimestampNTZType()),
    "canaries": _schema(canary_id=_S, session_id=_S, request_id=_S, created_at=T.TimestampNTZType(), phrase=_S),
    "cache_entries": _schema(
        idx=_L, embedding=T.ArrayType(T.FloatType()), response=_S, added_at=T.TimestampNTZType()),
    "conversations": _schema(conv_id=_L, turn=_L, role=_S, text=_S),
    "labelled_prompts": _schema(prompt=_S, is_malicious=_I),
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows of a table scanned by fewer tasks than there are cores, dealt out to all cores.

    Twice as many parts as cores, since texts differ in length.  A large table is left as
    it is scanned: no shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < cores else df


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def read_prompts_csv(spark: SparkSession, path: str) -> DataFrame:
    """A labelled prompt file with header; quoted prompts may span lines.

    The header decides which column is which, so the file is read as strings and cast.
    """
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    require_columns(raw, ["prompt", "is_malicious"])
    return raw.withColumn("is_malicious", F.col("is_malicious").try_cast("int"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", True).option("escape", '"').csv(path)


def append(df: DataFrame, path: str, day: Column | None = None) -> None:
    """Appends rows, partitioned by day when a date column is given."""
    if day is None:
        df.write.mode("append").parquet(path)
    else:
        df.withColumn("day", day).write.mode("append").partitionBy("day").parquet(path)


def append_batch(df: DataFrame, path: str, query: str, batch_id: int) -> None:
    """Writes one streaming micro-batch; a batch that is run again replaces itself."""
    df.write.mode("overwrite").parquet(f"{path}/query={query}/batch={batch_id}")


def save_cache(entries: DataFrame, path: str) -> None:
    entries.write.mode("overwrite").parquet(path)


def load_cache(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def rule_fields(rules: DataFrame) -> DataFrame:
    """The rule list as consumers name it."""
    return rules.select("id", F.col("target_field").alias("field"), "operator",
                        F.col("rule_value").alias("value"), "description")


def snapshot(metrics: DataFrame, rules: DataFrame, audit: DataFrame, stamp) -> DataFrame:
    """Rows for export, each with the time, its ``part`` and a JSON ``body``.

    The parts are the metrics, the size of the audit table, and every rule as a row of its own
    with its id, so the number of rules does not bound the export.
    """
    def part(rows: DataFrame, name: str, *columns: str, own: str | None = None) -> DataFrame:
        key = F.col(own) if own else F.lit(None)
        return rows.select(F.lit(stamp).alias("exported_at"), F.lit(name).alias("part"), key.cast("long").alias("rule_id"),
                           F.to_json(F.struct(*columns)).alias("body"))

    sized = audit.agg(F.count("*").alias("n_audit"))
    return part(metrics, "metrics", *metrics.columns).unionByName(part(sized, "audit", "n_audit")).unionByName(
        part(rules, "rule", "id", "target_field", "operator", "rule_value", own="id"))


def write_snapshot(rows: DataFrame, path: str) -> None:
    rows.write.mode("errorifexists").json(path)
