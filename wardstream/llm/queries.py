"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardstream.session import ensure_checkpoint_dir

from . import (
    bpe, deobfuscate, filter_audit, jaccard_join, license_scan, maxscore, mixing, packing, periodic_runs, risk_rules, suffix_dedup, url_templates,
    warc_archive,
)
from .common import bound_batches, table


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op1_pareto_mix(spark: SparkSession, folder: str) -> DataFrame:
    out = mixing.shares(table(spark, folder, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op2_url_templates(spark: SparkSession, folder: str) -> DataFrame:
    return url_templates.judge(table(spark, folder, "pages"))


def op3_noisy_channel(spark: SparkSession, folder: str) -> DataFrame:
    bound_batches(spark)
    docs = table(spark, folder, "documents")
    model, scorer = deobfuscate.fit(docs, table(spark, folder, "labels"))
    return deobfuscate.score(docs, model, scorer)


def op4_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    bound_batches(spark)
    return suffix_dedup.dedup(table(spark, folder, "documents"))


def op5_risk_rules(spark: SparkSession, folder: str) -> DataFrame:
    from wardstream.session import cut_lineage

    docs = table(spark, folder, "documents").select("doc_id", "lang", "text")
    counted = cut_lineage(risk_rules.features(docs).drop("text"))
    cutoffs = risk_rules.fit(counted, table(spark, folder, "labels"))
    judged = risk_rules.judge(counted, cutoffs)
    return judged.select("doc_id", *(f"_q.{c}" for c in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")))


def op6_maxscore_topk(spark: SparkSession, folder: str) -> DataFrame:
    return maxscore.search(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


def op7_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    bound_batches(spark)
    return jaccard_join.join(table(spark, folder, "documents"))


def op8_license_diagonals(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.scan(table(spark, folder, "documents"))


def op9_warc_archive(spark: SparkSession, folder: str) -> DataFrame:
    path = f"{ensure_checkpoint_dir(spark)}/archive-{uuid.uuid4()}"
    warc_archive.write_archive(table(spark, folder, "pages"), path)
    return warc_archive.verify(spark, path)


def op10_best_fit(spark: SparkSession, folder: str) -> DataFrame:
    bound_batches(spark)
    return packing.pack(table(spark, folder, "documents"), tokenizer_path())


def op11_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    ids = filter_audit.failing_ids(filter_audit.judged(docs), labels)
    return filter_audit.audit(*ids)


def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    bound_batches(spark)
    return periodic_runs.summary(periodic_runs.runs(periodic_runs.planted(table(spark, folder, "documents"))))


def op13_bpe_backtracking(spark: SparkSession, folder: str) -> DataFrame:
    bound_batches(spark)
    encoded = bpe.encode(table(spark, folder, "documents"), tokenizer_path())
    done = bpe.decode(encoded, tokenizer_path())
    return done.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {f.__name__: f for f in (op1_pareto_mix, op2_url_templates, op3_noisy_channel, op4_suffix_dedup, op5_risk_rules, op6_maxscore_topk, op7_jaccard_join,
                                   op8_license_diagonals, op9_warc_archive, op10_best_fit, op11_filter_audit, op12_periodic_runs, op13_bpe_backtracking)}
ORACLES: dict[str, str] = {"op11_filter_audit": filter_audit.SQL}
