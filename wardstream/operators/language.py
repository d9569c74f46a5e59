"""Language tags from word profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage
from .skew import lookup_join

WORDS = 200  # profile size per language


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0))


def profiles(labelled: DataFrame, text: str, lang: str, size: int = WORDS) -> DataFrame:
    """The ``size`` most frequent words per language with their share of its words."""
    counts = labelled.select(lang, F.explode(words(F.col(text))).alias("word")).groupBy(lang, "word").agg(
        F.count("*").alias("n"))
    totals = counts.groupBy(lang).agg(F.sum("n").alias("total"))
    ranked = counts.withColumn("_r", F.row_number().over(W.partitionBy(lang).orderBy(F.desc("n"), "word")))
    return ranked.filter(F.col("_r") <= size).join(totals, lang).select(
        F.col(lang).alias("tag"), "word", (F.col("n") / F.col("total")).alias("weight"))


def tag(texts: DataFrame, profile: DataFrame, row_id: str, text: str) -> DataFrame:
    """The language whose profile covers the text best, "unknown" where none does."""
    profile = cut_lineage(profile)  # a few words per language; built from all texts
    tokens = texts.select(row_id, F.explode(words(F.col(text))).alias("word"))
    scored = lookup_join(tokens, profile, ["word"], "inner", F.col(row_id)).groupBy(row_id, "tag").agg(
        F.round(F.sum("weight"), 9).alias("score"))
    best = scored.groupBy(row_id).agg(F.min_by("tag", F.struct(-F.col("score"), F.col("tag"))).alias("tag"))
    return texts.join(best, row_id, "left").withColumn("tag", F.coalesce("tag", F.lit("unknown")))


def accuracy(tagged: DataFrame, lang: str) -> DataFrame:
    return tagged.groupBy(lang).agg(
        F.count("*").alias("n_texts"), F.count_if(F.col("tag") == F.col(lang)).alias("n_correct"),
        F.round(F.count_if(F.col("tag") == F.col(lang)) / F.count("*"), 6).alias("accuracy"))
