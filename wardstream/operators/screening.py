"""Text-normalisation screening over a prompt table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, text as textfn


def screen(prompts: DataFrame, text: str = "prompt", threshold: float = fixed.NORM_BLOCK_RISK) -> DataFrame:
    """Normalisation report plus the block decision and its reason."""
    df = textfn.normalise(prompts, text)
    kinds = F.col("norm_encodings")
    why = F.when(F.size(kinds) > 0, F.array_join(kinds, ",")).otherwise(F.lit("homoglyph"))
    blocked = F.col("norm_risk") >= threshold
    return df.withColumn("norm_blocked", blocked).withColumn("norm_reason", F.when(blocked, why))


def blocked_rows(screened: DataFrame) -> DataFrame:
    return screened.filter("norm_blocked")


def keyword_hits(prompts: DataFrame, text: str = "prompt") -> DataFrame:
    """Prompts per keyword."""
    words = prompts.select(F.explode(textfn.keyword_list(F.col(text))).alias("keyword"))
    return words.groupBy("keyword").agg(F.count("*").alias("n_prompts"))


def summary(screened: DataFrame, by: str) -> DataFrame:
    return screened.groupBy(by).agg(
        F.count("*").alias("n_prompts"),
        F.count_if(F.size("norm_encodings") > 0).alias("n_encoded"),
        F.count_if("norm_homoglyph").alias("n_homoglyph"),
        F.count_if(F.size("norm_keywords") > 0).alias("n_keyword"),
        F.count_if("norm_blocked").alias("n_blocked"),
        F.round(F.avg("norm_risk"), 6).alias("avg_risk"),
    )
