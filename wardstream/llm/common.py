"""Columns and helpers that several training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import bound_batches  # noqa: F401

#: The white space of the word rule, and the pattern of one run of it.
SPACES = " \t\n\x0b\f\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words(text: Column) -> Column:
    """The words of a text in order; no words for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_RUN), "")


def lower_ascii(text: Column) -> Column:
    """A to Z in lower case, every other character as it is; null stays null.

    ``lower`` is the faster built-in and agrees on pure ASCII, which most texts are.
    """
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rank_in_groups(df: DataFrame, group: str, order: list[str], spread: Column, rows: int = 20_000) -> DataFrame:
    """``df`` with ``rank`` (from 0) inside each group, however large a group is.

    Rows are dealt to buckets by the hash ``spread``; the bucket sizes, summed up per group,
    give each bucket its first rank, and rows are numbered inside (group, bucket).  The
    number of buckets follows the number of rows, so that no task sorts a whole hot group.
    ``df`` is counted once and read twice: pass a written table.
    """
    buckets = max(1, -(-df.count() // rows))
    dealt = df.withColumn("_bucket", F.pmod(spread, F.lit(buckets)).cast("int"))
    sizes = dealt.groupBy(group, "_bucket").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(_window([group], ["_bucket"])) - F.col("_n")
    starts = sizes.select(F.col(group).alias("_g"), F.col("_bucket").alias("_b"), before.alias("_first"))
    numbered = dealt.withColumn("_at", F.row_number().over(_window([group, "_bucket"], order)) - 1)
    joined = numbered.join(starts, numbered[group].eqNullSafe(F.col("_g")) & (F.col("_bucket") == F.col("_b")))
    return joined.withColumn("rank", F.col("_first") + F.col("_at")).drop("_bucket", "_at", "_first", "_g", "_b")


def _window(keys: list[str], order: list[str]):
    from pyspark.sql import Window

    return Window.partitionBy(*keys).orderBy(*order)
