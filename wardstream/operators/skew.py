"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 100_000
SALTS = 32


def is_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """True if ``df`` has at most ``max_rows`` rows; the count is combined before it is shuffled."""
    return df.count() <= max_rows


def lookup_join(big: DataFrame, small: DataFrame, on: list[str], how: str, spread: Column,
                max_rows: int = BROADCAST_ROWS, salts: int = SALTS) -> DataFrame:
    """Join a big table to a lookup table whose size is checked first.

    Up to ``max_rows`` lookup rows are broadcast.  Beyond that the lookup is copied to
    ``salts`` salts and the big side is spread over them by ``spread`` (a column whose
    hash varies inside a key), so that a hot key is shared by ``salts`` tasks.
    """
    if is_small(small, max_rows):
        return big.join(F.broadcast(small), on, how)
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")
