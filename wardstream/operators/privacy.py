"""Personal-data redaction jobs and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import pii


def redact(df: DataFrame, text: str, patterns: dict[str, str] | None = None) -> DataFrame:
    """``redacted`` text, detected types, both counts, flag and route."""
    return pii.redact(df, text, patterns).withColumns({
        "has_pii": F.size("redacted_types") > 0,
        "pii_route": pii.route(F.col("redacted_types")),
    })


def incidence(redacted: DataFrame, row_id: str, by: list[str]) -> DataFrame:
    """Rows per detected type and group.  Each row lists a type once, so rows are counted."""
    return (
        redacted.select(row_id, *by, F.explode("redacted_types").alias("pii_type"))
        .groupBy(*by, "pii_type").agg(F.count("*").alias("n_rows"))
    )


def hit_levels(redacted: DataFrame, text: str, by: list[str], patterns: dict[str, str] | None = None) -> DataFrame:
    """Rows and hits per type: for every set of ``by`` together, for each column alone, and over all.

    ``level`` names the columns that a row is about ("all": none); the others are NULL there.
    The type ``any`` counts rows with at least one type once, and the hits of all their types.
    Rows without a detected type leave before the level copies are made, which hold no text and
    are combined before the shuffle.
    """
    found = redacted.filter(F.size("redacted_types") > 0).select(
        *by, pii.hits(F.col(text), F.col("redacted_types"), patterns).alias("_hits"))
    total = F.aggregate("_hits", F.lit(0).cast("long"), lambda n, h: n + h["n"])
    both = F.concat("_hits", F.array(F.struct(F.lit("any").alias("kind"), total.alias("n"))))
    each = found.select(*by, F.explode(both).alias("_hit")).select(*by, F.col("_hit.kind").alias("pii_type"), F.col("_hit.n").alias("_n"))
    kind = F.col("pii_type")
    sets = [[kind, *map(F.col, by)], *([[kind, F.col(b)] for b in by] if len(by) > 1 else []), [kind]]
    name = F.array_compact(F.array(*[F.when(F.grouping(b) == 0, F.lit(b)) for b in by]))
    counted = each.groupingSets(sets, kind, *map(F.col, by)).agg(
        name.alias("_level"), F.count("*").alias("n_rows"), F.sum("_n").alias("n_hits"))
    level = F.when(F.size("_level") == 0, F.lit("all")).otherwise(F.array_join("_level", ","))
    return counted.select(level.alias("level"), *by, "pii_type", "n_rows", "n_hits")
