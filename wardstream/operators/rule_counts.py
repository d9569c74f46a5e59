"""How often each numeric rule is broken, without meeting every rule with every amount.

All amounts that break a rule lie on one side of its value, or anywhere but on it.  So the
amounts are counted per value, the counts are summed along the order of values, and a rule
reads its number where its own value stands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, money
from ..functions.bind import bind
from ..session import cut_lineage
from .skew import lookup_join

#: Counted per value: amounts, responses whose largest or smallest amount it is, responses with no other amount.
_COUNTED = ("amounts", "largest", "smallest", "only")


def _points(responses: DataFrame, text: str) -> DataFrame:
    """One row per amount and per extreme of a response, as ``value`` and what it counts for."""
    def point(value: Column, **counts: Column) -> Column:
        return F.struct(value.alias("value"), *[counts.get(c, F.lit(0)).cast("long").alias(c) for c in _COUNTED])

    found = bind(responses, "_amounts", money.amounts(F.col(text))).filter(F.size("_amounts") > 0)
    low, high, one = F.array_min("_amounts"), F.array_max("_amounts"), F.lit(1)
    ends = F.array(point(high, largest=one), point(low, smallest=one, only=low == high))
    return found.select(F.inline(F.concat(F.transform("_amounts", lambda a: point(a, amounts=one)), ends)))


def running_sums(values: DataFrame, by: str, columns: tuple[str, ...]) -> DataFrame:
    """Adds ``{c}_upto`` and ``{c}_all`` for each column, along the distinct ``by`` of the whole table.

    Rows are dealt by ranges of ``by``; only one row per range, its sums, is ordered in one task.
    """
    placed = cut_lineage(values.repartitionByRange(by).withColumn("_part", F.spark_partition_id()))
    order = Window.partitionBy().orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("_part").agg(*[F.sum(c).alias(c) for c in columns]).select(
        "_part", *[F.coalesce(F.sum(c).over(order), F.lit(0)).alias(f"_{c}") for c in columns],
        *[F.sum(c).over(Window.partitionBy()).alias(f"{c}_all") for c in columns])
    inside = Window.partitionBy("_part").orderBy(by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = placed.join(F.broadcast(starts), "_part")
    return summed.withColumns({f"{c}_upto": F.sum(c).over(inside) + F.col(f"_{c}") for c in columns}).drop(
        "_part", *[f"_{c}" for c in columns])


def violation_counts(responses: DataFrame, rules: DataFrame, text: str) -> DataFrame:
    """Per numeric rule: ``n_amounts`` that break it, and ``n_responses`` with such an amount.

    Amounts are counted as they stand, repeats included; every row of ``responses`` is a response
    of its own.  Rules that nothing breaks, or without a value, have 0.
    """
    numeric = rules.filter(F.col("operator").isin(*fixed.NUMERIC_OPERATORS)).select(
        F.col("id").alias("rule_id"), "operator", F.col("rule_value").cast("double").alias("rule_value"), "description")
    limits = numeric.filter("rule_value IS NOT NULL").select(
        F.col("rule_value").alias("value"), *[F.lit(0).cast("long").alias(c) for c in _COUNTED], F.lit(True).alias("limit"))
    points = _points(responses, text).withColumn("limit", F.lit(False)).unionByName(limits)
    values = points.groupBy("value").agg(*[F.sum(c).alias(c) for c in _COUNTED], F.max("limit").alias("limit"))
    at = running_sums(values, "value", _COUNTED).filter("limit").drop("limit").withColumnRenamed("value", "rule_value")
    met = lookup_join(numeric, cut_lineage(at), ["rule_value"], "left", F.col("rule_id"))

    def broken(above: str, below: str, apart: Column) -> Column:
        over, under = F.col(f"{above}_all") - F.col(f"{above}_upto"), F.col(f"{below}_upto")
        case = F.when(F.col("operator") == "<=", over).when(F.col("operator") == "<", over + F.col(above))
        case = case.when(F.col("operator") == ">=", under - F.col(below)).when(F.col("operator") == ">", under)
        return F.coalesce(case.otherwise(apart), F.lit(0)).cast("long")

    return met.select(
        "rule_id", "operator", "rule_value", "description",
        broken("amounts", "amounts", F.col("amounts_all") - F.col("amounts")).alias("n_amounts"),
        broken("largest", "smallest", F.col("largest_all") - F.col("only")).alias("n_responses"))
