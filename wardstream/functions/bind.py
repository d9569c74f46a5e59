"""Evaluating an expensive value once, inside an expression or in a table.

The optimizer copies column expressions into the filters and UDF arguments that use
them.  For a regular-expression fold over long texts every copy is a full evaluation.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value`` with ``value`` evaluated once; a chain of these has linear size."""
    return F.element_at(F.transform(F.array(value), body), 1)


def bind(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is evaluated once per row, where it stands in the plan.

    A one-element generator is a step the optimizer neither merges nor copies; filters on
    other columns still move below it.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))
