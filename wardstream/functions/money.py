"""Money amounts in text."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .bind import let

#: Decimal digits of all scripts and their values.
_DIGITS = "".join(c for c in map(chr, range(128, sys.maxunicode + 1)) if unicodedata.category(c) == "Nd")
_VALUES = "".join(str(unicodedata.digit(c)) for c in _DIGITS)


def _number(match: Column) -> Column:
    plain = F.when(match.rlike("^[0-9.]*$"), match).otherwise(F.translate(match, _DIGITS, _VALUES))
    return plain.try_cast("double")


def amounts(text: Column) -> Column:
    """All amounts as ``array<double>``: pattern by pattern, duplicates kept.

    Digits of any script count; what is no number all the same is left out.
    """
    def found(t: Column) -> Column:
        parts = [F.regexp_extract_all(t, F.lit("(?iuU)" + p), F.lit(1)) for p in fixed.AMOUNT_PATTERNS]
        return F.array_compact(F.transform(F.flatten(F.array(*parts)), _number))

    return let(text, found)


def violates(operator: Column, amount: Column, limit: Column) -> Column:
    """True where a numeric rule is broken; operators that are not numeric never are."""
    return (
        F.when(operator == "<=", ~(amount <= limit))
        .when(operator == ">=", ~(amount >= limit))
        .when(operator == "<", ~(amount < limit))
        .when(operator == ">", ~(amount > limit))
        .when(operator == "==", ~(amount == limit))
        .otherwise(F.lit(False))
    )
