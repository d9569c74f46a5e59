"""Indirect-injection markers and multilingual phrases."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .bind import let


def indirect_marker(text: Column, markers: list[str] | None = None) -> Column:
    """The first marker (its source text) found in ``text``, else NULL."""
    def first(t: Column) -> Column:
        chain = F.lit(None).cast("string")
        for source in reversed(fixed.INDIRECT_MARKERS if markers is None else markers):
            chain = F.when(t.rlike("(?isuU)" + source), F.lit(source)).otherwise(chain)
        return chain

    return let(text, first)


def multilang_hit(text: Column, phrases: dict[str, list[str]] | None = None) -> Column:
    """The first language, in table order, one of whose phrases occurs in ``text``."""
    def first(t: Column) -> Column:
        chain = F.lit(None).cast("string")
        for lang, words in reversed(list((phrases or fixed.MULTILANG_PHRASES).items())):
            found = F.lit(False)
            for word in words:
                found = found | F.contains(t, F.lit(word))
            chain = F.when(found, F.lit(lang)).otherwise(chain)
        return chain

    return let(text, first)
