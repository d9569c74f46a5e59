"""Ordered personal-data redaction as regular-expression folds.

``(?U)`` gives ``\\b``, ``\\d``, ``\\w`` and ``\\s`` their Unicode meaning on every
Java version.  A row without a digit or an "@" skips the whole fold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fixed
from .bind import bind, let


def _java(pattern: str) -> Column:
    return F.lit("(?U)" + pattern)


def _count(parts: list[Column]) -> Column:
    total = F.lit(0)
    for p in parts:
        total = total + p
    return total.cast("long")


def report(text: Column, patterns: dict[str, str] | None = None) -> Column:
    """Struct ``text, types, count, made``: see ``redact``."""
    steps = list((fixed.PII_PATTERNS if patterns is None else patterns).items())

    def fold(i: int, original: Column, texts: list[Column], hits: list[Column]) -> Column:
        if i < len(steps):
            kind, pattern = steps[i]
            now = texts[-1]
            replaced = F.regexp_replace(now, _java(pattern), F.lit(f"[{kind.upper()}_REDACTED]"))
            if kind in ("email", "upi_vpa"):
                # The patterns need an "@"; the test is far cheaper than the scan.
                replaced = F.when(F.contains(now, F.lit("@")), replaced).otherwise(now)
            return let(replaced, lambda t: fold(i + 1, original, [*texts, t], [*hits, t != now]))
        zero = F.lit(0)
        return F.struct(
            texts[-1].alias("text"),
            F.array_compact(F.array(*[F.when(h, F.lit(k)) for h, (k, _) in zip(hits, steps)])).alias("types"),
            _count([F.when(h, F.regexp_count(original, _java(p))).otherwise(zero)
                    for h, (_, p) in zip(hits, steps)]).alias("count"),
            _count([F.when(h, F.regexp_count(t, _java(p))).otherwise(zero)
                    for h, t, (_, p) in zip(hits, texts, steps)]).alias("made"),
        )

    def whole(t: Column) -> Column:
        none = F.lit(0).cast("long")
        untouched = F.struct(t.alias("text"), F.array().cast("array<string>").alias("types"),
                             none.alias("count"), none.alias("made"))
        return F.when(t.rlike(r"(?U)[\d@]"), fold(0, t, [t], [])).otherwise(untouched)

    return let(text, whole)


def redact(df: DataFrame, text: str, patterns: dict[str, str] | None = None,
           out: str = "redacted") -> DataFrame:
    """Adds ``out``, ``{out}_types`` (array, pattern order), ``{out}_count`` and ``{out}_made``.

    ``_count`` counts matches of the detected types in the original text; ``_made``
    counts the replacements made while folding.
    """
    r = f"_{out}_report"
    return bind(df, r, report(F.col(text), patterns)).withColumns({
        out: F.col(f"{r}.text"), f"{out}_types": F.col(f"{r}.types"),
        f"{out}_count": F.col(f"{r}.count"), f"{out}_made": F.col(f"{r}.made"),
    }).drop(r)


def hits(text: Column, types: Column, patterns: dict[str, str] | None = None) -> Column:
    """Array of ``kind, n``: the matches in ``text`` of each of the detected ``types``.

    Only rows with a type are scanned, and only with its pattern.
    """
    steps = (fixed.PII_PATTERNS if patterns is None else patterns).items()
    return F.array_compact(F.array(*[
        F.when(F.array_contains(types, k), F.struct(F.lit(k).alias("kind"), F.regexp_count(text, _java(p)).cast("long").alias("n")))
        for k, p in steps]))


def route(types: Column) -> Column:
    """A: high-sensitivity types go to the judge; B: others are sanitised; C: classifier."""
    high = F.array(*[F.lit(t) for t in fixed.HIGH_SENSITIVITY])
    return (
        F.when(F.arrays_overlap(types, high), F.lit("A"))
        .when(F.size(types) > 0, F.lit("B"))
        .otherwise(F.lit("C"))
    )
