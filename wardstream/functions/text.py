"""Text decoding and normalisation as column expressions.

Everything a Spark built-in can say stays in the JVM.  Entity decoding and NFKC
have no built-in; their Arrow UDFs receive NULL for every row that cannot change.
"""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import bound_batches
from . import fixed
from .bind import bind, let

_LOWER = "abcdefghijklmnopqrstuvwxyz"
_ROT = _LOWER[13:] + _LOWER[:13]
_TURN = str.maketrans(_LOWER, _ROT)
_ALPHABET, _ALPHABET_ROT = _LOWER.upper() + _LOWER, _ROT.upper() + _ROT

# One Base64 quad, then the ways the data can end: padded, or exactly full.
# Possessive groups keep the Java matcher iterative on long texts.
_B64_DATA = "[A-Za-z0-9+/]"
_B64_BODY = (
    "^(?:=*+D=*+D=?+DD)*+(?:=*+D=*+D==|=*+D=*+D=?+D=|=*+$)".replace("D", _B64_DATA)
)

# ASCII and the Latin-1 characters NFKC leaves alone; anything else goes to the UDF.
_NFKC_STABLE = (
    r"^[\x{00}-\x{9F}\x{A1}-\x{A7}\x{A9}\x{AB}-\x{AE}\x{B0}\x{B1}\x{B6}\x{B7}\x{BB}\x{BF}-\x{FF}]*+$"
)


@F.pandas_udf(T.StringType())
def _unescape(text: pd.Series) -> pd.Series:
    return text.map(html.unescape, na_action="ignore")


@F.pandas_udf(T.StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda s: unicodedata.normalize("NFKC", s), na_action="ignore")


def has_keyword(text: Column) -> Column:
    def any_of(lowered: Column) -> Column:
        hit = F.lit(False)
        for word in fixed.KEYWORDS:
            hit = hit | F.contains(lowered, F.lit(word))
        return hit

    return let(F.lower(text), any_of)


def keyword_list(text: Column) -> Column:
    """Keywords found in ``text``, in list order."""
    def found(lowered: Column) -> Column:
        words = [F.when(F.contains(lowered, F.lit(w)), F.lit(w)) for w in fixed.KEYWORDS]
        return F.array_compact(F.array(*words))

    return let(F.lower(text), found)


def _plausible_base64(stripped: Column) -> Column:
    """False only where the first 48 decoded bytes already break UTF-8.

    The head of a decoding is the decoding of the head, so this drops ordinary prose
    after its first line.  Up to three bytes may be the start of a longer character.
    """
    def opens(head: Column) -> Column:
        raw = F.try_to_binary(head, F.lit("base64"))
        cut = [F.is_valid_utf8(F.substring(raw, 1, 48 - k).cast("string")) for k in range(4)]
        return (F.length(head) < 64) | F.contains(head, F.lit("=")) | cut[0] | cut[1] | cut[2] | cut[3]

    cleaned = F.regexp_replace(F.substring(stripped, 1, 240), "[^A-Za-z0-9+/=]+", "")
    return let(F.substring(cleaned, 1, 64), opens)


def base64_candidate(text: Column) -> Column:
    """Lenient Base64: junk skipped, padding completed from the raw length, UTF-8 only."""
    def padding(s: Column) -> Column:
        return F.repeat(F.lit("="), F.pmod(-F.length(s), F.lit(4)))

    def decode(body: Column) -> Column:
        data = F.try_to_binary(F.concat(body, padding(body)), F.lit("base64"))
        return F.try_validate_utf8(data.cast("string"))

    def from_stripped(s: Column) -> Column:
        cleaned = F.regexp_replace(F.concat(s, padding(s)), "[^A-Za-z0-9+/=]+", "")
        body = F.replace(F.nullif(F.regexp_extract(cleaned, _B64_BODY, 0), F.lit("")), F.lit("="), F.lit(""))
        return F.when((F.length(s) == F.octet_length(s)) & _plausible_base64(s), let(body, decode))

    return let(F.btrim(text, F.lit(fixed.WHITESPACE)), from_stripped)


def turned_keyword(text: Column) -> Column:
    """True where the ROT13 of ``text`` holds a keyword.

    The turned keywords are looked for in the text as it is; only the two letters whose
    lower case is ASCII while they are not need the text turned first.
    """
    def found(lowered: Column) -> Column:
        hit = F.lit(False)
        for word in fixed.KEYWORDS:
            hit = hit | F.contains(lowered, F.lit(word.translate(_TURN)))
        return hit

    odd = F.contains(text, F.lit("\u212a")) | F.contains(text, F.lit("\u0130"))
    return F.when(odd, has_keyword(rot13(text))).otherwise(let(F.lower(text), found))


def rot13(text: Column) -> Column:
    return F.translate(text, _ALPHABET, _ALPHABET_ROT)


def percent_decoded(text: Column) -> Column:
    """``%XX`` decoded; ``+`` and stray ``%`` stay as they are."""
    literal_plus = F.replace(text, F.lit("+"), F.lit("%2B"))
    closed = F.regexp_replace(literal_plus, "%(?![0-9A-Fa-f]{2})", "%25")
    return F.try_url_decode(closed)


def _native_decoding(text: Column) -> Column:
    """Struct ``kind, text`` of the first of Base64, ROT13 and percent decoding, else NULL."""
    def made(kind: str, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), value.alias("text"))

    def url(t: Column) -> Column:
        changed = let(percent_decoded(t), lambda u: F.when(u != t, made("url_encoded", u)))
        return F.when(F.contains(t, F.lit("%")), changed)

    def turned(t: Column) -> Column:
        return F.when(turned_keyword(t), let(rot13(t), lambda r: F.when(r != t, made("rot13", r))))

    def first(t: Column) -> Column:
        base = let(base64_candidate(t), lambda b: F.when((b != t) & (F.length(b) > 10), made("base64", b)))
        return F.coalesce(base, turned(t), url(t))

    return let(text, first)


def decode_once(df: DataFrame, source: str, out: str) -> DataFrame:
    """Adds ``out`` (first decoding that applies, else NULL) and ``out_kind``."""
    bound_batches(df.sparkSession)
    native, entity = f"{out}_native", f"{out}_entity"
    text = F.col(source)
    df = bind(df, native, _native_decoding(text))
    gated = F.when(F.col(native).isNull() & F.contains(text, F.lit("&")), text)
    df = df.withColumn(entity, _unescape(gated))
    changed = F.col(entity) != text
    return df.withColumns({
        out: F.coalesce(F.col(f"{native}.text"), F.when(changed, F.col(entity))),
        f"{out}_kind": F.coalesce(F.col(f"{native}.kind"), F.when(changed, F.lit("html_entity"))),
    }).drop(native, entity)


def normalise(df: DataFrame, text: str) -> DataFrame:
    """Adds the normalisation report of ``text`` as ``norm_*`` columns.

    ``norm_text`` (NFKC, invisible characters out, lookalikes to Latin),
    ``norm_encodings`` (array), ``norm_homoglyph``, ``norm_keywords`` (array), ``norm_risk``.
    """
    df = decode_once(df, text, "_d1")
    df = decode_once(df, "_d1", "_d2")
    df = df.withColumn("_plain", F.coalesce("_d2", "_d1", text))
    plain = F.col("_plain")
    # ASCII and most of Latin-1 pass all three folds unchanged; such rows skip them.
    df = bind(df, "_stable", (F.length(plain) == F.octet_length(plain)) | plain.rlike(_NFKC_STABLE))
    df = df.withColumn("_folded", _nfkc(F.when(~F.col("_stable"), plain)))
    folded = F.coalesce("_folded", plain)
    shown = F.translate(F.regexp_replace(folded, fixed.ZERO_WIDTH, ""), fixed.CYRILLIC, fixed.LATIN)
    df = bind(df, "norm_text", F.when(F.col("_stable"), plain).otherwise(shown))
    df = bind(df, "norm_keywords", keyword_list(F.col("norm_text"))).withColumns({
        "norm_homoglyph": F.col("norm_text") != plain,
        "norm_encodings": F.array_compact(F.array("_d1_kind", "_d2_kind")),
    })
    layers = F.size("norm_encodings")
    extra = F.when(layers > 1, 0.1).otherwise(0.0)
    keyed = 0.2 + F.when(layers > 0, 0.3).otherwise(0.0) + extra
    floor = F.when(F.col("norm_homoglyph"), 0.7).otherwise(0.0)
    risk = F.when(F.size("norm_keywords") > 0, F.greatest(keyed, floor)).otherwise(extra)
    df = df.withColumn("norm_risk", F.round(F.least(risk, F.lit(1.0)), 4))
    return df.drop("_d1", "_d2", "_d1_kind", "_d2_kind", "_plain", "_folded", "_stable")


def truncate_output(text: Column, limit: int = fixed.MAX_OUTPUT_CHARS,
                    marker: str = "\n\n[Output truncated]") -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(marker))).otherwise(text)
