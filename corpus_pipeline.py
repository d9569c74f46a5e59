"""The corpus pipeline: quality rules, near-copies, repeated passages, mixing, packing.

Every stage takes (spark, docs, sf_dir) and reads all that its predecessor kept; all but the
last return the columns of ``documents``.  Stages hand over tables, written as Parquet.

1. quality: documents that the base rule or a certified cutoff rejects go.
2. near_copies: of every component of near-copies the row with the smallest id stays.
3. passages: stretches of over 50 words that strings of 200 bytes that stand twice cover go; a
   character that such a string only touches stays, and n_chars follows the text.
4. mix: documents stand as often as the mix takes them.
5. pack: token pieces with their place in a sequence.

A stage's inner tables are removed when the next stage begins, as by then its result is written;
``run`` removes the result of a stage when the next one is written.  So one pipeline runs at a
time in a session.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from wardstream.llm import jaccard_join, mixing, packing, risk_rules, suffix_dedup
from wardstream.llm.common import bound_batches, table
from wardstream.llm.queries import tokenizer_path
from wardstream.session import cut_lineage, drop_tables, ensure_checkpoint_dir, tables_together

#: A repeated passage has so many words; strings of so many bytes find it, as 51 words have about 300.
PASSAGE_WORDS, PASSAGE_BYTES, PASSAGE_GRAM = 51, 200, 50

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_inner: dict[str, str] = {}


def after(before: str | None) -> Callable[[Stage], Stage]:
    """A stage that begins by removing the inner tables of the stage before it."""
    def wrap(stage: Stage) -> Stage:
        @wraps(stage)
        def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            if before in _inner:
                drop_tables(spark, _inner.pop(before))
            with tables_together(spark) as folder:
                _inner[stage.__name__] = folder
                return stage(spark, docs, sf_dir)

        return run_stage

    return wrap


@after(None)
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are stored with their features, which cutoffs and verdict read; to count them is the costly part."""
    featured = cut_lineage(risk_rules.features(docs))
    cutoffs = cut_lineage(risk_rules.fit(featured, table(spark, sf_dir, "labels")))
    return risk_rules.judge(featured, cutoffs).filter("_q.kept").select(*docs.columns)


def _row_key(docs: DataFrame) -> Column:
    """Id and text of a row as one string that sorts by id, null ids last."""
    own = F.col("doc_id")
    if isinstance(docs.schema["doc_id"].dataType, IntegralType):
        # hexadecimal digits without the sign sort as the numbers do
        own = F.lpad(F.hex(own.cast("long").bitwiseXOR(F.lit(-2 ** 63))), 16, "0")
    name = F.coalesce(F.concat(F.lit("0"), own.cast("string")), F.lit("1"))
    return F.concat(name, F.lit("\0"), F.coalesce(F.sha2(F.encode("text", "UTF-8"), 256), F.lit("")))


@after("quality")
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are told apart by id and text, so rows that repeat an id with another text are
    documents of their own; rows that repeat both are one.  Rows without an id come last in a
    component; without words, too, they are no copies of each other and all stay."""
    bound_batches(spark)
    keyed = docs.withColumn("_key", _row_key(docs))
    joined = cut_lineage(jaccard_join.join(keyed, "_key"))
    gone = joined.filter("component_id <> _key").select("_key").distinct()
    bare = joined.filter("n_shingles = 0").select("_key").distinct().filter(F.col("_key").startswith("1"))
    left = keyed.join(gone, "_key", "left_anti")
    nameless = left.filter("doc_id IS NULL")
    named = left.filter("doc_id IS NOT NULL").unionByName(nameless.join(bare, "_key", "left_anti")).dropDuplicates(["_key"])
    return named.unionByName(nameless.join(bare, "_key", "left_semi")).select(*docs.columns)


@after("near_copies")
def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated passages, as many rows as before; null and short texts stay as they are.
    Passages are judged on the stage's input, all places of a passage go, and copies with over 50 words go whole."""
    bound_batches(spark)
    cut = suffix_dedup.cut_documents(docs, length=PASSAGE_BYTES, gram=PASSAGE_GRAM, least_words=PASSAGE_WORDS)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        cut = cut.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text")).cast(kind))
    return cut.select(*docs.columns)


@after("passages")
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them; see ``mixing``.  Texts without words stay only where a source is taken whole."""
    return mixing.mix(docs)


@after("mix")
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all rows; null and empty texts are one piece with the end token."""
    bound_batches(spark)
    return packing.pack(docs, tokenizer_path())


STAGES = [("quality", quality), ("near_copies", near_copies), ("passages", passages), ("mix", mix), ("pack", pack)]

#: Links, byte strings and tokens are not SQL's.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs, read = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4()}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if read:
            drop_tables(spark, read)
        docs, read = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
