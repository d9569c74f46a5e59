"""Mixing sources to target weights by Pareto order sampling.

A source's target is its weight's share of the words, at most ``repeats`` times what it has;
the excess is shared anew by weight.  A document is expected target / size times: the whole
part of that is certain, the rest is its chance of one more copy.  For that copy documents
are ranked by random odds divided by inclusion odds, and the sample is the head of that
order whose words come to what is missing; where the head ends is found by summing words
over slices of the order, so no task ever sorts a whole source.  One more document, the one
whose size is nearest to the words still missing, closes the gap.  Only built-in functions
are used.

Defined results: a null text has size 0; a null source is a source, last in order; a
document of size 0 gets the certain copies only; repeated rows are documents of their own
but share their random number, so ties go by id and size; an empty table gives no rows;
other columns are not read by ``shares`` and pass through ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardstream.operators.skew import lookup_join
from wardstream.session import cut_lineage

from .common import WORD

WEIGHTS = (5.0, 2.0, 1.0)
REPEATS = 3
SEED = 17
#: Slices of the order that are summed in each of the two steps.
SLICES = 4096
#: Documents that may be taken in after the head, to come nearer to the target.
CLOSINGS = 2


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _key(source: Column) -> Column:
    """Null sources as a key of their own that sorts last."""
    return F.struct(source.isNull().alias("none"), F.coalesce(source, F.lit("")).alias("name"))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, repeats: float = REPEATS) -> DataFrame:
    """key, source_size, target of each source, from one row per source (key, source_size).

    The sharing is repeated until no source is above its bound; a round sums two numbers over
    the sources on the executors.  Sources are numbered in ranges of the order, not in one task.
    """
    spark = sizes.sparkSession
    placed = cut_lineage(sizes.repartitionByRange("key").withColumn("_part", F.spark_partition_id()))
    parts = {r["_part"]: r["n"] for r in placed.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    first, rows = 0, []
    for part in sorted(parts):
        rows.append((part, first))
        first += parts[part]
    starts = spark.createDataFrame(rows, "_part int, _first long")
    nth = F.row_number().over(Window.partitionBy("_part").orderBy("key")) - 1 + F.col("_first")
    ranked = placed.join(F.broadcast(starts), "_part").withColumn("_nth", F.pmod(nth, F.lit(len(weights))).cast("int"))
    weighed = cut_lineage(ranked.select("key", "source_size", F.get(F.array(*map(F.lit, weights)), F.col("_nth")).alias("weight"))
                          .withColumn("bound", repeats * F.col("source_size")))
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    rate, bounded = 0.0, -1
    while True:  # water level: every round either bounds more sources or ends
        full = F.col("bound") <= rate * F.col("weight") if bounded >= 0 else F.lit(False)
        row = weighed.agg(F.count_if(full).alias("n"), F.sum(F.when(full, F.col("bound"))).alias("used"),
                          F.sum(F.when(~full, F.col("weight"))).alias("open")).first()
        if row["n"] == bounded or not row["open"]:
            break
        bounded, rate = row["n"], (total - (row["used"] or 0)) / row["open"]
    # the last level is above every bound that it met, also when all sources are bounded
    level = F.lit(rate) * F.col("weight")
    return weighed.select("key", "source_size", F.least(level, F.col("bound")).cast("double").alias("target"))


def shares(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, repeats: int = REPEATS, id_col: str = "doc_id",
           text_col: str = "text", source_col: str = "source", favour: Column | None = None, seed: int = SEED,
           slices: int = SLICES) -> DataFrame:
    """Per document: doc_id, key, size, source_size, target, copies.

    ``favour`` multiplies a document's inclusion odds for the last copy; by default longer
    documents are favoured by the square root of their length, which leaves short ones to
    close the gap to the target.
    """
    sized = cut_lineage(docs.select(
        F.col(id_col).alias("doc_id"), _key(F.col(source_col)).alias("key"), word_count(F.col(text_col)).alias("size"),
        (favour if favour is not None else F.lit(None)).cast("double").alias("favour")))
    goals = cut_lineage(targets(sized.groupBy("key").agg(F.sum("size").alias("source_size")), weights, repeats))
    ratio = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(repeats)))).otherwise(0.0)
    whole = F.floor(ratio + 1e-12)
    asked = goals.withColumn("whole", whole.cast("long")).withColumn(
        "missing", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0)))
    # the random number is uniform on (0, 1); its odds divided by the inclusion odds are the rank
    u = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(2 ** 52)) + 0.5) / F.lit(2.0 ** 52)
    chance = F.col("missing") / F.col("source_size")
    odds = chance / (1 - chance) * F.coalesce("favour", F.sqrt(F.greatest(F.col("size"), F.lit(1))))
    met = lookup_join(sized, asked, ["key"], "inner", F.xxhash64("doc_id", "size")).withColumn(
        "odds", F.when((F.col("missing") > 0) & (F.col("size") > 0), (u / (1 - u)) / odds))
    met = cut_lineage(met)
    # the logarithm of the odds spreads the order over slices; each step looks into one slice
    place = F.log(F.col("odds"))
    edge = met.filter("odds IS NOT NULL").groupBy("key").agg(F.min(place).alias("low"), F.max(place).alias("high"), F.lit(0).cast("long").alias("below"))
    for _ in range(2):
        edge = cut_lineage(_narrow(met, asked, edge, place, slices))
    inside = _within(met, edge, place)
    order = Window.partitionBy("key").orderBy("odds", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reached = inside.withColumn("sum", F.sum("size").over(order) + F.col("below"))
    # the head ends before the first document that would go over what is missing
    stop = reached.groupBy("key").agg(
        F.min(F.when(F.col("sum") > F.col("missing"), F.struct("odds", "doc_id", "size"))).alias("stop"),
        F.max(F.when(F.col("sum") <= F.col("missing"), F.col("sum"))).alias("sum"), F.first("below").alias("below"), F.first("high").alias("high"))
    ends = cut_lineage(stop.select("key", "stop", "high", F.coalesce("sum", "below").alias("got")))
    rest = lookup_join(met, ends, ["key"], "left", F.xxhash64("doc_id", "size"))
    before = F.struct("odds", "doc_id", "size") < F.col("stop")
    head = F.col("odds").isNotNull() & F.coalesce(before, place <= F.col("high"), F.lit(False))
    chosen = cut_lineage(rest.withColumn("head", head).drop("stop", "high"))
    for _ in range(CLOSINGS):
        chosen = _closed(chosen)
    return chosen.select("doc_id", "key", "size", "source_size", "target", (F.col("whole") + F.col("head").cast("long")).alias("copies"))


def _closed(chosen: DataFrame) -> DataFrame:
    """Takes in one more document of each source, if that brings it nearer to its target."""
    gap = F.col("missing") - F.col("got")
    one = F.struct("odds", "doc_id", "size")
    near = F.min(F.struct(F.abs(gap - F.col("size")).alias("miss"), F.col("odds"), F.col("doc_id"), F.col("size")))
    last = chosen.filter("odds IS NOT NULL AND NOT head").groupBy("key").agg(near.alias("c"), F.max(F.abs(gap)).alias("open")).filter(
        "c.miss < open").select("key", F.struct("c.odds", "c.doc_id", "c.size").alias("close"), F.col("c.size").alias("more"))
    met = lookup_join(chosen, cut_lineage(last), ["key"], "left", F.xxhash64("doc_id", "size"))
    taken = F.col("head") | F.coalesce(one == F.col("close"), F.lit(False))
    return met.withColumns({"head": taken, "got": F.col("got") + F.coalesce("more", F.lit(0))}).drop("close", "more")


def _within(met: DataFrame, edge: DataFrame, place: Column) -> DataFrame:
    """The documents whose place lies in their source's open slice."""
    near = lookup_join(met.filter("odds IS NOT NULL"), edge, ["key"], "inner", F.xxhash64("doc_id", "size"))
    return near.filter((place >= F.col("low")) & (place <= F.col("high")))


def _narrow(met: DataFrame, asked: DataFrame, edge: DataFrame, place: Column, slices: int) -> DataFrame:
    """The slice of the open interval in which the running sum of words passes what is missing."""
    width = F.col("high") - F.col("low")
    nth = F.when(width > 0, F.least(F.floor((place - F.col("low")) / width * slices), F.lit(slices - 1))).otherwise(F.lit(0)).cast("int")
    sums = _within(met, edge, place).groupBy("key", "missing", "below", nth.alias("nth")).agg(
        F.sum("size").alias("n"), F.min(place).alias("low"), F.max(place).alias("high"))
    order = Window.partitionBy("key").orderBy("nth")
    running = sums.withColumn("after", F.sum("n").over(order) + F.col("below"))
    passing = F.struct("nth", "low", "high", (F.col("after") - F.col("n")).alias("below"))
    # a source whose sum never passes keeps its last slice
    return running.groupBy("key").agg(
        F.coalesce(F.min(F.when(F.col("after") > F.col("missing"), passing)), F.max(passing)).alias("s")).select(
            "key", "s.low", "s.high", "s.below")


def mix(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with each document as often as the mix takes it, all columns kept.

    Documents meet their number of copies by id, source and size; rows that repeat all three
    share their copies as evenly as they go.
    """
    dealt = shares(docs, **how)
    id_col, text_col, source_col = how.get("id_col", "doc_id"), how.get("text_col", "text"), how.get("source_col", "source")
    def keyed(df: DataFrame, key: Column, own: Column) -> DataFrame:
        return df.withColumns({"_own": F.struct(own.alias("doc_id"), key.alias("key"), F.col("_size").alias("size"))}).withColumn("_h", F.xxhash64("_own"))

    # one exchange of the texts: the window has the partitions of the join by the key's hash
    own = keyed(docs.withColumn("_size", word_count(F.col(text_col))), _key(F.col(source_col)), F.col(id_col))
    counted = keyed(dealt.withColumnRenamed("size", "_size"), F.col("key"), F.col("doc_id")).groupBy("_h", "_own", "copies").agg(F.count("*").alias("rows"))
    plans = counted.groupBy("_h", "_own").agg(F.sum(F.col("copies") * F.col("rows")).alias("_all"), F.sum("rows").alias("_rows")).select(
        F.col("_h").alias("_hash"), F.col("_own").alias("_theirs"), "_all", "_rows")
    met = own.join(plans, (F.col("_h") == F.col("_hash")) & F.col("_own").eqNullSafe(F.col("_theirs")))
    nth = F.row_number().over(Window.partitionBy("_h", "_own").orderBy(F.lit(0)))
    copies = F.floor(F.col("_all") / F.col("_rows")) + (nth <= F.col("_all") % F.col("_rows")).cast("long")
    return met.withColumn("_copies", copies.cast("int")).select(
        *docs.columns, F.explode(F.array_repeat(F.lit(0), F.col("_copies"))).alias("_copy")).drop("_copy")
