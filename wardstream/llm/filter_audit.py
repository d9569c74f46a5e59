"""How filters interact: what each removes at each place of each order.

One id table is stored per filter, with the ids of the rows that fail it, and one for each
label whose losses are counted.  A row is known by its id and a hash of its text and part, so
rows that repeat an id are told apart, and rows that repeat all three are counted as often.

The id tables meet once, by id.  Rows of one part that fail the same filters are alike in
every order: they form a class with its number of rows and labelled rows, and from then on the
joins are joins of classes, at most 2**filters for each part.  With ``fails`` as the failing
classes of each filter:

* survivors of a prefix are the classes left-anti-joined with the classes that fail one of its filters;
* removed by the next filter are its failing classes left-semi-joined with the survivors, and its
  label losses are their labelled rows;
* redundant are its failing classes left-anti-joined with the survivors.

A prefix is a set, so the orders share the joins; the orders are looked up at the end.

Defined results: a null text is empty, a null part is the empty string; a row without an id has
no smaller id and no labels; an id that labels repeat has each label that any of its rows has;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardstream.operators.skew import lookup_join
from wardstream.session import cut_lineage

from .common import words

#: The thresholds of the filters.
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, MARKS = 200, 50, 2, "[#$%&*|]"
FILTERS = "ABCDE"


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """Per row: doc_id, row, part and, for each filter, whether the row fails it; as a written table."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    counted = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), text.alias("text"), words(text).alias("words"))
    n, distinct = F.size("words"), F.size(F.array_distinct("words"))
    # the text's digest stands for it; 128 bits of SHA-256
    same = F.unhex(F.substring(F.sha2("text", 256), 1, 32))
    seen = cut_lineage(counted.select(
        "doc_id", "part", same.alias("same"), F.xxhash64("same", "part").alias("row"), (n < LEAST_WORDS).alias("A"),
        (100 * distinct < DISTINCT_PERCENT * n).alias("B"),
        (100 * F.regexp_count("text", F.lit("[A-Z]")) > CAPITAL_PERCENT * F.char_length("text")).alias("C"),
        F.col("text").rlike(MARKS).alias("D")))
    first = cut_lineage(seen.groupBy("same").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least <> most").drop("most"))
    met = lookup_join(seen, first, ["same"], "left", F.xxhash64("doc_id", "row"))
    return cut_lineage(met.select("doc_id", "row", "part", "A", "B", "C", "D", F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False)).alias("E")))


def failing_ids(rows: DataFrame, labels: DataFrame, filters: str = FILTERS) -> tuple[DataFrame, dict[str, DataFrame], dict[str, DataFrame]]:
    """The rows, a written id table for each filter, and one each for the labels good and toxic."""
    fails = {f: cut_lineage(rows.filter(F.col(f)).select("doc_id", "row")) for f in filters}
    marks = {"good": labels.filter("quality = 1"), "toxic": labels.filter("toxic = 1")}
    return rows, fails, {m: cut_lineage(rows.select("doc_id", "row").join(ids.select("doc_id").distinct(), "doc_id", "left_semi"))
                         for m, ids in marks.items()}


def classes(rows: DataFrame, fails: dict[str, DataFrame], marks: dict[str, DataFrame]) -> DataFrame:
    """part, bits, n and one count for each mark: the rows of a part that fail the same filters (a bit each)."""
    def told(ids: DataFrame, bit: int, mark: int) -> DataFrame:
        return ids.select("doc_id", "row", F.lit(None).cast("string").alias("part"), F.lit(0).cast("long").alias("n"), F.lit(bit).alias("bits"),
                          F.lit(mark).alias("marks"))

    tables = rows.select("doc_id", "row", "part", F.lit(1).cast("long").alias("n"), F.lit(0).alias("bits"), F.lit(0).alias("marks"))
    for k, ids in enumerate(fails.values()):
        tables = tables.unionByName(told(ids, 1 << k, 0))
    for k, ids in enumerate(marks.values()):
        tables = tables.unionByName(told(ids, 0, 1 << k))
    one = tables.groupBy("doc_id", "row").agg(F.max("part").alias("part"), F.sum("n").alias("n"), F.bit_or("bits").alias("bits"),
                                              F.bit_or("marks").alias("marks"))
    return one.groupBy("part", "bits").agg(F.sum("n").alias("n"), *(
        F.sum(F.when(F.col("marks").bitwiseAND(1 << k) != 0, F.col("n")).otherwise(0)).alias(m) for k, m in enumerate(marks)))


def _rows(spark, rows: list[tuple], schema: str) -> DataFrame:
    """A table of all orders or prefixes, whose size does not depend on the data."""
    return F.broadcast(spark.createDataFrame(rows, schema))


def audit(rows: DataFrame, fails: dict[str, DataFrame], marks: dict[str, DataFrame], orders: list[str] | None = None) -> DataFrame:
    """Per part, order and step: kept, removed, redundant, unique_fails, a loss for each mark, shapley.

    ``orders`` are strings of the filters' letters, by default all permutations; shapley adds
    up what a step's filter removes over all of them.
    """
    spark = rows.sparkSession
    bit = {f: 1 << k for k, f in enumerate(fails)}
    everything = (1 << len(bit)) - 1
    orders = ["".join(p) for p in permutations(bit)] if orders is None else orders
    steps = []
    for order in orders:
        before = 0
        for k, f in enumerate(order):
            steps.append((len(steps), order, k + 1, bit[f], before, before | bit[f]))
            before |= bit[f]
    cells: dict[tuple[int, int], int] = {(everything & ~b, b): 0 for b in bit.values()}
    for _, _, _, b, before, _ in steps:
        cells[before, b] = cells.get((before, b), 0) + 1
    prefixes = sorted({p for s in steps for p in s[4:]} | {p for p, _ in cells})
    counts = ["n", *marks]

    grouped = cut_lineage(classes(rows, fails, marks))
    failing = cut_lineage(grouped.withColumn("filter", F.explode(F.array(*map(F.lit, bit.values())))).filter(
        F.col("bits").bitwiseAND(F.col("filter")) != 0))
    members = _rows(spark, [(p, b) for p in prefixes for b in bit.values() if p & b], "before int, filter int")
    hit = failing.join(members, "filter").select("before", "part", "bits")
    survivors = cut_lineage(grouped.withColumn("before", F.explode(F.array(*map(F.lit, prefixes)))).join(hit, ["before", "part", "bits"], "left_anti"))
    tried = failing.join(_rows(spark, [(*c, n) for c, n in cells.items()], "before int, filter int, times int"), "filter")
    removed = tried.join(survivors.select("before", "part", "bits"), ["before", "part", "bits"], "left_semi")
    redundant = tried.join(survivors.select("before", "part", "bits"), ["before", "part", "bits"], "left_anti")

    def per_cell(found: DataFrame, kind: str) -> DataFrame:
        return found.select("part", "before", "filter", "times", *(
            (F.col(c) if kind == "removed" or c == "n" else F.lit(0)).alias(c) for c in counts), F.lit(kind == "removed").alias("removes"))

    def total(c: str, when: Column) -> Column:
        return F.sum(F.when(when, F.col(c)).otherwise(0)).cast("long")

    cell = per_cell(removed, "removed").unionByName(per_cell(redundant, "redundant")).groupBy("part", "before", "filter", "times").agg(
        total("n", F.col("removes")).alias("removed"), total("n", ~F.col("removes")).alias("redundant"),
        *(total(m, F.col("removes")).alias(f"{m}_lost") for m in marks))
    cell = cut_lineage(cell)
    alone = F.col("before").bitwiseOR(F.col("filter")) == everything
    whole = cell.groupBy("part", "filter").agg(
        total("removed", alone).alias("unique_fails"), F.sum(F.col("removed") * F.col("times")).cast("long").alias("shapley"))
    kept = survivors.groupBy("part", F.col("before").alias("after")).agg(F.sum("n").cast("long").alias("kept"))
    # every part has every step, by number
    grid = grouped.select("part").distinct().withColumn("no", F.explode(F.sequence(F.lit(0), F.lit(max(0, len(steps) - 1))))).join(
        _rows(spark, steps, "no int, filter_order string, step int, filter int, before int, after int"), "no")
    met = grid.join(kept, ["part", "after"], "left").join(cell.drop("times"), ["part", "before", "filter"], "left").join(whole, ["part", "filter"], "left")
    numbers = ["kept", "removed", "redundant", "unique_fails", *(f"{m}_lost" for m in marks), "shapley"]
    return met.select("part", "filter_order", "step", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers))


#: The query on whole tables, by masks of the failed filters.
SQL = r"""
WITH marked AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
             regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
first AS (SELECT text, min(doc_id) AS least FROM d GROUP BY text),
masks AS (
  SELECT d.part, (len(words) < 200)::INT + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INT
         + 4 * (100 * (length(d.text) - length(regexp_replace(d.text, '[A-Z]', '', 'g'))) > 2 * length(d.text))::INT
         + 8 * regexp_matches(d.text, '[#$%&*|]')::INT + 16 * coalesce(d.doc_id > least, false)::INT AS mask,
         coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM d JOIN first USING (text) LEFT JOIN marked USING (doc_id)),
cells AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM masks GROUP BY ALL),
letters(l, b) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders AS (
  SELECT v.l || w.l || x.l || y.l || z.l AS filter_order, [v.b, w.b, x.b, y.b, z.b] AS bits
  FROM letters v, letters w, letters x, letters y, letters z WHERE v.b | w.b | x.b | y.b | z.b = 31),
steps AS (
  SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before
  FROM orders, range(1, 6) AS r(step)),
counted AS (
  SELECT part, filter_order, step, bit,
         sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN mask & before <> 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM cells, steps GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM counted
"""
