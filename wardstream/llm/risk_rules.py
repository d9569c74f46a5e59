"""Quality rules whose cutoffs bound the share of good documents they reject.

Features are counted in each row.  A rule rejects documents whose score lies over a cutoff.
On labelled documents the exact binomial tail tells, for every (stratum, rule, cutoff),
whether the share of good documents over the cutoff can be called at most ``risk / rules``;
the error of all these tests together is held at ``error`` by dividing it among them.  The
lowest certified cutoff that also has a lift over the good documents is used; a stratum with
too few labels gets no cutoff and loses nothing.  Cutoffs come from fixed grids, so all
labelled documents are a holdout for them.  Only built-in functions are used.

Defined results: null and empty texts have no words and fail the base rule; a null stratum
is a stratum of its own; a document with labels that contradict each other counts as good;
scores equal to a cutoff pass; repeated rows get equal results; other columns pass through
``features`` and ``judge`` (those named ``_q`` and ``_stratum`` excepted).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardstream.functions.bind import bind, let
from wardstream.operators.skew import lookup_join

from .common import SPACE_RUN, words

WINDOW = 8
LEAST_WORDS, MOST_REPEATED = 20, 30
RISK, ERROR, LIFT = 0.01, 0.05, 5.0

_RATE = [0.01 * x for x in (2, 3, 4, 5, 6, 8, 10, 12, 15, 20, 25, 30)]
#: Rules and the grids of their cutoffs, lowest first.
RULES: dict[str, tuple[str, list[float]]] = {
    "symbols": ("_q.n_symbols / greatest(_q.word_chars, 1)", _RATE),
    "repeats": ("_q.n_repeat_words / greatest(_q.n_words, 1)", _RATE),
    "dup_lines": ("_q.n_dup_lines / greatest(_q.n_words, 1)", _RATE),
    "long_words": ("_q.word_chars / greatest(_q.n_words, 1)", [6.0, 6.5, 7.0, 7.5, 8.0, 8.5, 9.0, 10.0, 12.0, 14.0, 17.0, 20.0]),
}


def _repeated_words(grams: Column) -> Column:
    """Words inside windows that occur twice or more, from the hashes of all windows in order."""
    def body(g: Column) -> Column:
        pairs = F.sort_array(F.zip_with(g, F.sequence(F.lit(0), F.size(g) - 1),
                                        lambda h, p: F.struct(h.alias("h"), p.alias("p"))))
        none = F.array().cast("array<int>")
        twins = let(pairs, lambda s: F.flatten(F.zip_with(
            s, F.slice(s, 2, F.size(s)), lambda a, b: F.when(a["h"] == b["h"], F.array(a["p"], b["p"])).otherwise(none))))
        steps = let(F.sort_array(F.array_distinct(twins)), lambda p: F.zip_with(
            p, F.slice(p, 2, F.size(p)), lambda a, b: F.coalesce(F.least(b - a, F.lit(WINDOW)), F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0), lambda n, x: n + x)

    return F.when(F.size(F.array_distinct(grams)) < F.size(grams), body(grams)).otherwise(F.lit(0))


def features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with a struct ``_q`` of the base counts and base_failed.

    Window hashes are built by doubling: hashes of 1, 2, 4 and 8 words, each from two of the
    step before.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = bind(docs, "_ws", words(text))
    df = bind(df, "_h", F.transform("_ws", lambda w: F.xxhash64(w)))
    for span in (1, 2, 4):
        both = F.zip_with("_h", F.slice("_h", span + 1, F.greatest(F.size("_h"), F.lit(1))), lambda a, b: F.xxhash64(a, b))
        df = bind(df, "_g", both).drop("_h").withColumnRenamed("_g", "_h")
    df = bind(df, "_g", F.slice("_h", 1, F.greatest(F.size("_h") - (WINDOW - 1), F.lit(0)))).drop("_h")
    lines = let(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
                lambda x: F.size(x) - F.size(F.array_distinct(x)))
    n_words, repeated = F.size("_ws"), _repeated_words(F.col("_g"))
    counts = F.struct(
        n_words.cast("long").alias("n_words"), F.char_length(F.regexp_replace(text, SPACE_RUN, "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"), lines.cast("long").alias("n_dup_lines"),
        repeated.cast("long").alias("n_repeat_words"))
    df = bind(df, "_q", counts).drop("_ws", "_g")
    failed = (F.col("_q.n_words") < LEAST_WORDS) | (100 * F.col("_q.n_repeat_words") > MOST_REPEATED * F.col("_q.n_words"))
    return df.withColumn("_q", F.col("_q").withField("base_failed", failed))


def _log_gamma(x: Column) -> Column:
    """ln Γ(x) for x >= 1 by Stirling's series at x + 8."""
    y = x + 8
    shift = sum((F.log(x + k) for k in range(1, 8)), F.log(x))
    series = 1 / (12 * y) - 1 / (360 * F.pow(y, 3)) + 1 / (1260 * F.pow(y, 5)) - 1 / (1680 * F.pow(y, 7))
    return (y - 0.5) * F.log(y) - y + 0.9189385332046727 + series - shift


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X of n trials with chance p, for k below n * p; 1 elsewhere.

    Terms fall from k downwards; those further than 40 standard deviations, below the
    precision of a double, are left out.
    """
    k, n = k.cast("double"), n.cast("double")
    top = (_log_gamma(n + 1) - _log_gamma(k + 1) - _log_gamma(n - k + 1)
           + k * F.log(F.lit(p)) + (n - k) * F.log1p(F.lit(-p)))
    least = F.greatest(F.lit(0.0), k - 40 * F.sqrt(n * p * (1 - p)) - 100)
    start = F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("sum"))

    def step(s: Column, i: Column) -> Column:
        ratio = i * (1 - p) / ((n - i + 1) * p)
        return F.struct((s["term"] * ratio).alias("term"), (s["sum"] + s["term"]).alias("sum"))

    total = F.aggregate(F.sequence(k.cast("long"), least.cast("long"), F.lit(-1)), start, step, lambda s: s["sum"])
    return F.when(k < n * p, F.least(F.lit(1.0), F.exp(top) * total)).otherwise(F.lit(1.0))


def _stratum(column: str | None) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit("")) if column else F.lit("")


def fit(featured: DataFrame, labels: DataFrame, stratum_col: str | None = "lang", id_col: str = "doc_id", risk: float = RISK,
        error: float = ERROR, lift: float = LIFT) -> DataFrame:
    """Cutoffs: _stratum, and a map ``cutoffs`` from rule to cutoff (rules without one are absent)."""
    truth = labels.filter("quality IS NOT NULL").groupBy(F.col(id_col).alias("_id")).agg((F.max("quality") == 1).alias("good"))
    over = [F.struct(F.lit(name).alias("rule"), sum((F.expr(f"{score} > {c}D").cast("int") for c in grid), F.lit(0)).alias("n_over"))
            for name, (score, grid) in RULES.items()]
    scored = featured.filter("NOT _q.base_failed").select(
        F.col(id_col).alias("_id"), _stratum(stratum_col).alias("_stratum"), F.array(*over).alias("r"))
    counts = scored.join(truth, "_id").select("_stratum", "good", F.explode("r").alias("r")).groupBy(
        "_stratum", "r.rule", "r.n_over").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    grid = F.create_map(*(x for name, (_, g) in RULES.items() for x in (F.lit(name), F.array(*map(F.lit, g)))))
    group = Window.partitionBy("_stratum", "rule")
    totals = counts.withColumns({"n_good": F.sum("good").over(group), "n_bad": F.sum("bad").over(group)})
    # a document over n cutoffs is over cutoff 0 to n - 1
    each = totals.filter("n_over > 0").withColumn("cut", F.explode(F.sequence(F.lit(0), F.col("n_over") - 1)))
    zero = totals.groupBy("_stratum", "rule", "n_good", "n_bad").agg(F.lit(0).alias("_")).select(
        "_stratum", "rule", "n_good", "n_bad", F.posexplode(grid[F.col("rule")]).alias("cut", "cutoff"))
    hits = each.groupBy("_stratum", "rule", "cut").agg(F.sum("good").alias("k"), F.sum("bad").alias("b"))
    tested = zero.join(hits, ["_stratum", "rule", "cut"], "left").fillna(0, ["k", "b"])
    n_tests = tested.agg(F.count("*")).first()[0] or 1
    certified = binomial_tail(F.col("k"), F.col("n_good"), risk / len(RULES)) <= error / n_tests
    useful = F.col("b") * F.col("n_good") > lift * F.col("k") * F.col("n_bad")
    return tested.filter(certified & useful).groupBy("_stratum", "rule").agg(F.min("cutoff").alias("cutoff")).groupBy(
        "_stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cutoffs"))


def judge(featured: DataFrame, cutoffs: DataFrame, stratum_col: str | None = "lang", id_col: str = "doc_id") -> DataFrame:
    """``featured`` with ``_q.kept``: neither the base rule nor a cutoff of the stratum rejects it."""
    over = F.lit(False)
    for name, (score, _) in RULES.items():
        over = over | F.coalesce(F.expr(score) > F.element_at("cutoffs", name), F.lit(False))
    met = lookup_join(featured.withColumn("_stratum", _stratum(stratum_col)), cutoffs, ["_stratum"], "left", F.col(id_col))
    return met.withColumn("_q", F.col("_q").withField("kept", ~F.col("_q.base_failed") & ~over)).drop("_stratum", "cutoffs")
