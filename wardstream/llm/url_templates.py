"""URL verdicts from a tree of path templates.

Urls are counted by (host, path).  Level by level each node of a host's tree looks at the
segments below it: a segment that looks like an identifier, or is rare among very many
siblings, becomes a wildcard.  Then, from the host down, siblings whose labels do not differ
by more than chance are merged into one branch, at every level, with their subtrees.  A
branch's share of blocked labels is smoothed towards its parent's, the host's towards that of
the same template on all hosts, and a template over the limit is rejected.  Urls that a rule decides are labelled by it; the
others take the verdict of their template.  Only built-in functions are used, and every step
works on counts that are combined before the shuffle.

Defined results: null urls and urls without ``://`` have empty host and path and are judged
by the template of the empty host; the tree is as deep as the deepest path, and only if
``depth`` is given do levels beyond it share one wildcard that stands for the whole rest;
a branch without labels has its parent's share; repeated rows count as often as they stand; a template without any
label anywhere is allowed; ties at the limit are allowed; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardstream.session import cut_lineage

from .common import UPPER

#: Rules: (host, path, verdict).
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
SIBLINGS, RARE = 16, 0.05
#: Weight of the prior in labels; share of blocked labels from which a template is rejected; standard errors of "alike".
PRIOR, LIMIT, ALIKE = 4.0, 0.5, 2.0
ANY, REST = "*", "**"
ENDING = r"(\.[A-Za-z][A-Za-z0-9]{0,4})$"


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, UPPER, UPPER.lower())


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null if none does.

    Longer hosts are tried first, then longer paths; all hosts that fit one url are suffixes
    of it, so length decides.
    """
    rule = verdict = F.lit(None).cast("string")
    for name, start, says in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(start)
        rule = F.when(fits, F.lit(name + start)).otherwise(rule)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def _looks_variable(segment: Column) -> Column:
    """Numbers, hexadecimal keys and segments that are mostly digits."""
    stem = F.regexp_replace(segment, ENDING, "")
    digits = F.length(F.regexp_replace(stem, "[^0-9]", ""))
    return (digits * 2 >= F.length(stem)) & (digits > 0) | stem.rlike("^[0-9a-f-]{16,}$")


def _suffix(segment: Column) -> Column:
    """A wildcard that keeps a short file ending."""
    return F.concat(F.lit(ANY), F.regexp_extract(segment, ENDING, 1))


def templates(counted: DataFrame, depth: int | None = None, siblings: int = SIBLINGS, rare: float = RARE) -> DataFrame:
    """host, path, n, good, bad and ``steps``, the template of the path as an array of segments."""
    segments = F.array_remove(F.split("path", "/"), "")
    state = cut_lineage(counted.select("*", segments.alias("segs"), F.array().cast("array<string>").alias("steps")))
    deepest = state.agg(F.max(F.size("segs")).alias("d")).first()["d"] or 0
    levels = deepest if depth is None else min(depth, deepest)
    ended = [state.filter(F.size("segs") == 0)]
    state = state.filter(F.size("segs") > 0)
    for level in range(levels):
        segment = F.get("segs", F.lit(level))
        shown = state.withColumn("seg", F.when(_looks_variable(segment), _suffix(segment)).otherwise(segment))
        below = shown.groupBy("host", "steps", "seg").agg(F.sum("n").alias("c"))
        node = below.groupBy("host", "steps").agg(F.count("*").alias("kinds"), F.sum("c").alias("all"))
        wild = below.join(node, ["host", "steps"]).filter((F.col("kinds") > siblings) & (F.col("c") < rare * F.col("all"))).select(
            "host", "steps", "seg", F.lit(True).alias("wild"))
        met = shown.join(wild, ["host", "steps", "seg"], "left")
        step = F.when(F.col("wild"), _suffix(F.col("seg"))).otherwise(F.col("seg"))
        state = cut_lineage(met.withColumn("steps", F.array_append("steps", step)).drop("seg", "wild").select(*ended[0].columns))
        ended.append(state.filter(F.size("segs") == level + 1))
        state = state.filter(F.size("segs") > level + 1)
    # what is left is deeper than a given depth
    ended.append(state.withColumn("steps", F.array_append("steps", F.lit(REST))))
    return reduce(DataFrame.unionByName, ended).drop("segs")


def _rate(bad: Column, n: Column, prior: Column, weight: float) -> Column:
    return (bad + weight * prior) / (n + weight)


def _alike(nodes: DataFrame, alike: float) -> DataFrame:
    """host, branch, seg, id, bad, labels: labelled siblings; those with one id are one branch.

    Siblings go by their share; one joins the branch before it if the two shares
    are within ``alike`` standard errors.
    """
    share = (F.col("bad") / F.col("labels")).alias("share")
    family = nodes.filter("labels > 0").groupBy("host", "branch").agg(
        F.sort_array(F.collect_list(F.struct(share, "seg", "bad", "labels"))).alias("nodes"))
    none = F.array().cast("array<struct<seg:string,id:int,bad:bigint,labels:bigint>>")

    def add(held: Column, x: Column) -> Column:
        bad, n = held["bad"] + x["bad"], held["labels"] + x["labels"]
        pooled = bad / n
        error = F.sqrt(pooled * (1 - pooled) * (1 / x["labels"] + F.try_divide(F.lit(1.0), held["labels"])))
        joins = F.coalesce(F.abs(x["share"] - F.try_divide(held["bad"], held["labels"])) <= alike * error, F.lit(False))
        at = F.when(joins, held["id"]).otherwise(held["id"] + 1).cast("int")
        return F.struct(
            F.when(joins, bad).otherwise(x["bad"]).alias("bad"), F.when(joins, n).otherwise(x["labels"]).alias("labels"), at.alias("id"),
            F.array_append(held["out"], F.struct(x["seg"].alias("seg"), at.alias("id"), x["bad"].alias("bad"), x["labels"].alias("labels"))).alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("bad"), F.lit(0).cast("long").alias("labels"), F.lit(0).alias("id"), none.alias("out"))
    return family.select("host", "branch", F.inline(F.aggregate("nodes", start, add, lambda held: held["out"])))


def purity(treed: DataFrame, prior: float = PRIOR, alike: float = ALIKE) -> DataFrame:
    """host, steps and ``rate``, the smoothed share of blocked labels of the template.

    Priors go from all urls to a template on all hosts, to the host, to each branch on the
    way down, to the template itself; urls that end at an inner node are a branch below it.
    Counts of all below are rolled up, and siblings that are alike go on as one branch.  A
    branch with all labels of its parent tells nothing new and keeps the parent's share.
    """
    leaf = treed.groupBy("host", "steps").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    leaf = cut_lineage(leaf.withColumn("labels", F.col("good") + F.col("bad")))
    totals = leaf.agg((F.coalesce(F.sum("bad"), F.lit(0)) / F.greatest(F.coalesce(F.sum("labels"), F.lit(0)), F.lit(1))).alias("p"),
                      F.max(F.size("steps")).alias("d")).first()
    everywhere, deepest = totals["p"] or 0.0, totals["d"] or 0
    shape = leaf.groupBy("steps").agg(F.sum("bad").alias("s_bad"), F.sum("labels").alias("s_n"))
    shape = shape.select("steps", _rate(F.col("s_bad"), F.col("s_n"), F.lit(everywhere), prior).alias("shape_rate"))
    hosts = leaf.groupBy("host").agg(F.sum("bad").alias("h_bad"), F.sum("labels").alias("h_n"))
    state = cut_lineage(leaf.join(shape, "steps").join(hosts, "host").select(
        "host", "steps", "bad", "labels", F.lit("").alias("branch"),
        _rate(F.col("h_bad"), F.col("h_n"), F.col("shape_rate"), prior).alias("rate")))
    ended = []
    for level in range(deepest + 1):
        # the empty segment stands for urls that end here
        shown = state.withColumn("seg", F.coalesce(F.get("steps", F.lit(level)), F.lit("")))
        nodes = shown.groupBy("host", "branch", "seg").agg(F.sum("bad").alias("bad"), F.sum("labels").alias("labels"))
        told = cut_lineage(_alike(nodes, alike))
        family = told.groupBy("host", "branch").agg(F.sum("labels").alias("f_n"))
        pools = told.groupBy("host", "branch", "id").agg(F.sum("bad").alias("b_bad"), F.sum("labels").alias("b_n"))
        known = told.select("host", "branch", "seg", "id").join(pools, ["host", "branch", "id"]).join(family, ["host", "branch"])
        met = shown.join(known, ["host", "branch", "seg"], "left")
        news = F.coalesce(F.col("b_n") < F.col("f_n"), F.lit(False))
        rate = F.when(news, _rate(F.col("b_bad"), F.col("b_n"), F.col("rate"), prior)).otherwise(F.col("rate"))
        branch = F.concat("branch", F.lit("/"), F.coalesce(F.concat(F.lit("#"), F.col("id").cast("string")), F.concat(F.lit("="), F.col("seg"))))
        state = cut_lineage(met.select("host", "steps", "bad", "labels", branch.alias("branch"), rate.alias("rate")))
        ended.append(state.filter(F.size("steps") <= level))
        state = state.filter(F.size("steps") > level)
    return reduce(DataFrame.unionByName, ended).select("host", "steps", "rate")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url",
          limit: float = LIMIT, labels: DataFrame | None = None, **how) -> DataFrame:
    """page_id, host, path, rule, verdict, template, rate.

    ``labels`` (id, bad 0/1) may replace the rules' own verdicts as labels.
    """
    located = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    ruled = located.withColumns({"rule": rule, "ruled": verdict})
    if labels is None:
        labelled = ruled.withColumn("bad", (F.col("ruled") == "block").cast("int"))
    else:
        told = labels.groupBy(F.col(id_col).alias("page_id")).agg(F.max("bad").cast("int").alias("bad"))
        labelled = ruled.join(told, "page_id", "left")
    labelled = cut_lineage(labelled)
    counted = labelled.groupBy("host", "path").agg(
        F.count("*").alias("n"), F.count_if(F.col("bad") == 0).alias("good"), F.count_if(F.col("bad") == 1).alias("bad"))
    tree_how = {k: v for k, v in how.items() if k in ("depth", "siblings", "rare")}
    treed = templates(counted, **tree_how)
    rates = purity(treed, **{k: v for k, v in how.items() if k in ("prior", "alike")})
    judged = cut_lineage(treed.join(rates, ["host", "steps"]).select(
        "host", "path", F.concat(F.lit("/"), F.array_join("steps", "/")).alias("template"), "rate"))
    met = labelled.join(judged, ["host", "path"], "left")
    said = F.when(F.col("rate") > limit, "block").otherwise("allow")
    return met.select("page_id", "host", "path", "rule", F.coalesce("ruled", said).alias("verdict"), "template", "rate")
