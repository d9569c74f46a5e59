"""License notices found by diagonal voting.

All rolling word k-grams of the texts meet the positions of the same k-grams in the
template notices in one join.  A match at text position p and template position t votes
for the diagonal p - t; votes are summed per (text, template, diagonal), neighbouring
diagonals are merged (words put in or left out shift a copy by a few words), and a merged
span counts when enough of its template stands in it and it is not much longer than that.

Besides, phrases that stand word for word give base labels in the row.  Only built-in
functions are used.  Texts are told apart by two 64-bit hashes, so copies are scanned for
spans once per text and hits never carry the text.

Defined results: null and empty texts have no words and no labels; repeated rows get equal
results; very long texts are scanned whole; ties cannot arise, because labels are a sorted
set; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardstream.functions.bind import bind

from .common import lower_ascii

#: Separators of words, and phrases with their labels.
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Wording of common notices, one or more per label.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
            "documentation files the software to deal in the software without restriction"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd-3", "redistribution and use in source and binary forms with or without modification are permitted provided that "
              "the following conditions are met"),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
              "public license as published by the free software foundation either version 3 of the license"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("all-rights-reserved", "all rights reserved no part of this publication may be reproduced"),
]
GRAM = 3
#: Diagonals this near are one copy; share of a template's k-grams that a span needs; its length against the template's.
BAND, COVERED, STRETCH = 3, 0.6, 1.5


def scan_words(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), NO_WORD), "")


def text_key(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("_k1"), F.xxhash64(F.lit(7), text).alias("_k2")]


def template_grams(spark: SparkSession, templates: list[tuple[str, str]] = TEMPLATES, gram: int = GRAM) -> DataFrame:
    """One row per k-gram place of the fixed templates: a few hundred rows, whatever the corpus."""
    rows = [(no, label, at, len(ws), *ws[at:at + gram]) for no, (label, text) in enumerate(templates)
            for ws in [text.split()] for at in range(len(ws) - gram + 1)]
    columns = [f"_w{i}" for i in range(gram)]
    df = spark.createDataFrame(rows, "template int, label string, t_pos int, t_words int, " + ", ".join(f"{c} string" for c in columns))
    return df.select("template", "label", "t_pos", "t_words", F.xxhash64(*columns).alias("_h"), F.hash(*columns).alias("_v"))


def spans(docs: DataFrame, text_col: str = "text", templates: list[tuple[str, str]] = TEMPLATES, gram: int = GRAM,
          band: int = BAND, covered: float = COVERED, stretch: float = STRETCH) -> DataFrame:
    """Verified spans per text: _k1, _k2, label, start, end, coverage.

    Both hashes of a k-gram must agree for a vote.  Coverage counts distinct template
    places, so a repeated word run does not make up for missing ones.
    """
    worded = bind(docs.select(*text_key(F.col(text_col)), F.col(text_col).alias("_t")), "_ws", scan_words(F.col("_t"))).drop("_t")

    def rolled(w: Column, i: Column) -> Column:
        run = [w, *(F.get("_ws", i + k) for k in range(1, gram))]
        return F.struct(F.xxhash64(*run).alias("h"), F.hash(*run).alias("v"))

    whole = F.slice(F.transform("_ws", rolled), 1, F.greatest(F.size("_ws") - (gram - 1), F.lit(0)))
    grams = worded.select("_k1", "_k2", F.posexplode(whole).alias("pos", "g")).select("_k1", "_k2", "pos", "g.h", "g.v")
    known = F.broadcast(template_grams(docs.sparkSession, templates, gram))
    hits = grams.join(known, (F.col("h") == F.col("_h")) & (F.col("v") == F.col("_v")))
    places = hits.groupBy("_k1", "_k2", "template", "label", "t_words", (F.col("pos") - F.col("t_pos")).alias("diagonal")).agg(
        F.collect_set("t_pos").alias("at"), F.min("pos").alias("start"), F.max("pos").alias("last"))
    along = Window.partitionBy("_k1", "_k2", "template").orderBy("diagonal")
    fresh = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(along) > band).cast("int"), F.lit(1))
    merged = places.withColumn("_new", fresh).withColumn("_run", F.sum("_new").over(along)).groupBy(
        "_k1", "_k2", "template", "label", "t_words", "_run").agg(
            F.array_distinct(F.flatten(F.collect_list("at"))).alias("at"), F.min("start").alias("start"),
            (F.max("last") + gram).alias("end"))
    coverage = F.size("at") / (F.col("t_words") - (gram - 1))
    return merged.select("_k1", "_k2", "label", "start", "end", coverage.alias("coverage")).filter(
        (F.col("coverage") >= covered) & (F.col("end") - F.col("start") <= F.col("t_words") * stretch + band))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] = PHRASES, **how) -> DataFrame:
    """Per document: n_words, n_base, first_word, last_word, base_labels, labels, score.

    score is 1 where a phrase stands word for word, else the best coverage of a span, else 0.
    """
    text = F.col(text_col)
    worded = bind(docs.select(F.col(id_col), *text_key(text), text.alias("_t")), "_ws", scan_words(F.col("_t"))).drop("_t")
    line = F.concat(F.lit(" "), F.array_join("_ws", " "), F.lit(" "))
    worded = bind(worded, "_in", F.array(*(F.contains(line, F.lit(f" {p} ")) for p in phrases)))

    def places(no: int, phrase: str) -> Column:
        run = phrase.split()

        def stands(i: Column) -> Column:
            same = F.get("_ws", i) == run[0]
            for k, w in enumerate(run[1:], 1):
                same = same & (F.get("_ws", i + k) == w)
            return same

        found = F.filter(F.sequence(F.lit(0), F.size("_ws") - len(run)), stands)
        return F.when(F.get("_in", F.lit(no)), found).otherwise(F.array().cast("array<int>"))

    marks = [F.when(F.get("_in", F.lit(no)), F.lit(label)) for no, label in enumerate(phrases.values())]
    based = bind(worded, "_at", F.concat(*(places(no, p) for no, p in enumerate(phrases)))).select(
        F.col(id_col), "_k1", "_k2", F.size("_ws").cast("long").alias("n_words"), F.size("_at").cast("long").alias("n_base"),
        F.array_min("_at").cast("long").alias("first_word"), F.array_max("_at").cast("long").alias("last_word"),
        F.array_sort(F.array_distinct(F.array_compact(F.array(*marks)))).alias("_base"))
    found = spans(docs, text_col, **how).groupBy("_k1", "_k2").agg(
        F.collect_set("label").alias("_more"), F.max("coverage").alias("_best"))
    none = F.array().cast("array<string>")
    return based.join(found, ["_k1", "_k2"], "left").select(
        id_col, "n_words", "n_base", "first_word", "last_word", F.array_join("_base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("_base", F.coalesce("_more", none))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("_best", F.lit(0.0))).alias("score"))
