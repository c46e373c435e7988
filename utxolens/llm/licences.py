"""Licence scans by diagonal voting, in DataFrame operations only.

Every run of ``K`` words of a text is hashed; those with the hash of a run of
the templates are joined with them (a fixed, small list, so that side is
broadcast), and the words are compared after the hash. A match of text place p with template place q votes
for the diagonal p - q. Votes are summed per document, template and diagonal;
diagonals at most ``SLACK`` words apart are merged, so an inserted or missing
word does not split a span; a merged span is verified by the share of the
template's words that its matched runs cover and by its length.

Matches are few against the words read, and only they and one narrow row per
document are shuffled. Documents are told apart by doc_id and text hash, so
repeated rows share one set of matches and all get its result.

Edge cases: a null text has no words; texts shorter than a run have no votes; a
null doc_id is a key like any other; an empty table stays empty; other columns
take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import let, materialize, text_or_empty

K = 3                     # words of a run
SLACK = 2                 # words between diagonals that are merged
COVER = 0.7               # share of a template's words a span has to cover
STRETCH = 1.5             # longest span, in lengths of the template

#: fixed values: phrases of the base labels
PHRASES = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}

#: fixed values: the usual notices of public licences
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain "
                   "a copy of the license at"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed "
                   "under the license is distributed on an as is basis without warranties or "
                   "conditions of any kind either express or implied"),
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this "
            "software and associated documentation files the software to deal in the software "
            "without restriction"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl-3.0", "this program is free software you can redistribute it and or modify it under the "
                "terms of the gnu general public license as published by the free software "
                "foundation either version 3 of the license or at your option any later version"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are "
            "permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or "
            "without fee is hereby granted"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc-by-4.0", "licensed under cc by 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0"),
    ("cc0", "this work is dedicated to the public domain under cc0"),
]

_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def normal_words(text: str) -> Column:
    """Lower-cased words of digits, letters a-z and all non-ASCII characters.

    Lower-casing is Spark's: beyond A-Z it changes the spelling of words, but
    never where a word starts or ends nor a match with an ASCII phrase."""
    parts = F.split(F.lower(text_or_empty(text)), _GAP)
    return F.filter(parts, lambda w: w != "")


def runs(w: Column, k: int = K) -> Column:
    """(place, hash, words) of each run of ``k`` words."""
    return F.when(F.size(w) >= k, F.transform(
        F.sequence(F.lit(0), F.size(w) - k),
        lambda i: F.struct(i.alias("p"), F.xxhash64(*[F.get(w, i + j) for j in range(k)]).alias("h"),
                           ))).otherwise(F.array().cast("array<struct<p:int,h:bigint>>"))


def template_runs(spark: SparkSession, templates=TEMPLATES, k: int = K) -> DataFrame:
    """(tid, q, run, h) of every run of the templates: as many rows as they have words."""
    rows = [f"({t}, {q}, '{' '.join(ws[q:q + k])}')" for t, (_, text) in enumerate(templates)
            for ws in [text.split()] for q in range(len(ws) - k + 1)]
    return spark.sql(f"select * from values {', '.join(rows)} as t(tid, q, run)").withColumn(
        "h", F.xxhash64(*[F.get(F.split("run", " "), F.lit(j)) for j in range(k)]))


def phrase_places(w: Column, phrase: str) -> Column:
    """Places (words from 0) where the phrase's words stand one after another."""
    ws = phrase.split()
    first = [F.lit(x) for x in ws]
    joined = F.concat(F.lit(" "), F.array_join(w, " "), F.lit(" "))

    def here(i: Column) -> Column:
        test = F.get(w, i) == first[0]
        for j in range(1, len(ws)):
            test = test & (F.get(w, i + j) == first[j])
        return F.coalesce(test, F.lit(False))

    return F.when(F.contains(joined, F.lit(f" {phrase} ")), F.filter(
        F.sequence(F.lit(0), F.size(w) - 1), here)).otherwise(F.array().cast("array<int>"))


def votes(docs: DataFrame, templates=TEMPLATES, *, key: str = "doc_id", text: str = "text",
          k: int = K, slack: int = SLACK) -> DataFrame:
    """Merged diagonals: key, text hash, template, votes and the span's words."""
    known = template_runs(docs.sparkSession, templates, k)
    hashes = [r.h for r in known.select("h").distinct().collect()]       # the templates' words, at most

    def hits(w: Column) -> Column:
        """Runs whose hash a template has, with their own words: a row carries
        no more of its text, so the work grows with the text's length."""
        return F.transform(F.filter(runs(w, k), lambda x: x["h"].isin(hashes)), lambda x: F.struct(
            x["p"].alias("p"), x["h"].alias("h"),
            F.array_join(F.slice(w, x["p"] + 1, F.lit(k)), " ").alias("here")))

    own = docs.select(F.col(key).alias("key"), F.xxhash64(text_or_empty(text)).alias("h0"),
                      F.explode(let(normal_words(text), hits)).alias("x"))
    # joined by hash; the words are compared for what the hash lets through
    here = F.col("x.here")
    same = F.coalesce(here.startswith(F.col("run")) & F.col("run").startswith(here), F.lit(False))
    found = (own.join(F.broadcast(known), (F.col("x.h") == F.col("h")) & same)
             .select("key", "h0", "tid", F.col("x.p").alias("p"), "q")
             .distinct())                              # repeated rows match alike: once is enough
    by_diagonal = found.groupBy("key", "h0", "tid", (F.col("p") - F.col("q")).alias("d")).agg(
        F.count(F.lit(1)).alias("n"), F.min("p").alias("first"), F.max("p").alias("last"),
        F.collect_set("q").alias("qs"))                # at most the template's length
    order = Window.partitionBy("key", "h0", "tid").orderBy("d")
    marked = by_diagonal.withColumn(
        "new", F.coalesce(F.col("d") - F.lag("d").over(order) > slack, F.lit(True)).cast("int"))
    merged = marked.withColumn("run_no", F.sum("new").over(order))
    return merged.groupBy("key", "h0", "tid", "run_no").agg(
        F.sum("n").alias("votes"), F.min("first").alias("start"),
        (F.max("last") + k).alias("stop"),
        F.array_distinct(F.flatten(F.collect_list("qs"))).alias("qs"))


def verified(merged: DataFrame, templates=TEMPLATES, k: int = K, cover: float = COVER,
             stretch: float = STRETCH) -> DataFrame:
    """Spans whose matched runs cover enough of the template."""
    of = [F.array(*[F.lit(x) for x in xs]) for xs in
          ([name for name, _ in templates], [len(t.split()) for _, t in templates])]
    merged = merged.withColumns({"label": F.get(of[0], F.col("tid")),
                                 "size": F.get(of[1], F.col("tid"))})
    places = F.array_distinct(F.flatten(F.transform(
        F.col("qs"), lambda q: F.sequence(q, q + F.lit(k - 1)))))
    share = F.size(places) / F.col("size")
    return merged.withColumn("score", F.round(share, 6)).where(
        (share >= cover) & (F.col("stop") - F.col("start") <= stretch * F.col("size") + SLACK))


def scan(docs: DataFrame, *, key: str = "doc_id", text: str = "text",
         templates=TEMPLATES) -> DataFrame:
    """One row per document: key, n_words, n_base, first_word, last_word,
    base_labels, labels and score (of the best span; 1 for a base phrase)."""
    def places(w: Column) -> Column:
        return F.struct(*[phrase_places(w, p).alias(n) for n, p in PHRASES.items()])

    base = docs.select(F.col(key).alias("key"), F.xxhash64(text_or_empty(text)).alias("h0"),
                       normal_words(text).alias("w")).select(
        "key", "h0", F.size("w").cast("bigint").alias("n_words"),
        let(F.col("w"), places).alias("at"))
    every = F.concat(*[F.col(f"at.{n}") for n in PHRASES])
    own = F.filter(F.array(*[F.when(F.size(f"at.{n}") > 0, F.lit(n)) for n in PHRASES]),
                   lambda x: x.isNotNull())
    base = base.select("key", "h0", "n_words", F.size(every).cast("bigint").alias("n_base"),
                       F.array_min(every).cast("bigint").alias("first_word"),
                       F.array_max(every).cast("bigint").alias("last_word"), own.alias("own"))
    # few rows; written, so that rows of one id and text can be split in the join
    spans = materialize(docs.sparkSession, verified(
        votes(docs, templates, key=key, text=text), templates).groupBy("key", "h0").agg(
        F.collect_set("label").alias("found"), F.max("score").alias("best")), "licences")
    j = base.join(spans.select(F.col("key").alias("k2"), F.col("h0").alias("h2"), "found", "best"),
                  F.col("key").eqNullSafe(F.col("k2")) & (F.col("h0") == F.col("h2")), "left")
    none = F.array().cast("array<string>")
    return j.select(
        F.col("key").alias(key), "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort("own"), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_distinct(F.concat("own", F.coalesce("found", none)))), ",")
        .alias("labels"),
        F.greatest(F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.lit(0.0)),
                   F.least(F.coalesce("best", F.lit(0.0)), F.lit(1.0))).alias("score"))
