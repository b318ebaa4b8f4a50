"""License scans by diagonal voting, in DataFrame operations only.

Every text's rolling word 3-grams are hashed and joined with the positions of the same 3-grams in the templates
(a broadcast table of fixed size); the words themselves are compared too, so that a hash alone decides nothing. Hits
vote for the diagonal (document position minus template position) they lie on. A base phrase stands where one diagonal
has all its 3-grams. For the longer templates, neighbouring diagonals (insertions and deletions of at most `DRIFT` words)
are merged, and a merged span is accepted if it covers enough of the template without being stretched.

Rows are told apart by their place in the input, given as they are read, so votes of rows with equal or null ids don't mix
and no id gathers more than its own text. Read the documents from files, where a row's place stays the same.

Defined results: null counts as empty (no words, no places, empty label lists, score 0); every row yields a row, repeated
ones too. An empty table gives an empty one; texts are scanned whole; ties between labels don't arise, as all are listed;
other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Phrases and labels of the base result.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# Passages that identify further licenses, in lower case without punctuation.
TEMPLATES = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    "apache-2": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "gpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "lgpl": "under the terms of the gnu lesser general public license as published by the free software foundation",
    "mpl-2": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "cc-by": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-sa": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "cc-by-nc": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "cc0": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    "unlicense": "this is free and unencumbered software released into the public domain",
}
K, DRIFT, COVER, STRETCH = 3, 2, 0.7, 1.5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_MARK = "\x01"  # stands before the first word; no word holds it


def template_rows(base: dict[str, str] = BASE, templates: dict[str, str] = TEMPLATES) -> list[tuple]:
    """t (template), label, base, total (3-grams), t_words, tpos, and the three words of each 3-gram."""
    listed = [(label, True, phrase) for phrase, label in base.items()] + [(label, False, text) for label, text in templates.items()]
    rows = []
    for t, (label, own, text) in enumerate(listed):
        w = text.split()
        rows += [(t, label, own, len(w) - K + 1, len(w), i, *w[i : i + K]) for i in range(len(w) - K + 1)]
    return rows


def template_grams(spark, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, "t int, label string, base boolean, total int, t_words int, tpos int, a string, b string, c string").withColumn("h", F.xxhash64("a", "b", "c"))


def scan(docs: DataFrame, base: dict[str, str] = BASE, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    grams = F.broadcast(template_grams(docs.sparkSession, template_rows(base, templates)))

    lowered = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), _UPPER, _LOWER)
    words = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.array_remove(F.split(lowered, _GAP), "").alias("w"))
    marked = words.select("row", "doc_id", F.size("w").cast("long").alias("n_words"), F.concat(F.array(F.lit(_MARK)), "w").alias("w"))
    n = F.size("w")
    zipped = F.arrays_zip(F.col("w").alias("x"), F.slice("w", F.lit(2), n).alias("y"), F.slice("w", F.lit(3), n).alias("z"))
    rolled = marked.select("row", "doc_id", "n_words", F.posexplode(zipped).alias("pos", "g"))
    rolled = rolled.select("row", "doc_id", "n_words", (F.col("pos") - 1).alias("pos"), "g", F.xxhash64("g.x", "g.y", "g.z").alias("rh"))
    same = (F.col("rh") == F.col("h")) & (F.col("g.x") == F.col("a")) & (F.col("g.y") == F.col("b")) & (F.col("g.z") == F.col("c"))
    hits = rolled.join(grams, same, "left").where((F.col("pos") < 0) | F.col("t").isNotNull())  # position -1 keeps every document
    hits = hits.select("row", "doc_id", "n_words", "pos", "t", "label", "base", "total", "t_words", "tpos").repartition("row")

    doc = ["row", "doc_id", "n_words"]
    template = [*doc, "t", "label", "base", "total", "t_words"]
    votes = hits.withColumn("diag", F.col("pos") - F.col("tpos")).groupBy(*template, "diag").agg(F.count(F.lit(1)).alias("votes"), F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    along = Window.partitionBy("row", "t").orderBy("diag")
    near = F.col("diag") - F.lag("diag").over(along) <= DRIFT
    joined = votes.withColumn("fresh", F.when(near & ~F.col("base"), 0).otherwise(1)).withColumn("span", F.sum("fresh").over(along))
    spans = joined.groupBy(*template, "span").agg(F.sum("votes").alias("votes"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("diag").alias("diag"))
    cover = F.least(F.lit(1.0), F.col("votes") / F.col("total"))
    stretched = F.col("hi") - F.col("lo") + K > F.col("t_words") * STRETCH
    spans = spans.withColumn("cover", F.when(F.col("t").isNull() | stretched, 0.0).otherwise(cover))
    place = F.col("base") & (F.col("votes") == F.col("total"))
    good = place | (~F.col("base") & (F.col("cover") >= COVER))
    listed_of = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("label")))), ",")
    return spans.groupBy(*doc).agg(
        F.sum(F.when(place, 1).otherwise(0)).cast("long").alias("n_base"),
        F.min(F.when(place, F.col("lo"))).cast("long").alias("first_word"),
        F.max(F.when(place, F.col("lo"))).cast("long").alias("last_word"),
        listed_of(place).alias("base_labels"),
        listed_of(good).alias("labels"),
        F.round(F.coalesce(F.max("cover"), F.lit(0.0)), 6).alias("score"),
    ).drop("row")
