"""License scans as an exact set-similarity join, with DataFrame functions only.

A text block (a line, or a paragraph between blank lines) carries a template's label when
it holds at least `CONTAINMENT` of the template's distinct words, `need` of them. Template
words are ordered by how many documents hold them, rarest first, over the whole corpus.
A block that misses at most |T| - need words of a template must hold one of its
|T| - need + 1 rarest (prefix filter): blocks are posted under the words that are in any
template's prefix, and joined with the prefixes on the word. A block needs `need` words of
templates at all (length filter). At the rarest word that both hold, what follows it in the
template and what follows it in the block must together still reach `need` (positional
filter, on both sides' places). What passes is counted exactly, so the filters change the
work and not the result.

Templates are a parameter, so their words bound everything that is collected or carried
to the tasks. Base labels come from fixed phrases and always stay. Null text is empty:
no words, no labels, score 0. Rows are independent; repeated rows give a result each.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociq.llm.common import cut, text_or_empty

#: What separates words after lower-casing, as a pattern.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases and their labels (fixed values).
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: Sentences of well-known licences (fixed values).
TEMPLATES = (
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("mit", "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)
CONTAINMENT = 0.8


def words_of(text: str) -> list[str]:
    return sorted({w for w in re.split(BREAK, text.lower()) if w})


def words(column: str) -> Column:
    return F.filter(F.split(F.lower(column), BREAK), lambda w: w != "")


def texts(values) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def rarity(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """Documents that hold each of the templates' words: a row per word at most."""
    held = docs.select(F.explode(F.array_intersect("words", texts(vocabulary))).alias("word"))
    found = {r.word: r.n for r in held.groupBy("word").agg(F.count("*").alias("n")).collect()}
    return {w: found.get(w, 0) for w in vocabulary}


def matches(blocks: DataFrame, templates: DataFrame) -> DataFrame:
    """(key, label, share) of the documents with a block that holds enough of a template.
    blocks: (key, words), the template words of a block, rarest first; templates:
    (template, label, ordered, need), as bounded as the templates are."""
    prefixes = templates.select("template", "need", F.size("ordered").alias("whole"), F.posexplode(F.expr("slice(ordered, 1, size(ordered) - need + 1)")).alias("at_template", "word"))
    posted = blocks.select("key", "words", F.posexplode("words").alias("at_block", "word"))
    met = posted.join(F.broadcast(prefixes), "word").where(F.size("words") >= F.col("need"))
    # Both sides' places at their rarest common word.
    pairs = met.groupBy("key", "words", "template").agg(F.min(F.struct("at_template", "at_block", "whole", "need")).alias("m"))
    left = F.least(F.col("m.whole") - F.col("m.at_template"), F.size("words") - F.col("m.at_block"))
    near = pairs.where(left >= F.col("m.need")).join(F.broadcast(templates), "template")
    held = F.size(F.array_intersect("ordered", "words"))
    return near.where(held >= F.col("need")).groupBy("key", "label").agg(F.max(held / F.size("ordered").cast("double")).alias("share"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """A row per document: base places and labels, all labels, score."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")).withColumn("words", words("text"))
    sets = [(label, words_of(t)) for label, t in templates]
    count = rarity(rows, sorted({w for _, s in sets for w in s}))
    ordered = [(label, sorted(s, key=lambda w: (count[w], w)), math.ceil(containment * len(s) - 1e-9)) for label, s in sets]
    prefixes = sorted({w for _, s, need in ordered for w in s[: len(s) - need + 1]})

    df = rows.withColumn("n_words", F.size("words").cast("bigint"))
    phrase = lambda p: " AND ".join(f"get(words, i + {k}) = '{w}'" for k, w in enumerate(p.split()))
    any_phrase = " OR ".join(f"({phrase(p)})" for p, _ in PHRASES)
    df = df.withColumn("places", F.expr(f"CASE WHEN lower(text) RLIKE 'license|cc' AND n_words > 0 THEN filter(sequence(0, cast(n_words AS int) - 1), i -> {any_phrase}) ELSE cast(array() AS array<int>) END"))
    df = df.withColumn("base", F.array_sort(F.array_compact(F.array(*(F.when(F.expr(f"exists(places, i -> {phrase(p)})"), F.lit(label)) for p, label in PHRASES)))))
    # Blocks of the few documents that hold any prefix word, as their template words.
    order = texts(sorted({w for _, s, _ in ordered for w in s}, key=lambda w: (count[w], w)))
    least = min((need for *_, need in ordered), default=0)
    df = df.withColumn("near", F.arrays_overlap("words", texts(prefixes)))
    df = df.withColumn("blocks", F.expr(r"CASE WHEN near THEN array_union(split(text, '\n'), split(text, '\n[ \t\r]*\n')) ELSE cast(array() AS array<string>) END"))
    df = df.withColumn("blocks", F.transform("blocks", lambda b: F.array_intersect(order, F.filter(F.split(F.lower(b), BREAK), lambda w: w != ""))))
    df = df.withColumn("blocks", F.array_distinct(F.filter("blocks", lambda s: (F.size(s) >= least) & F.arrays_overlap(s, texts(prefixes)))))
    df = df.select("doc_id", "n_words", "places", "base", "blocks", F.when(F.size("blocks") > 0, F.xxhash64("doc_id", "text", "blocks")).alias("key"))
    seen = cut(df)

    spark = docs.sparkSession
    table = spark.createDataFrame([(i, label, s, need) for i, (label, s, need) in enumerate(ordered)], "template int, label string, ordered array<string>, need int")
    blocks = seen.where("key IS NOT NULL").select("key", F.explode("blocks").alias("words")).distinct()
    found = matches(blocks, table).groupBy("key").agg(F.collect_set("label").alias("found"), F.max("share").alias("share"))  # a label each at most
    out = seen.join(found, "key", "left").withColumn("found", F.coalesce("found", F.array().cast("array<string>")))
    any_base = F.size("base") > 0
    return out.select(
        F.col("doc_id").alias(id_col),
        "n_words",
        F.size("places").cast("bigint").alias("n_base"),
        F.array_min("places").cast("bigint").alias("first_word"),
        F.array_max("places").cast("bigint").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", "found")), ",").alias("labels"),
        F.when(any_base, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )
