"""License scan: an exact set-similarity join of text blocks with licence templates.

Only DataFrame functions are used.  The blocks of a text for a template are all windows of
WIDTH times the template's words, one at every word (the whole text, if it is shorter), so
line breaks, long lines and what stands around a notice don't matter.  A block matches if it
holds at least THETA of the template's distinct words.

The words of the templates are put in one global order, rarest in the corpus first (counted
over all documents).  A block that matches holds at least `need` of the |T| distinct words,
so it holds one of the first |T| - need + 1 in that order (prefix filter): the places of
those words are joined with the templates that they begin.  All blocks that hold the place
lie in the words around it.  These must be `need` or more (length filter), and from the
rarest of the template's words among them on, enough of the template and of the words must
be left (positional filter).  What remains is verified by the intersection of each block.

Defined cases: a null or empty text has no words, counts 0, null places, empty labels
and score 0; rows that repeat are judged alone; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, texts

#: Phrases and labels of the base count.
PHRASES = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]

#: Notices as licences word them: label, text.
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("mit", "released under the mit license"),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("lgpl", "this library is free software under the gnu lesser general public license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    (
        "apache-2.0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license "
        "you may obtain a copy of the license at unless required by applicable law or agreed to in writing software distributed under "
        "the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    ),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
        "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute "
        "sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so",
    ),
    (
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as "
        "published by the free software foundation either version 3 of the license or at your option any later version",
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following "
        "conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the "
        "following disclaimer",
    ),
]
THETA, WIDTH = 0.8, 2
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def normal(text: Column) -> Column:
    """Words of a text, A-Z lower-cased, with single spaces between them."""
    return F.trim(F.regexp_replace(F.translate(text, _UPPER, _UPPER.lower()), _SEPARATORS, " "))


def _array(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def _places(words: Column, phrase: str) -> Column:
    """Starts of a phrase among words, from 0."""
    parts = phrase.split()
    starts = F.when(F.size(words) >= len(parts), F.sequence(F.lit(0), F.size(words) - len(parts))).otherwise(F.array().cast("array<int>"))
    return F.filter(starts, lambda i: reduce(lambda a, b: a & b, [F.get(words, i + k) == p for k, p in enumerate(parts)]))


def _needed(n: int, theta: float) -> int:
    return max(1, math.ceil(theta * n - 1e-9))


class Ordered:
    """The templates with their words in the global order, and the prefix of each."""

    def __init__(self, frequency: dict[str, int], theta: float):
        rank = lambda w: (frequency.get(w, 0), w)
        self.rows, self.index = [], []
        for i, (label, text) in enumerate(TEMPLATES):
            words = sorted(set(text.split()), key=rank)
            need = _needed(len(words), theta)
            self.rows.append((i, label, words, need, WIDTH * len(text.split())))
            self.index += [(w, i) for w in words[: len(words) - need + 1]]
        self.prefix = sorted({w for w, _ in self.index})


def token_frequency(docs: DataFrame) -> dict[str, int]:
    """How many documents hold each template word; at most one row for each such word."""
    vocabulary = _array(sorted({w for _, t in TEMPLATES for w in t.split()}))
    held = F.array_intersect(F.split(normal(F.col("text")), " "), vocabulary)
    return {r["word"]: r["n"] for r in docs.select(F.explode(held).alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()}


def scan_licenses(docs: DataFrame, theta: float = THETA) -> DataFrame:
    spark = docs.sparkSession
    docs = texts(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ordered = Ordered(token_frequency(docs), theta)
    prefix = _array(ordered.prefix)

    # Pass over the texts: base counts, and the words of documents that hold a prefix word.
    table = docs.select("doc_id", normal(F.col("text")).alias("norm"))
    padded = F.concat(F.lit(" "), F.col("norm"), F.lit(" "))
    some = reduce(lambda a, b: a | b, [F.contains(padded, F.lit(f" {p} ")) for p, _ in PHRASES])
    marked = F.arrays_overlap(F.split("norm", " "), prefix)
    table = table.select(
        "doc_id",
        F.when(F.col("norm") == "", F.lit(0)).otherwise(F.length("norm") - F.length(F.replace("norm", F.lit(" "), F.lit(""))) + 1).cast("long").alias("n_words"),
        some.alias("some"),
        marked.alias("marked"),
        F.when(some | marked, F.filter(F.split("norm", " ", -1), lambda w: w != "")).alias("words"),
    )
    none = F.array().cast("array<int>")
    table = table.select("*", *[F.when(F.col("some"), _places(F.col("words"), p)).otherwise(none).alias(f"at{i}") for i, (p, _) in enumerate(PHRASES)])
    places = [F.col(f"at{i}") for i in range(len(PHRASES))]
    table = table.select(
        "doc_id",
        "n_words",
        reduce(lambda a, b: a + b, [F.size(p) for p in places]).cast("long").alias("n_base"),
        F.array_min(F.concat(*places)).cast("long").alias("first_word"),
        F.array_max(F.concat(*places)).cast("long").alias("last_word"),
        F.filter(F.array(*[F.when(F.size(p) > 0, F.lit(label)) for p, (_, label) in zip(places, PHRASES)]), lambda x: x.isNotNull()).alias("base"),
        F.when(F.col("marked"), F.col("words")).alias("words"),
    )
    table = cut(table.withColumn("row", F.monotonically_increasing_id()))

    # The join proper, on prefix words; both template tables have a row for each template word at most.
    index = F.broadcast(spark.createDataFrame(ordered.index, "word string, template int"))
    templates = F.broadcast(spark.createDataFrame(ordered.rows, "template int, label string, own array<string>, need int, width int"))
    widest = max(width for *_, width in ordered.rows)
    spots = F.filter(F.transform("words", lambda w, i: F.when(F.array_contains(prefix, w), i)), lambda i: i.isNotNull())
    # Of the words only those around each place go on.
    probes = table.filter("words is not null").select("row", "words", F.explode(spots).alias("at"))
    low = F.greatest(F.col("at") - (widest - 1), F.lit(0))
    probes = probes.select("row", F.get("words", F.col("at")).alias("word"), (F.col("at") - low).alias("at"), F.slice("words", low + 1, F.lit(2 * widest - 1)).alias("near"))
    pairs = probes.join(index, "word").join(templates, "template")
    first = F.greatest(F.col("at") - (F.col("width") - 1), F.lit(0))
    pairs = pairs.select("row", "label", "own", "need", "width", (F.col("at") - first).alias("at"), F.slice("near", first + 1, F.col("at") + F.col("width") - first).alias("near"))
    # Of the template's words, in the global order, those around the place; the rarest of them begins any match.
    pairs = pairs.withColumn("held", F.array_intersect("own", "near")).filter(F.size("held") >= F.col("need"))
    pairs = pairs.filter(F.least(F.size("own") - F.array_position("own", F.get("held", F.lit(0))) + 1, F.size("held")) >= F.col("need"))
    blocks = F.sequence(F.lit(0), F.least(F.col("at"), F.greatest(F.size("near") - F.col("width"), F.lit(0))))
    common = F.array_max(F.transform(blocks, lambda i: F.size(F.array_intersect(F.col("own"), F.slice(F.col("near"), i + 1, F.col("width"))))))
    pairs = pairs.select("row", "label", "need", F.size("own").alias("size"), common.alias("common")).filter(F.col("common") >= F.col("need"))
    found = pairs.groupBy("row").agg(F.collect_set("label").alias("added"), F.max(F.col("common") / F.col("size")).alias("score"))
    joined = table.drop("words").join(found, "row", "left")
    return joined.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join(F.array_sort(F.array_distinct("base")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("added", F.array().cast("array<string>")))), ",").alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
