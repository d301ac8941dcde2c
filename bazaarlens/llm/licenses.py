"""License scan: diagonal voting of word k-grams against templates, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import row_key

__all__ = ["PHRASES", "TEMPLATES", "words_of", "template_grams", "diagonals", "merged_spans", "license_spans", "scan_licenses"]

# The base phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Public license notices that the method looks for, by its own labels.
TEMPLATES = {
    "notice-gpl": "This work is licensed under the GNU General Public License, version 3.",
    "notice-apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "notice-cc-by": "Licensed under CC BY-NC 4.0.",
    "notice-mit": "Released under the MIT License.",
    "notice-reserved": "All rights reserved",
    "text-mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
                "files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, "
                "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "text-apache-2.0": "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
                       "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software "
                       "distributed under the License is distributed on an AS IS BASIS",
    "text-gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
                "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "text-bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
                "conditions are met",
}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
K = 3           # words of a gram
NEAR = 2        # words put in or left out for each template word that need not align
SHARE = 0.8     # of the template's words that a verified span must align


def words_of(text: Column | str) -> Column:
    """Words of the lower-cased (A-Z) text; none for null."""
    c = F.col(text) if isinstance(text, str) else text
    return F.array_remove(F.split(F.translate(F.coalesce(c, F.lit("")), UPPER, LOWER), GAPS), "")


def _grams(words: str, k: int) -> Column:
    """[{0: word, .., k-1: word}, ..] at every place; the last ones have nulls."""
    return F.arrays_zip(*[F.slice(words, j + 1, F.greatest(F.size(words), F.lit(1))) for j in range(k)])


def _exploded(df: DataFrame, words: str, k: int, *keep: str) -> DataFrame:
    at = df.select(*keep, F.posexplode(_grams(words, k)).alias("pos", "g"))
    return at.where(F.col("g")[str(k - 1)].isNotNull()).select(*keep, "pos", F.xxhash64(*[F.col("g")[str(j)] for j in range(k)]).alias("gram"))


def template_grams(spark: SparkSession, templates: dict[str, str] = TEMPLATES, k: int = K) -> DataFrame:
    """label, size (words), tpos, gram. As many rows as the templates have words, so it may be broadcast."""
    t = spark.createDataFrame(list(templates.items()), "label string, text string").withColumn("words", words_of("text"))
    return _exploded(t.withColumn("size", F.size("words")), "words", k, "label", "size").withColumnRenamed("pos", "tpos")


def diagonals(docs: DataFrame, templates: DataFrame, k: int = K) -> DataFrame:
    """Votes by (row, label, diagonal = place in the text - place in the template). docs: key, words."""
    hits = _exploded(docs, "words", k, "key").join(F.broadcast(templates), "gram")
    return hits.groupBy("key", "label", "size", (F.col("pos") - F.col("tpos")).alias("diag")).agg(
        F.count(F.lit(1)).alias("votes"), F.min("pos").alias("first"), F.max("pos").alias("last"),
        F.collect_set("tpos").alias("tpos"))


def merged_spans(votes: DataFrame, near: int = NEAR, share: float = SHARE) -> DataFrame:
    """A span from each diagonal on: with all diagonals up to the allowed gaps further, ``near`` words for each template word
    that may be missing. A diagonal's places lie within the template's size, so only near places meet, and no span is longer
    than the template and its gaps."""
    gaps = near * F.ceil((1 - share) * F.col("size"))
    # in units of the label's gaps, which differ; half a word more lets equal distances in whatever the rounding
    scaled = votes.withColumn("at", F.col("diag") / (gaps + 0.5))
    ahead = Window.partitionBy("key", "label").orderBy("at").rangeBetween(0, 1)
    return scaled.select(
        "key", "label", "size", F.min("first").over(ahead).alias("first"), F.max("last").over(ahead).alias("last"), F.sum("votes").over(ahead).alias("votes"),
        F.array_distinct(F.flatten(F.collect_list("tpos").over(ahead))).alias("tpos"))


def license_spans(docs: DataFrame, templates: DataFrame, k: int = K, near: int = NEAR, share: float = SHARE) -> DataFrame:
    """Verified spans: key, label, first and last word, cover (share of the template's words aligned). Spans of one notice overlap.

    A span counts when the template words under its matched grams reach ``share`` of the template and it is no longer
    than the template allows for (near words more for each template word that need not align).
    """
    reach = F.size(F.array_distinct(F.flatten(F.transform("tpos", lambda p: F.sequence(p, p + k - 1)))))
    spans = merged_spans(diagonals(docs, templates, k), near, share)
    longest = F.col("size") + near * F.ceil((1 - share) * F.col("size"))
    return spans.withColumn("cover", reach / F.col("size")).where((F.col("cover") >= share) & (F.col("last") + k - F.col("first") <= longest)).select(
        "key", "label", "first", (F.col("last") + k - 1).alias("last"), "cover")


def _phrase_places(words: str) -> Column:
    """[{at, label}] of every place where a base phrase starts; only texts that hold its first two words are walked."""
    none = F.array().cast("array<struct<at:int,label:string>>")
    return F.concat(*[F.when((F.size(words) >= len(p.split())) & F.array_contains(words, p.split()[0]) & F.array_contains(words, p.split()[1]),
                             _starts(words, p.split(), label)).otherwise(none) for p, label in PHRASES.items()])


def _starts(words: str, phrase: list[str], label: str) -> Column:
    def here(i: Column) -> Column:
        same = F.get(F.col(words), i) == phrase[0]
        for j, w in enumerate(phrase[1:], 1):
            same = same & (F.get(F.col(words), i + j) == w)
        return same

    places = F.filter(F.sequence(F.lit(0), F.size(words) - len(phrase)), here)
    return F.transform(places, lambda i: F.struct(i.alias("at"), F.lit(label).alias("label")))


def scan_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row.

    Base places are exact phrase matches. The method's labels come from spans verified by diagonal voting; the score is
    1 with a base place, else the largest template share aligned, else 0.

    Null and empty texts have no words. Words are counted from 0. Rows that agree in id and text share one scan and each
    come out. Other columns are not carried, so their names cannot clash. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), row_key(id_col, text_col).alias("key"), words_of(text_col).alias("words"))
    base = rows.withColumn("places", _phrase_places("words")).select(
        "doc_id", "key", F.size("words").cast("long").alias("n_words"), F.size("places").cast("long").alias("n_base"),
        F.array_min(F.transform("places", lambda p: p["at"])).cast("long").alias("first_word"),
        F.array_max(F.transform("places", lambda p: p["at"])).cast("long").alias("last_word"),
        F.array_sort(F.array_distinct(F.transform("places", lambda p: p["label"]))).alias("base_list"))
    # repeated rows vote once: the votes of rows with one key are the same
    spans = license_spans(rows.select("key", "words"), template_grams(docs.sparkSession, templates))
    own = spans.groupBy("key").agg(F.collect_set("label").alias("own"), F.max("cover").alias("cover"))
    none = F.array().cast("array<string>")
    return base.join(own, base["key"].eqNullSafe(own["key"]), "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_list", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base_list", F.coalesce("own", none))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("cover", F.lit(0.0))).alias("score"))
