"""Licence scan by diagonal voting.

The record is an entry of the dataset registry: a dataset's `name` and its `license` text, which may be a
short label, a notice, or a whole file that quotes several licences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import lower_ascii

#: Letters, digits and everything beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases whose places are counted one by one: (label, words).
PHRASES = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))
#: Notices, found as spans. The wording of the public licences.
NOTICES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)
#: Words per gram; the shortest phrase has two.
K = 2
#: Diagonals of one notice at most this far apart are one span: a word put in or left out moves the diagonal by one.
SLACK = 2
#: A template's votes are the bits of a long.
MOST_WORDS = 64
#: Share of a notice's grams that a span must hold.
COVERAGE = 0.8


def terms(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; null: none."""
    return F.regexp_extract_all(lower_ascii(F.coalesce(text.cast("string"), F.lit(""))), F.lit(TERM), F.lit(0))


def _templates(spark, phrases, notices) -> DataFrame:
    """One row per gram of a template: template, label, is_phrase, n_grams, t_pos, t_first, t_second, t_hash."""
    each = [F.struct(F.lit(i).alias("template"), F.lit(label).alias("label"), F.lit(i < len(phrases)).alias("is_phrase"), F.lit(text).alias("text")) for i, (label, text) in enumerate([*phrases, *notices])]
    rows = spark.range(1).select(F.inline(F.array(*each))).withColumn("t", terms(F.col("text")))
    rows = rows.select("template", "label", "is_phrase", (F.size("t") - 1).alias("n_grams"), "t", F.explode(F.sequence(F.lit(0), F.size("t") - K)).alias("t_pos"))
    first, second = F.get("t", F.col("t_pos")), F.get("t", F.col("t_pos") + 1)
    return rows.select("template", "label", "is_phrase", "n_grams", "t_pos", first.alias("t_first"), second.alias("t_second"), F.xxhash64(first, second).alias("t_hash"))


def scan_licenses(datasets: DataFrame, phrases=PHRASES, notices=NOTICES, coverage: float = COVERAGE) -> DataFrame:
    """Which licences a dataset's text names or quotes, and where.

    Input: name (any type), license (text; null is empty); other columns are ignored. Result, one row per input
    row: name, n_words, n_base (places where a phrase's words stand consecutively), first_word, last_word (their
    smallest and largest start, from 0; null without a place), base_labels, labels (with those of notices; both
    distinct, sorted, comma-joined; empty without one), score (best share of a template found, 1 for a phrase).

    Each two-word gram of every text, by hash, meets the template positions (a constant table, broadcast); the
    words themselves then confirm it. A gram at word p and template position t votes for diagonal p - t. A
    phrase's place is a diagonal with all of its votes. A notice's diagonals that lie next to each other are one
    span, kept if it covers enough distinct positions. Only votes and one row per text leave the scan, so very
    common passages cost no more than their places. Equal rows are counted once and repeated at the end.
    """
    if any(len(words.split()) > MOST_WORDS for _, words in [*phrases, *notices]):
        raise ValueError(f"a template has more than {MOST_WORDS} words")
    rows = datasets.select("name", F.col("license").cast("string").alias("license"))
    rows = rows.select("name", F.xxhash64("license").alias("text_key"), terms(F.col("license")).alias("words"))
    # Position -1 stands for the text itself, so that texts without a vote stay.
    rows = rows.select("name", "text_key", "words", F.explode_outer(F.sequence(F.lit(-1), F.size("words") - 1)).alias("pos"))
    first, second = F.get("words", F.col("pos")), F.get("words", F.col("pos") + 1)
    rows = rows.withColumn("hash", F.when((F.col("pos") >= 0) & (F.col("pos") < F.size("words") - 1), F.xxhash64(first, second)))
    templates = F.broadcast(_templates(datasets.sparkSession, phrases, notices))
    hits = rows.join(templates, (F.col("hash") == F.col("t_hash")) & (first == F.col("t_first")) & (second == F.col("t_second")), "left")
    hits = hits.filter((F.col("pos") == -1) | F.col("template").isNotNull())
    # From here on rows are narrow: votes as bits of a mask, and no words.
    hits = hits.select("name", "text_key", "template", "label", "is_phrase", "n_grams", (F.col("pos") - F.col("t_pos")).alias("diagonal"), F.expr("shiftleft(1L, t_pos)").alias("vote"), F.when(F.col("pos") == -1, F.size("words")).alias("n_words"))
    text = ["name", "text_key"]
    diagonals = hits.groupBy(*text, "template", "label", "is_phrase", "n_grams", "diagonal").agg(
        F.count(F.lit(1)).alias("rows"), F.max("n_words").alias("n_words"), F.bit_or("vote").alias("votes"))
    along = Window.partitionBy(*text, "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > SLACK, F.lit(True)) | F.coalesce(F.col("is_phrase"), F.lit(True))
    spans = diagonals.withColumn("apart", apart.cast("int")).withColumn("span", F.sum("apart").over(along))
    spans = spans.groupBy(*text, "template", "label", "is_phrase", "n_grams", "span").agg(
        F.max("rows").alias("rows"), F.max("n_words").alias("n_words"), F.min("diagonal").alias("start"), F.bit_count(F.bit_or("votes")).alias("found"))
    share = F.col("found") / F.col("n_grams")
    place = F.col("is_phrase") & (F.col("found") == F.col("n_grams"))
    named = F.when(place | (~F.col("is_phrase") & (share >= F.lit(coverage))), F.col("label"))
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    found = spans.groupBy(*text).agg(
        F.max(F.when(F.col("template").isNull(), F.col("rows"))).alias("copies"), F.max("n_words").cast("long").alias("n_words"), F.count(F.when(place, 1)).alias("n_base"),
        F.min(F.when(place, F.col("start"))).cast("long").alias("first_word"), F.max(F.when(place, F.col("start"))).cast("long").alias("last_word"),
        joined(F.when(place, F.col("label"))).alias("base_labels"), joined(named).alias("labels"), F.coalesce(F.max(F.when(F.col("template").isNotNull(), share)), F.lit(0.0)).alias("score"))
    again = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    return found.select("name", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", again.alias("_copy")).drop("_copy")
