"""Licence scans: MinHash bands over overlapping windows, then exact shingle containment; DataFrame functions only.

A template is a notice text with the id of its licence. Texts are read as lower-case words of ASCII letters
and digits, in 5-word shingles. Templates of m shingles belong to the window class w, the power of two from
2m up to under 4m; windows of w shingles start every w / 2, so each run of m shingles lies within one of them
whole. Such a window that holds 0.8 of a template has a Jaccard similarity of more than 0.19 with it, and one
of ``BANDS`` single-row MinHash bands agrees with probability above 0.9999. Windows that agree are verified:
the share of the template's shingles they hold must reach ``CONTAINED``. Templates that begin at the same word of a
text are ranked by their share, all of them are returned.

A band can agree only in a shingle of the template. So a window is hashed over those of its shingles that templates
of its class hold: bands that agree over all shingles agree over these, too. Texts are turned into shingles in
their place and joined with the templates' shingles; what is shuffled are the few that match, and windows of
bounded size. Templates may be a list or a table of any size; up to MOST_BROADCAST of their shingles are broadcast.

Null or empty text, and texts of under five words: no licence, no row. Repeated rows each give their rows; null
ids stay; extra columns are ignored; an empty table gives no rows. Templates that are null or of under five words
are an error.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lixora.llm.common import saved

WORDS, BANDS, CONTAINED = 5, 48, 0.8
#: Template shingles that are broadcast (about 30 bytes each); more are joined by a shuffle.
MOST_BROADCAST = 2_000_000

#: Notice texts as the licences' authors publish them, and common one-line forms.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "either version 3 of the License, or (at your option) any later version"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "either version 2 of the License, or (at your option) any later version"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("OFL-1.1", "This Font Software is licensed under the SIL Open Font License, Version 1.1."),
]


def words_of(text: Column) -> Column:
    """Lower-case ASCII words; an empty array for a text without any."""
    clean = F.trim(F.regexp_replace(F.lower(F.coalesce(text.cast("string"), F.lit(""))), "[^a-z0-9]+", " "))
    return F.when(clean == "", F.array().cast("array<string>")).otherwise(F.split(clean, " "))


def _shingle(words: Column, i: Column) -> Column:
    return F.xxhash64(*[F.get(words, i + k) for k in range(WORDS)])


def _places(words: Column) -> Column:
    """0 .. number of shingles - 1; empty when there is none."""
    n = F.size(words) - WORDS
    return F.when(n < 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), n))


def _bands(shingles: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.array_min(F.transform(shingles, lambda x: F.xxhash64(x, b))))


def template_table(spark: SparkSession, templates: list[tuple[str, str]] | DataFrame) -> DataFrame:
    """(template_id, license, shingles, width) of each template; templates: a list or a table of (license, text)."""
    if not isinstance(templates, DataFrame):
        if bad := [t for _, t in templates if len(re.findall("[a-z0-9]+", t.lower())) < WORDS]:
            raise ValueError(f"templates of under {WORDS} words: {bad}")
        rows = spark.createDataFrame([(i, a, t) for i, (a, t) in enumerate(templates)], "template_id long, license string, text string")
    else:
        rows = templates.select(F.xxhash64("license", "text").alias("template_id"), "license", "text").distinct()
    rows = rows.withColumn("words", words_of(F.col("text")))
    short = F.raise_error(F.concat(F.lit(f"a template of under {WORDS} words: "), F.coalesce("text", F.lit("null"))))
    shingles = F.array_distinct(F.transform(_places(F.col("words")), lambda i: _shingle(F.col("words"), i)))
    rows = rows.withColumn("shingles", F.when(F.size("words") < WORDS, short.cast("array<long>")).otherwise(shingles))
    width = F.pow(2, F.ceil(F.log2(F.size("words") - WORDS + 1)) + 1).cast("int")
    return rows.select("template_id", "license", "shingles", width.alias("width"))


def scan(docs: DataFrame, templates: list[tuple[str, str]] | DataFrame | None = None, most: int = MOST_BROADCAST) -> DataFrame:
    """One row per row of docs and template found in it: the best containment, the first word of the match, and the
    rank among the templates that begin there (1: the highest containment)."""
    known = saved(template_table(docs.sparkSession, templates or TEMPLATES), "templates")
    sought = saved(known.select(F.explode("shingles").alias("shingle"), "width").distinct().groupBy("shingle").agg(F.collect_set("width").alias("widths")), "shingles")
    small = sought.count() <= most
    few = (lambda df: F.broadcast(df)) if small else (lambda df: df)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), words_of(F.col("text")).alias("words"))
    hashes = F.transform(_places(F.col("words")), lambda i: _shingle(F.col("words"), i))
    hits = rows.select("doc_id", "row", F.posexplode(hashes).alias("at", "shingle")).join(few(sought), "shingle")
    hits = hits.select("doc_id", "row", "at", "shingle", F.explode("widths").alias("width"))
    own = F.floor(F.col("at") / (F.col("width") / 2)).cast("long")
    hits = hits.select("doc_id", "row", "width", F.explode(F.when(own > 0, F.array(own - 1, own)).otherwise(F.array(own))).alias("window"), F.struct("at", "shingle").alias("hit"))
    windows = hits.groupBy("doc_id", "row", "width", "window").agg(F.sort_array(F.collect_list("hit")).alias("held"))  # at most width hits
    banded = windows.select("*", F.posexplode(_bands(F.transform("held", lambda h: h["shingle"]))).alias("band", "least"))
    bands = known.select("template_id", "width", F.posexplode(_bands(F.col("shingles"))).alias("band", "least"))
    pairs = banded.join(few(bands), ["width", "band", "least"]).groupBy("doc_id", "row", "width", "window", "template_id").agg(F.first("held").alias("held"))
    pairs = pairs.join(few(known.select("template_id", "license", "shingles")), "template_id")
    matched = F.filter("held", lambda h: F.array_contains("shingles", h["shingle"]))
    share = F.size(F.array_distinct(F.transform("matched", lambda h: h["shingle"]))) / F.size("shingles")
    verified = pairs.withColumn("matched", matched).select("doc_id", "row", "license", "template_id", share.alias("containment"), F.element_at("matched", 1)["at"].alias("first_word")).where(F.col("containment") >= CONTAINED)
    found = verified.groupBy("row", "doc_id", "license", "template_id").agg(F.max("containment").alias("containment"), F.min("first_word").alias("first_word"))
    rank = F.rank().over(Window.partitionBy("row", "first_word").orderBy(F.desc("containment")))
    return found.select("doc_id", "license", "template_id", "containment", "first_word", rank.alias("rank"))
