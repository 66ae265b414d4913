"""License scans in DataFrame functions only.

Texts are read in overlapping windows of words. MinHash bands of one row each bring a
window to the templates it may hold part of: a shared shingle is the smallest under
one hash function in a window and a template's window with probability 1 / union, so
the number of bands fixes the chance of missing it. Retrieved templates are verified
by exact containment of their shingles in the stretch of text.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placemill.llm.common import ROW, once

SHINGLE = 5
WINDOW = 9
STRIDE = 3

# Notices by which common licenses are granted.
TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
    ),
    "mit-line": "Released under the MIT License.",
    "mit-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
    ),
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "bsd-3-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
    ),
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "isc-grant": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies."
    ),
}


def bands_for(miss: float, shared: int = 1, window: int = WINDOW) -> int:
    """Bands of one row that miss a window with ``shared`` of the template's shingles with probability ``miss`` at most.

    With windows of w shingles each, s shared ones make a similarity of s / (2w - s).
    """
    w = window - SHINGLE + 1
    return math.ceil(math.log(miss) / math.log1p(-shared / (2 * w - shared))) if shared < w else 1


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(hashed: Column) -> Column:
    """Hash of each run of SHINGLE words, in order; of all words if they are fewer; none for no words."""
    last = F.size(hashed) - SHINGLE
    of = lambda i: F.xxhash64(*[F.get(hashed, i + k) for k in range(SHINGLE)])
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), of)).when(F.size(hashed) > 0, F.array(F.xxhash64(hashed))).otherwise(F.array().cast("array<bigint>"))


def shingled(docs: DataFrame) -> DataFrame:
    hashed = once(docs, "_words", F.transform(words(F.coalesce("text", F.lit(""))), lambda w: F.xxhash64(w))).drop("text")
    return once(hashed, "shingles", shingles(F.col("_words"))).drop("_words")


def windows(rows: DataFrame, stride: int) -> DataFrame:
    """(..., first, window): the shingles of each window of WINDOW words, begun every ``stride`` words."""
    per = WINDOW - SHINGLE + 1
    start = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("shingles") - 1), F.lit(stride))).alias("first")
    return rows.where(F.size("shingles") > 0).select("*", start).withColumn("window", F.slice("shingles", F.col("first") + 1, F.lit(per)))


def band_keys(window: Column, bands: int) -> Column:
    """(band, smallest hash) of a window under each of ``bands`` hash functions."""
    return F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.struct(b.alias("band"), F.array_min(F.transform(window, lambda s: F.xxhash64(s, b))).alias("least")))


def template_table(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    rows = spark.createDataFrame(sorted(templates.items()), "license string, text string")
    return shingled(rows).where(F.size("shingles") > 0).withColumnRenamed("shingles", "template")


def scan(docs: DataFrame, templates: dict[str, str] | None = None, containment: float = 0.8, miss: float = 1e-4) -> DataFrame:
    """(row, doc_id, license, containment, first_word, last_word): the templates that texts hold.

    ``containment`` of a template's shingles must stand in the text, counted exactly,
    in the stretch of the retrieved windows and a template's length around them;
    first_word and last_word bound the shingles that do. ``miss`` is the greatest
    chance that a window with one shared shingle retrieves nothing; it fixes the
    number of bands. Texts go on only if they hold any shingle of a template at
    all, and so do windows: others can share no band. Templates are given with the
    call, so their table is small by its nature and is broadcast. Null and empty
    texts hold nothing; rows with one id are separate; other columns are dropped.
    """
    spark = docs.sparkSession
    templates = TEMPLATES if templates is None else templates
    bands = bands_for(miss)
    known = template_table(spark, templates)
    every = [F.lit(r["s"]) for r in known.select(F.explode("template").alias("s")).distinct().orderBy("s").collect()]
    some = F.array(*every) if every else F.array().cast("array<bigint>")
    texts = shingled(docs.select(ROW, "doc_id", "text")).where(F.arrays_overlap("shingles", some))
    near = windows(texts, STRIDE).where(F.arrays_overlap("window", some))
    keys = windows(known.withColumnRenamed("template", "shingles"), 1).select("license", F.explode(band_keys(F.col("window"), bands)).alias("key")).distinct()
    looked = near.select(ROW, "doc_id", "shingles", "first", F.explode(band_keys(F.col("window"), bands)).alias("key"))
    met = looked.join(F.broadcast(keys), "key").join(F.broadcast(known), "license")
    # The template may begin as far before the window, or end as far behind it, as it is long.
    low = F.greatest(F.lit(0), F.col("first") - F.size("template"))
    part = F.slice("shingles", low + 1, F.size("template") * 2 + WINDOW)
    within = met.withColumn("share", F.size(F.array_intersect("template", part)) / F.size(F.array_distinct("template"))).where(F.col("share") >= containment)
    at = F.filter(F.transform(part, lambda s, i: F.when(F.array_contains("template", s), low + i)), lambda i: i.isNotNull())
    spans = within.withColumn("at", at)
    return spans.groupBy(ROW, "license").agg(
        F.max("doc_id").alias("doc_id"), F.max("share").alias("containment"), F.min(F.array_min("at")).cast("bigint").alias("first_word"),
        (F.max(F.array_max("at")) + SHINGLE - 1).cast("bigint").alias("last_word"),
    ).select(ROW, "doc_id", "license", "containment", "first_word", "last_word")


def license_scan(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, license, containment, first_word, last_word) for every text and template it holds; options as for ``scan``."""
    return scan(docs.withColumn(ROW, F.monotonically_increasing_id()), **options).drop(ROW)
