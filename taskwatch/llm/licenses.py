"""License scans by Dice coefficient over word bigrams (operator 2, native).

Texts are normalised (lower case, every run of characters that are neither
letters nor digits is one space) and cut into units: every line, and every
text as a whole. A unit's set of word bigrams is compared with the templates';
Dice = 2 |A & B| / (|A| + |B|). A template of b bigrams can reach the
threshold only for units of between b t / (2 - t) and b (2 - t) / t bigrams,
so each template is listed once per size it can match and units meet their
candidates in an equi-join on the size: all others are pruned unseen.

Before that, most text is set aside without being normalised. A match shares at
least a bound of a template's bigrams (``_least``), so if all but fewer of them
hold one of some words, every match holds one of these words. Such words are
chosen for all templates, long ones first, and only texts, then units, that
contain one are looked at. No match is lost, whatever words are chosen; the
number of spaces or repeated words in a unit does not matter.

Templates are a parameter (a table of id and text). The list of sizes and the
bigrams, each template's once, are broadcast if their measured bytes allow and
joined by shuffle otherwise; of more than ``FILTER_BIGRAMS`` template bigrams no
words are chosen. Bigrams are compared as 64-bit hashes. Each unit counts for its
best template only, ties going to the smallest id.

Defined results: null or empty texts, units and templates with fewer than two
words match nothing; a one-line text is one unit, not two; rows that repeat
key and text count once, other rows of one key together; a null key is a key; templates that repeat an id
are alternatives for it; extra columns do not matter. Only DataFrame functions
are used.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from taskwatch.llm.common import let
from taskwatch.operators.joins import attach
from taskwatch.session import pin

THRESHOLD = 0.8
#: bigrams of all templates from which the words of the filter are chosen on the driver
FILTER_BIGRAMS = 100_000

#: license notices as they are commonly written (fixed values)
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
            "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
            "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted "
                     "provided that the following conditions are met:"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
                "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
                "option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
                "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your "
                "option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("proprietary", "All rights reserved."),
]


def templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TEMPLATES, "license string, text string")


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def bigrams(clean: Column) -> Column:
    """Distinct hashes of the word bigrams of a normalised text."""
    w = F.split(clean, " ")
    pairs = F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.xxhash64(a, b))
    return F.array_distinct(F.when(F.size(w) > 1, pairs).otherwise(F.array().cast("array<bigint>")))


def _bounds(b: Column, t: float) -> tuple[Column, Column]:
    """Smallest and largest size that can reach the threshold with size b."""
    return F.ceil(b * t / (2 - t) - 1e-9), F.floor(b * (2 - t) / t + 1e-9)


def _least(b: int, t: float) -> int:
    """Bigrams of a template with ``b`` that any unit reaching the threshold shares."""
    return max(1, math.ceil(b * t / (2 - t) - 1e-9))


def filter_words(templates: list[tuple[list[str], int]], threshold: float) -> list[str]:
    """Words of which every match of a template holds one, from the templates'
    (words in order, number of distinct bigrams)."""
    chosen: set[str] = set()
    for words, b in sorted(templates, key=lambda x: x[1]):
        pairs = set(zip(words, words[1:]))
        bare = {p for p in pairs if not chosen.intersection(p)}
        for w in sorted({w for p in pairs for w in p}, key=lambda w: (-len(w), w)):
            if len(bare) < _least(b, threshold):
                break
            if any(w in p for p in bare):
                chosen.add(w)
                bare = {p for p in bare if w not in p}
    # a word that holds another chosen one is found with it
    return sorted(w for w in chosen if not any(o != w and o in w for o in chosen))


def _filter(theirs: DataFrame, threshold: float) -> Callable[[Column], Column]:
    """A test that every matching unit, and every text with one, passes."""
    if (theirs.agg(F.sum("b")).first()[0] or 0) > FILTER_BIGRAMS:
        return lambda raw: raw.isNotNull()
    words = filter_words([(r["clean"].split(" "), r["b"]) for r in theirs.select("clean", "b").collect()], threshold)
    return lambda raw: let(F.lower(raw), lambda low: reduce(
        or_, (F.contains(low, F.lit(w)) for w in words), F.lit(False)))


def scan(docs: DataFrame, known: DataFrame, key: str = "doc_id", text: str = "text",
         threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, license, n_hits, shared, total)``: units per document whose
    best template is of that license, and the best unit's shared bigrams and
    sum of sizes, so that its Dice coefficient is 2 shared / total."""
    low, high = _bounds(F.col("b"), threshold)
    known = known.select("license", normalised(F.col("text")).alias("clean")).where("license IS NOT NULL AND clean IS NOT NULL")
    theirs = pin(known.select("license", "clean", bigrams(F.col("clean")).alias("theirs"))
                 .withColumn("b", F.size("theirs")).where("b > 0").dropDuplicates(["license", "theirs"])
                 .withColumn("tid", F.xxhash64("license", "theirs")), "license-templates")
    bodies = theirs.select("tid", "license", "theirs", "b")
    sizes = theirs.select("tid", F.explode(F.sequence(F.greatest(low, F.lit(1)), high)).alias("size"))
    span = sizes.agg(F.max("size")).first()[0] or 0
    held = _filter(theirs, threshold)
    t = F.col(text)
    lines = F.split(t, "\n")
    units = F.concat(lines, F.when(F.size(lines) > 1, F.array(t)).otherwise(F.array().cast("array<string>")))
    rows = (docs.where(held(t)).select(F.col(key).alias("doc_id"), F.xxhash64(t).alias("row"), F.posexplode(units).alias("pos", "raw"))
            .where(held(F.col("raw"))).withColumn("ours", bigrams(normalised(F.col("raw")))).drop("raw")
            .withColumn("size", F.size("ours").cast("long")).where(F.col("size").between(1, span)))
    met = attach(attach(rows, sizes, ["size"], how="inner"), bodies, ["tid"], how="inner")
    met = (met.withColumn("shared", F.size(F.array_intersect("ours", "theirs")))
           .withColumn("total", F.col("size") + F.col("b"))
           .where(2 * F.col("shared") >= threshold * F.col("total")))
    # the best template of each unit: highest ratio first, then the smallest id
    dice = F.col("shared") / F.col("total")
    one = met.groupBy("doc_id", "row", "pos").agg(F.min_by(
        F.struct("license", "shared", "total"), F.struct(-dice, F.col("license"), F.col("total"))).alias("x"))
    return one.groupBy("doc_id", "x.license").agg(
        F.count(F.lit(1)).alias("n_hits"),
        F.max_by(F.struct("x.shared", "x.total"), F.struct(F.col("x.shared") / F.col("x.total"), F.col("x.total"))).alias("y")).select(
        "doc_id", "license", "n_hits", F.col("y.shared").cast("long").alias("shared"), F.col("y.total").cast("long").alias("total"))


def query(spark, sf_dir: str) -> DataFrame:
    from taskwatch.llm.common import read
    return scan(read(spark, sf_dir, "documents"), templates(spark))
