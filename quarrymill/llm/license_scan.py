"""License scans: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies.

Texts and templates are cut into windows of ``WINDOW`` words that overlap by half. A window's 3-word shingles are
hashed once, and again with each band's own hash, whose minimum is the band's key. One row a band gives recall by the
number of bands alone: windows with similarity s share a band with probability 1 - (1 - s)^BANDS. A five-word notice
fills 3 of the 10 shingles of its window, s = 0.3 and 0.9998; a text window meets the nearest window of a longer
template at s = 0.5 or more, and 1 - 6e-8.

Windows can only share a band if they share a shingle, so texts without any shingle of a template are left out first.

Native: DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.llm.cluster import BROADCAST_ROWS, cut, written
from quarrymill.llm.exact_dedup import fold_ascii

WINDOW, STRIDE, SHINGLE, BANDS = 12, 6, 3, 24
#: Shingles of templates that a plan carries to sort out texts that hold none; with more, all texts are banded.
CARRIED = 20_000
MIN_CONTAINMENT = 0.8

#: Wording of public licenses and of the notices that name them.
TEMPLATES = [
    ("apache-2.0-line", "Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0-header", "Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("mit-line", "MIT", "Released under the MIT License."),
    ("mit-grant", "MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("bsd-conditions", "BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("gpl-3-line", "GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-grant", "GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("lgpl-grant", "LGPL", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("mpl-2-notice", "MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("cc-by-nc-line", "CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-notice", "CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa-notice", "CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("isc-grant", "ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("unlicense-grant", "Unlicense", "This is free and unencumbered software released into the public domain."),
    ("reserved", "proprietary", "All rights reserved. No part of this publication may be reproduced without the prior written permission of the publisher."),
]


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits (dots and hyphens inside them kept)."""
    bare = F.regexp_replace(fold_ascii(text), r"[^\p{L}\p{N}\s.-]+|[.-]+(?![\p{L}\p{N}])|(?<![\p{L}\p{N}])[.-]+", " ")
    for c in "\t\n\x0b\f\r":
        bare = F.replace(bare, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(bare, " "), "")  # a split at one literal sign is the fast one


def shingles(toks: Column) -> Column:
    """A hash for each run of three words; of shorter texts, one of all words."""
    n = F.size(toks) - SHINGLE + 1
    places = F.sequence(F.lit(1), n)
    return F.when(n >= 1, F.transform(places, lambda i: F.xxhash64(F.get(toks, i - 1), F.get(toks, i), F.get(toks, i + 1)))).when(F.size(toks) > 0, F.array(F.xxhash64(toks))).otherwise(F.array().cast("array<bigint>"))


def banded(df: DataFrame, sh: str) -> DataFrame:
    """A row for each window and band: the other columns of ``df``, window, key (the shingle that is least by the band's own hash)."""
    per = WINDOW - SHINGLE + 1
    starts = F.when(F.size(sh) > 0, F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.size(sh) - per) / STRIDE).cast("int"))))
    parts = F.transform(starts, lambda j: F.struct(j.alias("window"), F.slice(sh, j * STRIDE + 1, per).alias("part")))
    rest = [c for c in df.columns if c != sh]

    def least(band: int) -> Column:
        return F.array_min(F.transform("part", lambda x: F.xxhash64(x, F.lit(band))))

    rows = df.select(*rest, F.explode(parts).alias("_w")).select(*rest, F.col("_w.window").alias("window"), F.col("_w.part").alias("part"))
    keys = [F.xxhash64(least(i), F.lit(i)) for i in range(BANDS)]  # with its number, so that bands do not meet each other
    return rows.select(*rest, "window", F.explode(F.array(*keys)).alias("key"))


def _with_shingles(df: DataFrame, text: str, out: str) -> DataFrame:
    """Words and shingles each as a column of its own, so that lambdas do not compute them again for each element."""
    return df.withColumn("_toks", words(F.col(text))).withColumn(out, shingles(F.col("_toks"))).drop("_toks", text)


def license_scan(docs: DataFrame, templates: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", min_containment: float = MIN_CONTAINMENT) -> DataFrame:
    """One row for each (document, template) found: doc_id, template, license, containment, first_word.

    ``templates`` has columns template, license, text (the built-in notices if None). ``containment`` is the share
    of the template's 3-word shingles in the best place of the document, a stretch of twice its length around a
    window that met it; ``first_word`` is where that stretch begins. A template of which all shingles are in a
    longer template found in the same document is still reported.

    Null and empty texts hold nothing; templates without words are left out. Rows that repeat an id are one
    document, which holds what any of them holds. Null ids are left out. An empty table gives an empty result. Only the named columns are read.
    """
    spark = docs.sparkSession
    if templates is None:
        templates = spark.createDataFrame(TEMPLATES, "template string, license string, text string")
    known = _with_shingles(templates.select("template", "license", "text"), "text", "tsh").where(F.size("tsh") > 0)
    known = cut(known.withColumn("tsh", F.array_distinct("tsh")).withColumn("size", F.size("tsh")))
    # of each template, the windows at every place, so that one lies within half a stride of a text's window
    per = WINDOW - SHINGLE + 1
    places = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("tsh") - per))
    cuts = known.select("template", F.explode(F.transform(places, lambda j: F.slice("tsh", j + 1, per))).alias("tpart"))
    keyed = cut(banded(cuts, "tpart").select("template", "key").distinct())
    n_keys = keyed.count()
    read = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    read = read.withColumn("row", F.xxhash64("doc_id", "text"))  # rows may repeat an id
    every = cut(known.select(F.explode(F.col("tsh")).alias("s")).distinct().agg(F.collect_list("s").alias("every"), F.count(F.lit(1)).alias("n")))
    sets = _with_shingles(read, "text", "sh")
    if every.first()["n"] <= CARRIED:
        # not a filter: Spark would apply it before the shingles are a column, and work them out anew for each word
        held = F.when(F.arrays_overlap("sh", every.select("every").scalar()), F.array(F.lit(True)))
        sets = sets.select("*", F.explode(held).alias("held")).drop("held")
    sets, drop = written(sets)
    met = banded(sets, "sh")
    met = cut(met.join(F.broadcast(keyed) if n_keys <= BROADCAST_ROWS else keyed, "key").select("doc_id", "row", "template", "window").distinct())
    at = met.join(F.broadcast(known) if known.count() <= BROADCAST_ROWS // 100 else known, "template").groupBy("doc_id", "row", "template", "license", "size", "tsh").agg(F.array_sort(F.collect_set("window")).alias("windows"))
    full = at.join(sets, ["doc_id", "row"])

    def place(j: Column) -> Column:
        first = F.greatest(F.lit(0), j * STRIDE - F.col("size"))
        stretch = F.slice("sh", first + 1, 2 * F.col("size") + per)
        return F.struct((F.size(F.array_intersect("tsh", stretch)) / F.col("size")).alias("containment"), (-first).alias("first"))

    best = full.select("doc_id", "template", "license", F.array_max(F.transform("windows", place)).alias("p"))
    best = cut(best.groupBy("doc_id", "template", "license").agg(F.max("p").alias("p")))
    drop()
    return best.select("doc_id", "template", "license", F.col("p.containment").alias("containment"), (-F.col("p.first")).cast("long").alias("first_word")).where(F.col("containment") >= min_containment)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
