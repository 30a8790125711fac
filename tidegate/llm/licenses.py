"""License scans: MinHash bands retrieve templates for overlapping text windows, shingle containment verifies them.

Texts and templates are words (lower-cased runs of letters, digits and inner
dots or hyphens) in shingles of five. Windows are as long as the template they
are compared with and half as long again, on a grid of a quarter of its length,
so each place of a template lies whole in some window. A window's signature is
the least permuted hash of its shingles for each of ``bands`` permutations, one
row to a band: windows that hold at least 0.8 of a template collide with it with
probability 1 - (1 - 0.8 / 1.7) ** bands or more, over 0.9999 with 16 bands and
nearly 1 for whole templates. A window collides only where it holds a shingle
that is a template's own minimum; the scan finds these shingles first and forms
just the windows around them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import written

MAX_KEYS = 20_000        # shingles of all templates' signatures that are constants of the scan; more are joined
WORD = "[\\p{L}\\p{N}]+(?:[.\\-][\\p{L}\\p{N}]+)*"

# Notices that public licenses ask for or that are in common use.
NOTICES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
                "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
                "option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to "
                "this work."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
                     "that the following conditions are met"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]


@dataclass(frozen=True)
class Scan:
    shingle: int = 5
    containment: float = 0.8
    bands: int = 16


def notices(spark: SparkSession) -> DataFrame:
    """template, license, text of the fixed notices."""
    rows = F.array(*(
        F.struct(F.lit(k).alias("template"), F.lit(name).alias("license"), F.lit(text).alias("text"))
        for k, (name, text) in enumerate(NOTICES)
    ))
    return spark.range(1).select(F.explode(rows).alias("n")).select("n.*")


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _shingles(words: Column, size: int) -> Column:
    """Hash of the ``size`` words from each place on; ``words`` is a stored column."""
    return F.when(F.size(words) >= size, F.transform(
        F.sequence(F.lit(0), F.size(words) - size),
        lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(size))),
    )).otherwise(F.array().cast("array<bigint>"))


def prepared(templates: DataFrame, scan: Scan = Scan()) -> DataFrame:
    """Stored templates with their distinct shingles, length in shingles, window length and stride.

    Templates with fewer words than a shingle and NULL ones cannot be found and are left out.
    """
    rows = templates.select("template", "license", words(F.col("text")).alias("words"))
    rows = rows.select("template", "license", _shingles(F.col("words"), scan.shingle).alias("all"))
    n = F.size("all")
    return written(rows.where(n > 0).select(
        "template", "license", F.array_distinct("all").alias("wanted"), n.alias("n"),
        F.ceil(n * 1.5).cast("int").alias("width"), F.ceil(n / 4).cast("int").alias("stride")))


def _least(shingles: Column, band: Column) -> Column:
    """A window's value in a band: the least permuted hash of its shingles."""
    return F.array_min(F.transform(shingles, lambda x: F.xxhash64(x, band)))


def scan(
    docs: DataFrame, templates: DataFrame, scan: Scan = Scan(), doc_id: str = "doc_id", text: str = "text",
    max_keys: int = MAX_KEYS,
) -> DataFrame:
    """doc_id, license, containment, first_word, windows: one row per document and license found in its whole text.

    ``containment`` is the best share of a template's shingles in one window,
    ``first_word`` the place of the first such window. Documents without a
    license, NULL and empty texts have no row; rows that repeat an id count as
    one document; NULL ids are one document.

    Up to ``max_keys`` shingles of signatures are looked for inside each row;
    more of them are a table that the shingles' places are joined with. Both
    ways find the same places.
    """
    wanted = prepared(templates, scan)
    minima = written(wanted.select("*", F.explode(F.sequence(F.lit(0), F.lit(scan.bands - 1))).alias("band")).select(
        "*", _least(F.col("wanted"), F.col("band")).alias("value")).select(
        "*", F.explode("wanted").alias("key")).where(F.xxhash64("key", "band") == F.col("value")))
    reach = minima.agg(F.max("width")).first()[0] or 1
    keys = minima.select("key").distinct()
    known = [r["key"] for r in keys.limit(max_keys + 1).collect()]
    rows = docs.select(F.col(doc_id).alias("doc_id"), words(F.col(text)).alias("words"))
    rows = rows.select("doc_id", _shingles(F.col("words"), scan.shingle).alias("shingles"))
    shingles = F.col("shingles")
    if len(known) <= max_keys:
        hits = F.filter(
            F.transform(shingles, lambda x, i: F.when(x.isin(*known), i)), lambda i: i.isNotNull())
        rows = rows.select("doc_id", "shingles", hits.alias("hits"))
    else:
        # stored, so that a row keeps its number; a row's places gather again, as its shingles did before
        rows = written(rows.where(F.size("shingles") > 0).withColumn("row", F.monotonically_increasing_id()))
        places = rows.select("row", F.posexplode("shingles").alias("at", "key")).join(keys, "key", "left_semi")
        rows = rows.join(places.groupBy("row").agg(F.sort_array(F.collect_list("at")).alias("hits")), "row").drop("row")
    around = F.transform("hits", lambda i: F.struct(
        F.get(shingles, i).alias("key"), i.alias("at"), F.greatest(i - reach, F.lit(0)).alias("base"),
        F.slice(shingles, F.greatest(i - reach, F.lit(0)) + 1, F.lit(2 * reach + 1)).alias("near")))
    found = rows.select("doc_id", F.explode(around).alias("h")).select("doc_id", "h.*")
    # the grid's windows of the template that hold the place
    place = F.col("at")
    first = F.greatest(F.lit(0), F.floor((place - F.col("width")) / F.col("stride")) + 1)
    last = F.floor(place / F.col("stride"))
    cells = found.join(minima.drop("license"), "key").select(
        "*", F.explode(F.sequence(first.cast("int"), last.cast("int"))).alias("cell"))
    start = F.col("cell") * F.col("stride")
    window = F.slice("near", (start - F.col("base") + 1).cast("int"), F.col("width"))
    cells = cells.select("doc_id", "template", "band", "value", "wanted", start.alias("start"), window.alias("window"))
    alike = cells.where(_least(F.col("window"), F.col("band")) == F.col("value"))
    share = F.size(F.array_intersect("window", "wanted")) / F.size("wanted")
    best = alike.groupBy("doc_id", "template", "start").agg(F.max(share).alias("containment")).where(
        F.col("containment") >= scan.containment)
    return best.join(wanted.select("template", "license"), "template").groupBy("doc_id", "license").agg(
        F.max("containment").alias("containment"), F.min("start").cast("bigint").alias("first_word"),
        F.countDistinct("template", "start").alias("windows"))
