"""Licence notices in texts: MinHash bands over overlapping windows, then exact containment.

Templates are notices of a few words to a few hundred.  For each template length
the words of a text are looked at in overlapping windows, wide enough that every
place where a template can stand lies wholly inside one.  Windows and templates
have MinHash signatures over their word shingles; a template is retrieved where a
band of ``ROWS`` values agrees with the window's.  The retrieved pairs are verified:
the share of the template's shingles that the window holds must be ``CONTAINED``
or more.

With a step of a quarter of the length, a window holding a template to 0.8 has a
Jaccard similarity of 0.55 or more with it, and ``BANDS`` bands of ``ROWS`` retrieve it
with a probability above 0.997; a window equal to the template always is.

Windows without any shingle of a template can't hold one; they get no signature.
Shingles have five words, or all of a shorter template.  Words are letters and
digits, lower-cased.  Nulls and texts without words hold nothing; rows with the
same id count as one document.  Templates without words are never found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved

SHINGLE = 5
CONTAINED = 0.8
BANDS = 20
ROWS = 2

#: Short notices of well-known licences.
NOTICES = {
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS '
        "OF ANY KIND, either express or implied."
    ),
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version."
    ),
    "MIT-line": "Released under the MIT License.",
    "MIT-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without '
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of "
        "the Software, and to permit persons to whom the Software is furnished to do so"
    ),
    "BSD-conditions": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met"
    ),
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "All-rights-reserved": "All rights reserved.",
}


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def shingles(tokens: str, size: int) -> Column:
    """Hashes of the runs of ``size`` words, in order."""
    last = F.size(tokens) - size
    at = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(F.slice(F.col(tokens), i + 1, size)))


def bands(hashes: str) -> Column:
    """The band hashes of a set of shingle hashes: ``ROWS`` MinHash values to a band."""
    values = ", ".join(f"array_min(transform({hashes}, x -> xxhash64(x, b, {r})))" for r in range(ROWS))
    return F.expr(f"transform(sequence(0, {BANDS - 1}), b -> struct(b AS band, xxhash64({values}) AS value))")


def step_of(length: int) -> int:
    return max(1, length // 4)


def _templates(spark: SparkSession, notices: dict[str, str]) -> list[tuple]:
    """(name, words, shingle hashes) of the templates: a configuration, so it is small."""
    rows = spark.createDataFrame(sorted(notices.items()), "name string, text string").withColumn(
        "tokens", words(F.col("text"))
    )
    size = F.least(F.size("tokens"), F.lit(SHINGLE))
    at = F.sequence(F.lit(0), F.size("tokens") - size)
    own = F.transform(at, lambda i: F.xxhash64(F.slice(F.col("tokens"), i + 1, size)))
    found = rows.where(F.size("tokens") > 0).select(
        "name", F.size("tokens").alias("length"), size.alias("size"), F.array_distinct(own).alias("set")
    )
    return sorted(found.collect())


def scan(
    docs: DataFrame, notices: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id_col, template, containment, place): where a text holds a template best, and at which word that window begins."""
    spark = docs.sparkSession
    templates = _templates(spark, NOTICES if notices is None else notices)
    kind = docs.schema[id_col].dataType.simpleString()
    if not templates:
        return spark.createDataFrame([], f"`{id_col}` {kind}, template string, containment double, place int")
    sizes = sorted({t.size for t in templates})
    # exploding one array keeps the filter below from being pushed past the words, into every shingle
    rows = docs.select(F.col(id_col).alias("id"), F.explode(F.array(words(F.col(text_col)))).alias("tokens")).select(
        "id", *(shingles("tokens", s).alias(f"s{s}") for s in sizes)
    )

    def own(size: int) -> Column:
        hashes = sorted({h for t in templates if t.size == size for h in t.set})
        return F.expr(f"array({', '.join(f'{h}L' for h in hashes)})")

    known_hashes = {s: own(s) for s in sizes}
    some = None
    for s in sizes:
        holds = F.arrays_overlap(F.col(f"s{s}"), known_hashes[s])
        some = holds if some is None else some | holds
    rows = rows.where(some)
    classes = sorted({(t.length, t.size) for t in templates})

    def windows_of(length: int, size: int) -> Column:
        """Windows of a template length: where they begin and their shingles, for those with a shingle of a template."""
        step, hashes = step_of(length), F.col(f"s{size}")
        width = length + step - 1 - size + 1
        begins = F.when(
            F.size(hashes) > 0, F.sequence(F.lit(0), F.size(hashes) - 1, F.lit(step))
        ).otherwise(F.array().cast("array<int>"))
        one = lambda i: F.struct(
            F.lit(length).alias("length"), i.alias("place"), F.array_distinct(F.slice(hashes, i + 1, width)).alias("set")
        )
        return F.filter(F.transform(begins, one), lambda w: F.arrays_overlap(w["set"], known_hashes[size]))

    # a few texts in a hundred have windows; written, so that the texts are read once
    windows = saved(
        rows.select("id", F.explode(F.flatten(F.array(*(windows_of(*c) for c in classes)))).alias("w")).select(
            "id", "w.length", "w.place", "w.set"
        ),
        "windows",
    )
    signed = windows.select("id", "length", "place", "set", F.explode(bands("set")).alias("b"))
    known = (
        spark.createDataFrame(
            [(t.name, t.length, t.set) for t in templates], "template string, length int, wanted array<long>"
        )
        .withColumn("b", F.explode(bands("wanted")))
        .select("template", "length", "wanted", "b.band", "b.value")
    )
    # the templates are a configuration of this module or of the caller: broadcasting them is bounded
    found = (
        signed.select("id", "length", "place", "set", "b.band", "b.value")
        .join(F.broadcast(known), ["length", "band", "value"])
        .withColumn("containment", F.size(F.array_intersect("set", "wanted")) / F.size("wanted"))
        .where(F.col("containment") >= CONTAINED)
    )
    return (
        found.groupBy("id", "template")
        .agg(F.max(F.struct("containment", -F.col("place"))).alias("best"))
        .select(
            F.col("id").alias(id_col),
            "template",
            F.col("best.containment").alias("containment"),
            (-F.col("best")["col2"]).alias("place"),
        )
    )
