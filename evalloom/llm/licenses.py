"""Operator 5: license scan, in DataFrame functions only.

Texts and templates become lower-cased words of letters and digits and shingles of five words (a template of fewer
words: one shingle of all of them). Templates are put in classes by their number of shingles: ``c`` for more than c/2
and up to c. For each class, overlapping windows of 2c shingles, c apart, run over a text, so that some window holds
the whole of any occurrence (windows without any shingle of a template are left out: they are similar to none). A window that holds 0.8 of a template's shingles then has a Jaccard similarity of 0.19 or
more with it, and one of ``BANDS`` MinHash values agrees with a chance of 1 - 0.81 ** BANDS (0.999 for 32) or more.
Such windows retrieve their templates, and the exact share of the template's shingles that the window holds decides.

Only texts that hold one of a few words of the templates are windowed: of each template the longest words are taken
until more than a fifth of its shingles have one of them, so a text without any can't reach 0.8 of any template.
"""

from __future__ import annotations

import re
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import cut, texts

SIZE, SHARE, BANDS = 5, 0.8, 32

#: Notices of well-known licenses.
TEMPLATES = {
    "agpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
    "bsd-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mit": "Released under the MIT License.",
    "mit-permission": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}


def words_of(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def words_column(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda x: x != "")


def telling_words(templates: dict[str, str]) -> list[str]:
    """Words of which any text has one that holds ``SHARE`` of any template's shingles."""
    out = set()
    for text in templates.values():
        w = words_of(text)
        k = min(SIZE, len(w))
        shingles = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
        chosen: set[str] = set()
        for word in sorted(set(w), key=lambda x: (-len(x), x)):
            if sum(not chosen.isdisjoint(s) for s in shingles) > (1 - SHARE) * len(shingles):
                break
            chosen.add(word)
        out |= chosen
    # a word that holds another needs no test of its own
    return sorted(x for x in out if not any(y != x and y in x for y in out))


def shingled(words: Column, size: int) -> Column:
    """Hashes of the runs of ``size`` words, in order; none if there are fewer words."""
    starts = F.when(F.size(words) >= size, F.sequence(F.lit(1), F.size(words) - (size - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, size)))


def band_keys(shingles: Column) -> Column:
    """For each band: a hash of the band and the least of the shingles' hashes in it."""
    bands = F.sequence(F.lit(1), F.lit(BANDS))
    return F.transform(bands, lambda b: F.xxhash64(b, F.array_min(F.transform(shingles, lambda x: F.xxhash64(x, b)))))


def classes(templates: dict[str, str]) -> dict[tuple[int, int], list[str]]:
    """Templates by (words in a shingle, class)."""
    out = defaultdict(list)
    for name, text in sorted(templates.items()):
        n = len(words_of(text))
        if n:
            size = min(SIZE, n)
            out[size, 1 << (n - size).bit_length()].append(name)
    return dict(out)


def license_matches(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """``doc_id, license_id, containment`` of each template that 0.8 of a window's shingles or more match, by document.

    Null and empty texts match nothing, nor do templates without words. Rows that repeat a doc_id count as one document;
    other columns are ignored; an empty table gives an empty one. Templates are given in code, so their tables are
    bounded; documents are never broadcast.
    """
    spark = docs.sparkSession
    lower = F.lower("text")
    some = None
    for word in telling_words(templates):
        some = lower.contains(word) if some is None else some | lower.contains(word)
    schema = "doc_id long, license_id string, containment double"
    if some is None:
        return spark.createDataFrame([], schema)
    sizes = sorted({size for size, _ in classes(templates)})
    words = cut(texts(docs).where(some).select("doc_id", words_column(F.col("text")).alias("words")))
    # written, so that the classes' plans read shingles and don't each compute them several times
    candidates = cut(words.select("doc_id", *(shingled(F.col("words"), k).alias(f"shingles{k}") for k in sizes)))
    found = None
    for (size, width), names in classes(templates).items():
        one = _class_matches(spark, candidates, {k: templates[k] for k in names}, size, width)
        found = one if found is None else found.unionByName(one)
    return found.groupBy("doc_id", "license_id").agg(F.max("containment").alias("containment"))


def _class_matches(spark: SparkSession, candidates: DataFrame, templates: dict[str, str], size: int, width: int) -> DataFrame:
    rows = spark.createDataFrame([(k, words_of(t)) for k, t in templates.items()], "license_id string, words array<string>")
    rows = rows.select("license_id", F.array_distinct(shingled(F.col("words"), size)).alias("template"))
    keys = rows.select("license_id", "template", F.explode(band_keys(F.col("template"))).alias("key"))
    values = sorted({r["key"] for r in keys.select("key").collect()})
    every = candidates.select("doc_id", F.col(f"shingles{size}").alias("shingles")).where(F.size("shingles") > 0)
    # A window without any shingle of the templates has similarity 0 with all of them: only others are formed.
    own = sorted({r["x"] for r in rows.select(F.explode("template").alias("x")).collect()})
    places = F.array_compact(F.transform("shingles", lambda x, i: F.when(x.isin(own), i)))
    every = every.withColumn("places", places).where(F.size("places") > 0)
    numbers = F.array_distinct(F.flatten(F.transform("places", lambda i: F.array(F.floor(i / width), F.floor(i / width) - 1))))
    windows = every.select("doc_id", "shingles", F.explode(F.filter(numbers, lambda k: k >= 0)).alias("k"))
    windows = windows.select("doc_id", F.array_distinct(F.slice("shingles", (F.col("k") * width + 1).cast("int"), 2 * width)).alias("window"))
    hits = windows.withColumn("keys", band_keys(F.col("window"))).where(F.exists("keys", lambda k: k.isin(values)))
    retrieved = hits.select("doc_id", "window", F.explode("keys").alias("key")).join(F.broadcast(keys), "key").select("doc_id", "window", "license_id", "template")
    share = F.size(F.array_intersect("window", "template")) / F.size("template")
    return retrieved.select("doc_id", "license_id", share.alias("containment")).where(F.col("containment") >= SHARE)
