"""License scans: MinHash bands over overlapping windows of a text retrieve license templates, exact shingle containment
verifies them. DataFrame functions only.

Text and templates are runs of five-word shingles. A template is looked up in windows of the largest power of two that it
fills, at most WINDOW shingles. Windows of templates start at every shingle, those of documents at every one or every
WINDOW / 8th (a shorter text counts as one window), so a passage taken over literally has a window that equals one of its template, and collides in every band.
For windows of Jaccard likeness LIKE, bands(LIKE, CERTAINTY) gives as many bands of ROWS hashes as make a collision
that certain. A band can only collide where a window and a template share a shingle, so windows without any are left out.
"""

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SHINGLE = 5
WINDOW = 16
ROWS = 2
LIKE, CERTAINTY = 0.6, 0.99
CONTAINED = 0.8
# Templates are literals of the plan, so their number is bounded.
MOST_TEMPLATES = 2000

# Public notices of widely used licenses.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with '
        "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    (
        "BSD",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met:",
    ),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    (
        "GPL-3.0",
        "This work is licensed under the GNU General Public License, version 3.",
    ),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
        "version.",
    ),
    ("MIT", "Released under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the '
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)


def bands(like=LIKE, certainty=CERTAINTY, rows=ROWS) -> int:
    """Bands of `rows` hashes so that windows of Jaccard likeness `like` collide in one with probability `certainty`."""
    return math.ceil(math.log(1 - certainty) / math.log(1 - like**rows))


def shingled(df: DataFrame, text="text") -> DataFrame:
    """`df` without the text and with `shingles`, hashes of five words each in order.

    Words are runs of letters, digits and non-ASCII characters, lower-cased; NULL texts and fewer words give none.
    """
    others = [c for c in df.columns if c != text]
    pieces = F.split(F.lower(F.col(text)), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    words = df.select(*others, F.transform(F.filter(pieces, lambda w: w != ""), lambda w: F.xxhash64(w)).alias("__w"))
    runs = F.when(F.size("__w") >= SHINGLE, F.arrays_zip(*[F.slice("__w", F.lit(k + 1), F.size("__w") - SHINGLE + 1).alias(f"w{k}") for k in range(SHINGLE)]))
    found = F.transform(F.coalesce(runs, F.array()), lambda r: F.xxhash64(r))
    return words.select(*others, found.alias("shingles"))


def size_class(n: Column) -> Column:
    return F.least(F.lit(WINDOW), F.pow(2, F.floor(F.log2(n))).cast("int"))


def band_keys(shingles: Column, starts: Column, size: Column) -> Column:
    """The bands of the windows of `size` shingles at `starts` (from 0), each a hash of size, band and minimal hashes."""
    count = bands()

    def keys(start):
        window = F.slice(shingles, start + 1, size)
        low = lambda seed: F.array_min(F.transform(window, lambda x: F.xxhash64(x, F.lit(seed))))
        return F.array(*[F.xxhash64(size, F.lit(b), *[low(b * ROWS + r) for r in range(ROWS)]) for b in range(count)])

    return F.flatten(F.transform(starts, keys))


def prepared(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    """(template, license_id, shingles, keys), one row for each template."""
    if len(templates) > MOST_TEMPLATES:
        raise ValueError(f"at most {MOST_TEMPLATES} templates")
    rows = [(k, name, text) for k, (name, text) in enumerate(templates)]
    made = shingled(spark.createDataFrame(rows, "template int, license_id string, text string")).where("size(shingles) > 0")
    made = made.withColumn("size", size_class(F.size("shingles")))
    starts = F.sequence(F.lit(0), F.size("shingles") - F.col("size"))
    return made.withColumn("keys", F.array_distinct(band_keys(F.col("shingles"), starts, F.col("size")))).drop("size")


def scan(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """(doc_id, license_id, template, n_shared, n_template): templates of which a text has at least CONTAINED of the shingles.

    One row for each doc_id and template, however often the row is repeated; NULL and empty texts have none, NULL ids are
    kept. Templates of fewer than five words are not found.
    """
    spark = docs.sparkSession
    known = prepared(spark, templates).collect()  # at most MOST_TEMPLATES rows
    shape = "doc_id long, license_id string, template int, n_shared int, n_template int"
    if not known:
        return spark.createDataFrame([], shape)
    literal = lambda values: F.array(*[F.lit(v) for v in sorted(values)])
    all_shingles = literal({s for r in known for s in r.shingles})
    sizes = sorted({min(WINDOW, 1 << (len(r.shingles).bit_length() - 1)) for r in known})

    texts = shingled(docs.select("doc_id", "text")).where(F.arrays_overlap("shingles", all_shingles))
    places = F.filter(F.sequence(F.lit(0), F.size("shingles") - 1), lambda i: F.array_contains(all_shingles, F.col("shingles")[i]))
    texts = texts.withColumn("places", places)

    def keys_of(size):
        step = max(1, size // 8)
        around = lambda p: F.sequence(F.greatest(F.lit(0), F.ceil((p - size + 1) / step)).cast("int"), F.floor(p / step).cast("int"))
        starts = F.array_distinct(F.flatten(F.transform("places", around)))
        starts = F.filter(F.transform(starts, lambda s: s * step), lambda s: s + size <= F.size("shingles"))
        # A text that is shorter than the window is one as a whole; it can still hold enough of a template.
        starts = F.when(F.size("shingles") < size, F.array(F.lit(0))).otherwise(starts)
        return band_keys(F.col("shingles"), starts, F.lit(size))

    met = texts.select("doc_id", "shingles", F.array_distinct(F.flatten(F.array(*[keys_of(s) for s in sizes]))).alias("keys"))
    entries = [(key, r.template, r.license_id, r.shingles) for r in known for key in r.keys]
    bank = spark.createDataFrame(entries, "key long, template int, license_id string, template_shingles array<long>")
    met = met.select("doc_id", "shingles", F.explode(F.array_intersect("keys", literal({k for k, *_ in entries}))).alias("key"))
    found = met.join(F.broadcast(bank), "key")  # bounded by MOST_TEMPLATES
    shared = F.size(F.array_intersect("template_shingles", "shingles"))
    whole = F.size(F.array_distinct("template_shingles"))
    found = found.select("doc_id", "license_id", "template", shared.alias("n_shared"), whole.alias("n_template"))
    return found.where(F.col("n_shared") >= CONTAINED * F.col("n_template")).distinct()
