"""Operator 2: licence scans by MinHash bands over overlapping windows, all in DataFrame functions.

Texts are lower-cased and everything but letters and digits separates words. Each template
has a window width a little above its own length (longer ones are cut into windows of the
largest width at every offset). A document's windows of a width start at every fourth word,
so a copy of a template lies whole in some window and shares at least ``n / (W - 2)`` of the
union's shingles with it; ``HASHES`` bands of one row make a miss less likely than 3e-4 for
the shortest template and far less for others. The bands are looked up from their own side:
a window can meet a template in band ``j`` only by holding the shingle whose ``j``-th hash is
the template's least, so signatures are taken of the windows around those keys, and of no
others. Retrieved templates are verified by the share of their shingles that the text around
the window holds.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.plans.lineage import cut

SHINGLE = 3
WIDTHS = (8, 16, 32)
STEP = 4
HASHES = 12
#: Share of a template's shingles in hundredths that makes a match.
PERCENT = 80
#: Band keys up to this many are literals in the plan; more are a table that is broadcast up to ``BROADCAST_KEYS`` rows and shuffled beyond.
LITERALS, BROADCAST_KEYS = 20_000, 2_000_000

#: Licence names and the notices by which texts declare them.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MIT", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("BSD", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v. 2.0"),
    ("OFL-1.1", "This Font Software is licensed under the SIL Open Font License, Version 1.1."),
    ("EUPL-1.2", "Licensed under the EUPL, Version 1.2 or later"),
)


def template_words(text: str) -> list[str]:
    return re.sub(r"[\W_]+", " ", text.lower()).split()


def template_table(templates) -> list[tuple[int, str, list[str]]]:
    """``(number, licence, words)`` of each template of three words or more."""
    rows = [(k, name, template_words(text)) for k, (name, text) in enumerate(templates)]
    return [r for r in rows if len(r[2]) >= SHINGLE]


def width_of(n: int) -> int:
    """The narrowest width in which a span of ``n`` words always lies whole, else the largest."""
    return next((w for w in WIDTHS if n + STEP - 1 <= w), WIDTHS[-1])


def _shingles(words) -> F.Column:
    """Hashes of runs of three words; shorter texts have none."""
    zipped = F.slice(F.arrays_zip(words.alias("a"), F.slice(words, 2, 1 << 30).alias("b"), F.slice(words, 3, 1 << 30).alias("c")), 1, F.greatest(F.size(words) - 2, F.lit(0)))
    return F.transform(zipped, lambda x: F.xxhash64(x["a"], x["b"], x["c"]))


def _words(text) -> F.Column:
    spaced = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.array_remove(F.split(spaced, " "), "")


def _signature(window) -> F.Column:
    def least(j: int) -> F.Column:
        return F.array_min(F.transform(window, lambda h: F.xxhash64(h, F.lit(j))))

    return F.array(*map(least, range(HASHES)))


def _bands(frame: DataFrame, window: str) -> DataFrame:
    return frame.select("*", F.posexplode(_signature(F.col(window))).alias("band", "least"))


def _templates(spark: SparkSession, templates) -> tuple[DataFrame, DataFrame]:
    """Each template window's bands with the template's shingles, and the bands' keys: the shingles that have the least hashes."""
    rows, windows = template_table(templates), []
    for number, name, words in rows:
        width = width_of(len(words))
        for at in range(max(1, len(words) - width + 1)):
            windows.append((number, name, width, len(words), words, words[at : at + width]))
    frame = spark.createDataFrame(windows, "template int, license string, width int, n_words int, words array<string>, part array<string>")
    frame = frame.select("template", "license", "width", "n_words", F.array_distinct(_shingles(F.col("words"))).alias("wanted"), _shingles(F.col("part")).alias("part"))
    known = cut(_bands(frame, "part").dropDuplicates(["template", "width", "band", "least"]))
    keys = known.select(F.explode("part").alias("h"), "band", "least").where(F.xxhash64("h", "band") == F.col("least")).select("h").distinct()
    return known.drop("part"), cut(keys)


def _marked(own: DataFrame, keys: DataFrame) -> DataFrame:
    """``doc_id, hashes, hits, row`` of the texts that hold band keys; ``hits`` are the keys' places."""
    n = keys.count()
    if n <= LITERALS:
        every = [r.h for r in keys.orderBy("h").collect()]
        places = F.filter(F.transform("hashes", lambda h, i: F.struct(i.alias("i"), h.alias("h"))), lambda x: x["h"].isin(every))["i"]
        return cut(own.select("doc_id", "hashes", places.alias("hits")).where(F.size("hits") > 0).withColumn("row", F.monotonically_increasing_id()))
    numbered = cut(own.withColumn("row", F.monotonically_increasing_id()))
    found = numbered.select("row", F.posexplode("hashes").alias("i", "h")).join(F.broadcast(keys) if n <= BROADCAST_KEYS else keys, "h")
    return cut(numbered.join(found.groupBy("row").agg(F.array_sort(F.collect_list("i")).alias("hits")), "row").select("doc_id", "hashes", "hits", "row"))


def scan_licenses(documents: DataFrame, templates=TEMPLATES, percent: int = PERCENT) -> DataFrame:
    """``doc_id, license, template, n_shingles, n_found`` for each template that a document holds.

    ``n_found`` of the template's ``n_shingles`` distinct shingles lie around one window, at
    least ``percent`` in a hundred. Texts of under three words and null texts match nothing;
    rows that repeat a doc_id count as one; a null doc_id matches like any other. No
    templates or an empty table give no rows.
    """
    spark = documents.sparkSession
    if not template_table(templates):
        return spark.createDataFrame([], "doc_id long, license string, template int, n_shingles long, n_found long")
    known, keys = _templates(spark, templates)
    own = documents.select(F.col("doc_id").cast("long"), _shingles(_words(F.col("text"))).alias("hashes"))
    holders = _marked(own, keys)
    longest = max(len(words) for _, _, words in template_table(templates))
    found = None
    for width in sorted({width_of(len(words)) for _, _, words in template_table(templates)}):
        first = lambda p, w=width: F.greatest(F.ceil((p - (w - SHINGLE)) / STEP), F.lit(0)).cast("int")
        places = F.array_distinct(F.flatten(F.transform("hits", lambda p: F.sequence(first(p), F.floor(p / STEP).cast("int")))))  # noqa: B023
        windows = holders.select("row", "doc_id", "hashes", F.explode(places).alias("k"))
        begin = F.greatest(F.col("k") * STEP - longest, F.lit(0))
        windows = windows.select(
            "row", "doc_id", "k", F.slice("hashes", F.col("k") * STEP + 1, width - SHINGLE + 1).alias("window"), F.slice("hashes", begin + 1, F.col("k") * STEP + width + longest - begin).alias("around"), (F.col("k") * STEP - begin).alias("lead")
        )
        met = _bands(windows, "window").join(F.broadcast(known.where(F.col("width") == width)), ["band", "least"])
        met = met.dropDuplicates(["row", "k", "template"])
        lead = F.greatest(F.col("lead") - F.col("n_words"), F.lit(0))
        near = F.slice("around", lead + 1, F.col("lead") - lead + width + F.col("n_words") - SHINGLE + 1)
        met = met.select("doc_id", "license", "template", F.size("wanted").cast("long").alias("n_shingles"), F.size(F.array_intersect("wanted", near)).cast("long").alias("n_found"))
        met = met.where(F.col("n_found") * 100 >= F.col("n_shingles") * percent)
        found = met if found is None else found.union(met)
    return found.groupBy("doc_id", "license", "template", "n_shingles").agg(F.max("n_found").alias("n_found"))


def op2_sql(templates=TEMPLATES, percent: int = PERCENT) -> str:
    """DuckDB SQL of the same matches over all windows, without MinHash."""
    rows = ", ".join(f"({number}, '{name}', {width_of(len(words))}, {len(words)}, {words!r})" for number, name, words in template_table(templates))
    return rf"""
WITH templates(template, license, width, n_words, words) AS (VALUES {rows}),
wanted AS (
  SELECT DISTINCT template, license, width, n_words, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS shingle
  FROM templates, unnest(range(1, n_words - 1)) AS r(i)
), totals AS (SELECT template, count(*) AS n_shingles FROM wanted GROUP BY template),
texts AS (
  SELECT doc_id, row_number() OVER () AS row, list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' '), lambda x: x <> '') AS words FROM documents
), shingles AS (
  SELECT doc_id, row, i - 1 AS p, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS shingle FROM texts, unnest(range(1, len(words) - 1)) AS r(i)
), hits AS (SELECT s.*, w.template, w.license, w.width, w.n_words FROM shingles s JOIN wanted w USING (shingle)
), places AS (
  SELECT DISTINCT h.row, h.template, k FROM hits h, unnest(range(CAST(greatest(ceil((p - (width - 3)) / 4), 0) AS BIGINT), p // 4 + 1)) AS r(k)
), counted AS (
  SELECT h.doc_id, h.license, h.template, t.n_shingles, count(DISTINCT h.shingle) AS n_found
  FROM places q JOIN hits h ON h.row = q.row AND h.template = q.template AND h.p >= k * 4 - n_words AND h.p <= k * 4 + width + n_words - 3 JOIN totals t ON t.template = h.template
  GROUP BY h.doc_id, h.row, q.k, h.license, h.template, t.n_shingles
)
SELECT doc_id, license, template, n_shingles, max(n_found) AS n_found FROM counted
WHERE n_found * 100 >= n_shingles * {percent} GROUP BY ALL
"""
