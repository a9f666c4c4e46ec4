"""License texts in documents: MinHash bands over overlapping windows, then exact containment.

A template is found where a document's window holds at least 0.8 of its five-word shingles.
For a template of n shingles the windows hold 2n shingles and begin every n, so each
stretch of n shingles lies whole in some window, whose similarity to the template is then at
least 0.8n / (2n + 0.2n) = 0.36. With `BANDS` bands of one minimum each, such a window shares
a band with a probability over 1 - (1 - 0.36) ** 32, about 0.9999995.

A shared band means that the window holds the template's smallest shingle under that
hash. So windows are built only around such shingles, of which there are at most `BANDS` per
template; all others cannot share a band, and most documents end at that test.

Templates of different licenses may share most of their words (the notices of the GNU
licenses differ in a name or a number). Where found stretches of two licenses overlap, only
the one with the larger containment is reported, or of equal ones the longer template.

Everything is DataFrame functions. What is broadcast is made from the templates alone.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recurring_metrics.llm.common import column

WIDTH, BANDS, CONTAINED = 5, 32, 0.8
MOST_TEMPLATES = 2_000
# Usual notices and opening passages of public licenses.
TEMPLATES = {
    "Apache-2.0 line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "AGPL-3.0 notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "AGPL-3.0 preamble": "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software.",
    "BSD-2-Clause terms": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS",
    "BSD-3-Clause terms": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSL-1.0 opening": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software",
    "CC-BY-SA-4.0 line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0 deed": "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law, including all related and neighboring rights, to the extent allowed by law.",
    "EPL-2.0 notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "GPL-2.0 notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0 preamble": "The GNU General Public License is a free, copyleft license for software and other kinds of works. The licenses for most software and other practical works are designed to take away your freedom to share and change the works.",
    "ISC terms": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "LGPL-2.1 notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "LGPL-3.0 notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "Unlicense opening": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Zlib terms": "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely",
    "CC-BY-4.0 line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0 line": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0 line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MIT line": "Released under the MIT License.",
    "MIT opening": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.",
    "MPL-2.0 notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
}


def words(text: Column) -> Column:
    """Runs of ASCII letters and digits, lower-cased."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def shingles(hashes: Column) -> Column:
    """Hashes of the five-word shingles of an array of word hashes, in order.

    The array is bound to a name of the outer `transform`, so that it is computed
    once and not for every shingle, wherever Spark moves the expression.
    """

    def of(h: Column) -> Column:
        count = F.size(h) - (WIDTH - 1)
        made = F.transform(
            F.sequence(F.lit(0), count - 1), lambda i: F.xxhash64(*[h[i + k] for k in range(WIDTH)])
        )
        return F.when(count > 0, made).otherwise(F.array().cast("array<bigint>"))

    return F.transform(F.array(hashes), of)[0]


def minima(of: str) -> Column:
    """The smallest hash of a set of shingles under each of the band hashes."""
    return F.array(*[F.expr(f"array_min(transform({of}, x -> xxhash64(x, {b})))") for b in range(BANDS)])


def template_table(docs: DataFrame, templates: Mapping[str, str]) -> list:
    """(license, shingles, smallest shingle per band) of every template, as rows."""
    rows = docs.sparkSession.createDataFrame(sorted(templates.items()), "license string, text string")
    hashed = rows.select("license", F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("h"))
    sets = hashed.select("license", F.array_distinct(shingles(F.col("h"))).alias("s"))
    lowest = F.array(
        *[F.expr(f"array_min(transform(s, x -> struct(xxhash64(x, {b}), x)))").getField("x") for b in range(BANDS)]
    )
    return sets.select("license", "s", lowest.alias("lowest"), minima("s").alias("bands")).collect()


def _windows(n: int) -> Column:
    """(size, at) of the windows for templates of n shingles that hold one of the places."""
    begins = F.transform("places", lambda p: F.array(p - p % n, F.greatest(p - p % n - n, F.lit(0))))
    return F.transform(
        F.array_distinct(F.flatten(begins)), lambda at: F.struct(F.lit(n).alias("size"), at.alias("at"))
    )


def scan(
    docs: DataFrame,
    templates: Mapping[str, str] = TEMPLATES,
    id_col: str = "doc_id",
    text_col: str = "text",
    contained: float = CONTAINED,
) -> DataFrame:
    """The id, license, containment and first_word of every template found in every row.

    Of templates of different licenses (the name up to its first space) whose
    stretches overlap, the best one stands. containment is the largest share of the template's shingles in one window,
    first_word the position of the first such window (among the words of
    `words`). Templates need five words at least. Null, empty and blank texts
    have none. Repeated ids are taken together; other columns are not read.
    """
    known = template_table(docs, templates)
    if not known or len(known) > MOST_TEMPLATES or any(not r["s"] for r in known):
        raise ValueError(f"1 to {MOST_TEMPLATES} templates of at least {WIDTH} words are needed")
    spark = docs.sparkSession
    lowest = sorted({x for r in known for x in r["lowest"]})
    sizes = sorted({len(r["s"]) for r in known})
    bands = F.broadcast(
        spark.createDataFrame(
            [(len(r["s"]), b, v, r["license"]) for r in known for b, v in enumerate(r["bands"])],
            "size int, band int, value long, license string",
        )
    )
    sets = F.broadcast(
        spark.createDataFrame([(r["license"], list(r["s"])) for r in known], "license string, template array<long>")
    )
    hashed = docs.select(
        column(id_col).alias("id"), F.transform(words(column(text_col)), lambda w: F.xxhash64(w)).alias("h")
    )
    held = hashed.select("id", shingles(F.col("h")).alias("s")).where(F.exists("s", lambda x: x.isin(lowest)))
    places = F.filter(
        F.transform("s", lambda x, i: F.when(x.isin(lowest), i)), lambda i: i.isNotNull()
    )
    around = held.select("id", "s", places.alias("places"))
    windows = F.flatten(F.array(*[_windows(n) for n in sizes]))
    cut = around.select("id", "s", F.explode(windows).alias("w")).select(
        "id", "w.size", "w.at", F.array_distinct(F.slice("s", F.col("w.at") + 1, 2 * F.col("w.size"))).alias("window")
    )
    banded = cut.select("id", "size", "at", "window", F.posexplode(minima("window")).alias("band", "value"))
    pairs = (
        banded.join(bands, ["size", "band", "value"])
        .groupBy("id", "license", "at", "size")
        .agg(F.first("window").alias("window"))
    )
    share = F.size(F.array_intersect("window", "template")) / F.size("template")
    verified = pairs.join(sets, "license").select(
        "id", "license", "at", share.alias("share"), F.size("template").alias("n"), "window", "template"
    )
    best = (
        verified.where(F.col("share") >= contained)
        .groupBy("id", "license")
        .agg(
            F.max(F.struct("share", (-F.col("at")).alias("neg"))).alias("best"),
            F.max_by(F.struct("n", "window", "template"), F.struct("share", (-F.col("at")).alias("neg"))).alias("of"),
        )
    )
    # Where the stretch begins and ends in its window; the window holds each shingle once, in order.
    inside = F.transform("of.window", lambda x, i: F.when(F.array_contains("of.template", x), i))
    start = -F.col("best.neg")
    placed = best.select(
        "id", "license", F.col("best.share").alias("share"), F.col("of.n").alias("n"), start.alias("at"),
        (start + F.array_min(inside)).alias("first"), (start + F.array_max(inside)).alias("last"),
        F.substring_index("license", " ", 1).alias("family"),
    )
    # One row per template and text at most, so the list is as long as the templates are many.
    listed = placed.groupBy("id").agg(
        F.collect_list(F.struct("license", "family", "share", "n", "at", "first", "last")).alias("found")
    )

    def beaten(x: Column) -> Column:
        return F.exists(
            "found",
            lambda y: (y["family"] != x["family"]) & (y["first"] <= x["last"]) & (x["first"] <= y["last"])
            & (F.struct(y["share"], y["n"], y["family"]) > F.struct(x["share"], x["n"], x["family"])),
        )

    kept = listed.select("id", F.explode(F.filter("found", lambda x: ~beaten(x))).alias("x"))
    return kept.select(
        F.col("id").alias(id_col), "x.license", F.col("x.share").alias("containment"),
        F.col("x.at").cast("long").alias("first_word"),
    )
