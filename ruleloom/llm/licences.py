"""Licence scan: passages compared with templates by Dice over word bigrams.

A text's passages are its lines, its paragraphs (between blank lines) and itself
as a whole.  A passage is normalised (lower case, runs of anything but a-z and
0-9 become one space) and compared with a template by the Dice coefficient of the
two sets of word bigrams, ``2 * common / (a + b)``.  Dice can only reach ``t`` if
the smaller set has at least ``t / (2 - t)`` of the larger one's bigrams, so
templates outside those bounds are never compared.

Built-in expressions only, in one projection without a shuffle.

Defined cases: null and empty texts and texts with fewer than two words have no
match (``licence`` null, ``dice`` 0, ``licences`` empty); equal best scores go to the
first identifier in alphabetical order; repeated rows stay repeated; other
columns of the input are never read.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Short public licence notices and characteristic paragraphs, by SPDX identifier.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)


#: For the scan of windows: what tells BSD-3 from BSD-2, beside the clause that their texts share.
ENDORSEMENT = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
WINDOW_TEMPLATES = (*TEMPLATES, ("BSD-2-Clause", "Released under the BSD 2-Clause License."), ("BSD-3-Clause", ENDORSEMENT))


def normalised_bigrams(text: str) -> list[str]:
    """The distinct word bigrams of a text, in order."""
    words = re.sub(r"[^a-z0-9]+", " ", text.lower()).split()
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)))


def scan_licences(docs: DataFrame, *, key: str = "doc_id", text: str = "text", templates=TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """``key, licence, dice, licences, n_passages`` for every row.

    ``licences``: every identifier with a passage at or above the threshold, sorted
    and joined by commas; ``n_passages``: how many passages lie within some template's bounds.
    """
    sets = [(name, normalised_bigrams(body)) for name, body in templates]
    table = F.array(*[F.struct(F.lit(name).alias("id"), F.array(*map(F.lit, grams)).alias("b"), F.lit(len(grams)).alias("n")) for name, grams in sets])
    ratio = threshold / (2 - threshold)
    low, high = min(len(g) for _, g in sets) * ratio, max(len(g) for _, g in sets) / ratio
    base = docs.select(docs[key].alias("key"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("t"))
    passages = base.select("key", F.expr(r"array_distinct(concat(split(t, '\n'), split(t, '\n[ \t\r]*\n'), array(t)))").alias("u"))
    # A passage of w characters has at most w / 2 words: long and short ones go before they are split.
    words = passages.select("key", F.expr(rf"filter(transform(filter(u, x -> length(x) >= {2 * low}), x -> split(trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ')), ' ')), w -> size(w) > {low})").alias("w"))
    grams = words.select("key", F.expr("transform(w, x -> array_distinct(transform(sequence(1, size(x) - 1), i -> concat(get(x, i - 1), ' ', get(x, i)))))").alias("g"))
    near = grams.select("key", F.expr(f"filter(g, x -> size(x) >= {low} and size(x) <= {high})").alias("g"))
    scored = near.select("key", F.size("g").alias("n"), F.flatten(F.transform("g", lambda x: F.filter(F.transform(F.filter(table, lambda y: (F.size(x) >= y["n"] * ratio) & (F.size(x) * ratio <= y["n"])), lambda y: F.struct((2.0 * F.size(F.array_intersect(x, y["b"])) / (F.size(x) + y["n"])).alias("d"), y["id"].alias("id"))), lambda z: z["d"] >= threshold))).alias("m"))
    best = scored.select("key", "n", "m", F.expr("get(array_sort(transform(m, x -> struct(-x.d as d, x.id as id))), 0)").alias("top"))
    return best.select(F.col("key").alias(key), F.col("top.id").alias("licence"), F.coalesce(F.round(-F.col("top.d"), 9), F.lit(0.0)).alias("dice"), F.expr("array_join(array_sort(array_distinct(m.id)), ',')").alias("licences"), F.col("n").cast("long").alias("n_passages"))


def scan_windows(docs: DataFrame, *, key: str = "doc_id", text: str = "text", templates=WINDOW_TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """``key, licence, dice, licences`` for every row: what ``scan_licences`` finds and what windows of the text hold.

    Every window of a template's number of words over the text's word sequence is compared, so a notice
    inside a line, over comment marks or in a text of one line is found.  A window that reaches the threshold holds at least
    ``threshold / (2 - threshold)`` of the template's bigrams, so other templates are left out by the whole text's bigrams first.
    Where a text has BSD-3's own clause, the redistribution clause that it shares with BSD-2 is not told as BSD-2.
    """
    ratio = threshold / (2 - threshold)
    rows = [(name, normalised_bigrams(body), len(re.sub(r"[^a-z0-9]+", " ", body.lower()).split()) - 1) for name, body in templates]
    shared = next((i for i, (_, body) in enumerate(templates) if body.startswith("Redistribution and use in source")), -1)
    own = next((i for i, (_, body) in enumerate(templates) if body == ENDORSEMENT), -1)
    array = lambda xs: F.array(*map(F.lit, xs))
    table = F.array(*[F.struct(F.lit(i).alias("at"), F.lit(name).alias("id"), array(grams).alias("b"), F.lit(len(grams)).alias("n"), F.lit(size).alias("size")) for i, (name, grams, size) in enumerate(rows)])
    known = array(sorted({g for _, grams, _ in rows for g in grams}))
    base = docs.select(docs[key].alias("key"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("t"))
    # Passages as in scan_licences: they may be longer or shorter than a template.
    cut = base.select("key", "t", F.expr(r"array_distinct(concat(split(t, '\n'), split(t, '\n[ \t\r]*\n'), array(t)))").alias("u"))
    words = cut.select("key", F.expr("transform(u, x -> filter(split(regexp_replace(lower(x), '[^a-z0-9]+', ' '), ' '), y -> y <> ''))").alias("w"), F.expr("filter(split(regexp_replace(lower(t), '[^a-z0-9]+', ' '), ' '), y -> y <> '')").alias("all"))
    pairs = "CASE WHEN size({0}) > 1 THEN transform(sequence(1, size({0}) - 1), i -> concat(get({0}, i - 1), ' ', get({0}, i))) ELSE array() END"
    grams = words.select("key", F.expr(f"transform(w, x -> array_distinct({pairs.format('x')}))").alias("g"), F.expr(pairs.format("all")).alias("all"))
    met = grams.withColumn("hit", F.array_intersect("all", known))
    near = met.select("key", "g", "all", F.when(F.size("hit") > 0, F.filter(table, lambda y: F.size(F.array_intersect("hit", y["b"])) >= y["n"] * ratio - 1e-9)).otherwise(F.array().cast(met.select(table).schema.fields[0].dataType)).alias("near"))

    def dice(x, y):
        return 2.0 * F.size(F.array_intersect(x, y["b"])) / (F.size(x) + y["n"])

    def best(y):
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("all") - y["size"] + 1))
        windows = F.transform(starts, lambda i: dice(F.array_distinct(F.slice("all", i, y["size"])), y))
        passages = F.transform(F.filter("g", lambda x: (F.size(x) >= y["n"] * ratio) & (F.size(x) * ratio <= y["n"])), lambda x: dice(x, y))
        return F.struct(F.array_max(F.concat(windows, passages)).alias("d"), y["id"].alias("id"), y["at"].alias("at"))

    scored = near.select("key", F.filter(F.transform("near", best), lambda z: z["d"] >= threshold).alias("m"))
    told = scored.select("key", F.filter("m", lambda z: (z["at"] != shared) | ~F.exists("m", lambda o: o["at"] == own)).alias("m"))
    top = told.select("key", "m", F.expr("get(array_sort(transform(m, x -> struct(-x.d as d, x.id as id))), 0)").alias("top"))
    return top.select(F.col("key").alias(key), F.col("top.id").alias("licence"), F.coalesce(F.round(-F.col("top.d"), 9), F.lit(0.0)).alias("dice"), F.expr("array_join(array_sort(array_distinct(m.id)), ',')").alias("licences"))


def oracle(table: str = "documents", templates=TEMPLATES, threshold: float = 0.8) -> str:
    """DuckDB SQL for the rows of ``scan_licences``."""
    sets = [(name, normalised_bigrams(body)) for name, body in templates]
    values = ", ".join(f"('{name}', [{', '.join(repr(g) for g in grams)}], {len(grams)})" for name, grams in sets)
    ratio = threshold / (2 - threshold)
    low, high = min(len(g) for _, g in sets) * ratio, max(len(g) for _, g in sets) / ratio
    return rf"""
WITH l(id, b, n) AS (VALUES {values}),
d AS (SELECT doc_id, coalesce(text, '') AS t FROM {table}),
u AS (SELECT doc_id, unnest(list_distinct(list_concat(string_split(t, chr(10)), regexp_split_to_array(t, '\n[ \t\r]*\n'), [t]))) AS x FROM d),
w AS (SELECT doc_id, list_filter(string_split(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g'), ' '), lambda y: y <> '') AS w FROM u),
g AS (SELECT doc_id, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM w WHERE len(w) >= 2),
s AS (SELECT doc_id, g FROM g WHERE len(g) >= {low} AND len(g) <= {high}),
m AS (SELECT doc_id, id, 2.0 * len(list_intersect(g, b)) / (len(g) + n) AS d FROM s JOIN l ON len(g) >= n * {ratio} AND len(g) * {ratio} <= n),
k AS (SELECT doc_id, arg_min(id, (-CAST(d AS DOUBLE), id)) AS licence, round(max(CAST(d AS DOUBLE)), 9) AS dice, string_agg(DISTINCT id, ',' ORDER BY id) AS licences FROM m WHERE d >= {threshold} GROUP BY doc_id),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id)
SELECT d.doc_id, licence, coalesce(dice, 0.0) AS dice, coalesce(licences, '') AS licences, CAST(coalesce(c.n, 0) AS BIGINT) AS n_passages
FROM d LEFT JOIN k ON d.doc_id = k.doc_id LEFT JOIN c ON d.doc_id = c.doc_id"""
