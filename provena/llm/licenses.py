"""License scans with built-in functions only: Dice coefficient over word bigrams.

Texts and templates are normalised alike: A-Z lower-cased, everything but letters and digits of ASCII
and newlines to one space.  A text is cut into units: its lines, its paragraphs (between lines without
a word), and the whole text.  A unit and a template with b1 and b2 bigrams can only reach a Dice
coefficient t if t / (2 - t) <= b1 / b2 <= (2 - t) / t.  So a unit with fewer or more words than any
template allows is ruled out before a bigram is made, and of the others each meets only the templates
of fitting size.  Before that, texts and units that hold none of a few anchor words go: the anchors
are chosen so that every possible match holds one.  Templates are a literal of fixed size; there is no join and no shuffle.

With ``windows``, notices within longer lines and texts are found too: of a text with enough bigrams of a
template, each run of as many words as the template has that starts with one of its bigrams is a unit,
across lines and without a limit on the length of the text.

Returns one row for each document with a match: its licences, sorted, the best one, and its score.
Null and empty texts, and units of one word, match nothing.  Ties go to the name that sorts first.  Rows
that repeat an id give a row each.  Long texts are cut and compared whole.  Other columns are not looked at.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provena.llm.common import ascii_lower, table

LEAST = 0.8

#: The usual short notices and texts by which these licences are applied, as (name, text).
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Use of this source code is governed by an MIT-style license that can be found in the LICENSE file."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)

#: Longer texts, and licences without a short notice above; only windows of a text are as long as these.
TEXTS = (
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely"),
)


def _words(text: str) -> list[str]:
    return "".join(c if c.isascii() and c.isalnum() else " " for c in text).lower().split()


def bigrams(words: list[str]) -> list[str]:
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def bounds(templates=TEMPLATES, least: float = LEAST) -> tuple[int, int]:
    """Numbers of words between which a unit can match some template."""
    sizes = [len(bigrams(_words(t))) for _, t in templates]
    return math.ceil(min(sizes) * least / (2 - least) - 1e-9) + 1, math.floor(max(sizes) * (2 - least) / least + 1e-9) + 1


#: Words too common in plain English to tell a licence; anchors only if a template has no other.
COMMON = frozenset("a above all an and any are as at be by can code copy copies file either for found free from has if in into is it law may not notice of on or public related source subject that the this to under use version with without work you".split())


def anchors(templates=TEMPLATES, least: float = LEAST) -> list[str]:
    """Words of which each matching unit holds at least one.

    A match shares at least least / (2 - least) of the template's bigrams, so if fewer than that share
    have no anchor in either word, a unit without an anchor cannot match.  Greedy choice: the less
    common, then the one that reaches most missing bigrams; ties by length and name."""
    grams = [[x.split(" ") for x in bigrams(_words(t))] for _, t in templates]
    need = [math.ceil(len(g) * least / (2 - least) - 1e-9) for g in grams]
    chosen: list[str] = []
    while True:
        free = [[x for x in g if not set(x) & set(chosen)] for g in grams]
        open_ = [f for f, n in zip(free, need, strict=True) if len(f) >= n > 0]
        if not open_:
            return chosen
        reach = Counter(w for f in open_ for x in f for w in set(x))
        chosen.append(max(reach, key=lambda w: (w not in COMMON and not w.isdigit(), reach[w], len(w), w)))


def _consecutive(w: Column) -> Column:
    n = F.size(w)
    return F.zip_with(F.slice(w, 1, n - 1), F.slice(w, 2, n - 1), lambda a, b: F.concat_ws(" ", a, b))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value evaluated once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _in_windows(words: Column, least: float, templates) -> Column:
    """(-dice, name) of each window of words that starts with a bigram of a template."""
    known = [(name, len(_words(text)) - 1, g) for name, text in templates if (g := bigrams(_words(text)))]
    every = F.array(*map(F.lit, sorted({x for _, _, g in known for x in g})))
    # a match shares at least so many of the template's bigrams, in any order
    need = [math.ceil(len(g) * least / (2 - least) - 1e-9) for _, _, g in known]
    literal = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(k).alias("span"), F.lit(n).alias("need"), F.array(*map(F.lit, g)).alias("grams")) for (name, k, g), n in zip(known, need, strict=True)])

    def score(t: Column, w: Column) -> Column:
        return F.struct((-2.0 * F.size(F.array_intersect(t["grams"], w)) / (F.size(t["grams"]) + F.size(w))).alias("score"), t["name"].alias("name"))

    def within(g: Column, t: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size(g)), lambda i: F.array_contains(t["grams"], F.element_at(g, i)))
        return F.transform(starts, lambda i: _let(F.array_distinct(F.slice(g, i, t["span"])), lambda w: score(t, w)))

    def possible(shared: Column) -> Column:
        return F.filter(literal, lambda t: F.size(F.array_intersect(t["grams"], shared)) >= t["need"])

    return _let(_consecutive(words), lambda g: F.flatten(F.transform(_let(F.array_intersect(g, every), possible), lambda t: within(g, t))))


def read_templates(spark: SparkSession, path: str) -> tuple[tuple[str, str], ...]:
    """(name, text) of each file: whole licence texts, as systems keep them in a folder.  They go into the plan."""
    rows = spark.read.text(path, wholetext=True).select(F.regexp_replace("_metadata.file_name", r"\.txt$", "").alias("name"), "value").collect()
    return tuple(sorted((r.name, r.value) for r in rows))


def find_licenses(df: DataFrame, least: float = LEAST, templates=TEMPLATES, id_col: str = "doc_id", text_col: str = "text", windows: bool = False, whole=()) -> DataFrame:
    """doc_id, licenses (array), best, dice of every row that has one.

    whole: further templates, of whole licence texts, which no windows are made for."""
    inner_templates, templates = templates, (*templates, *whole)
    known = [(name, g, len(g)) for name, text in templates if (g := bigrams(_words(text)))]
    literal = F.array(*[F.struct(F.lit(n).alias("name"), F.array(*map(F.lit, g)).alias("grams"), F.lit(k).alias("size")) for n, g, k in known])
    fewest, most = bounds(templates, least)
    must = "(?<![a-z0-9])(?:" + "|".join(anchors(templates, least)) + ")(?![a-z0-9])"
    ratio = (2 - least) / least
    raw = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # texts without an anchor go before any regular expression sees them
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), raw.alias("text")).filter(F.lower(raw).rlike(must))
    rows = rows.select("doc_id", F.regexp_replace(ascii_lower(F.col("text")), "[^a-z0-9\n]+", " ").alias("normal"))
    units = F.concat(F.split("normal", "\n"), F.split("normal", "\n *(?:\n *)+"), F.array("normal"))
    # of most units only the number of words is needed: they have one space between words
    units = F.transform(F.filter(units, lambda u: u.rlike(must)), lambda u: F.trim(F.regexp_replace(u, "[ \n]+", " ")))
    spaces = lambda u: F.length(u) - F.length(F.replace(u, F.lit(" "), F.lit("")))
    units = F.filter(F.array_distinct(units), lambda u: spaces(u).between(fewest - 1, most - 1))

    def pairs(w: Column) -> Column:
        return F.array_distinct(_consecutive(w))

    def against(g: Column) -> Column:
        size = F.size(g)
        fit = F.filter(literal, lambda t: (t["size"] <= size * ratio) & (size <= t["size"] * ratio))
        return F.transform(fit, lambda t: F.struct((-2.0 * F.size(F.array_intersect(t["grams"], g)) / (t["size"] + size)).alias("score"), t["name"].alias("name")))

    matches = lambda m: m["score"] <= -least
    flat = F.split(F.trim(F.regexp_replace("normal", "[ \n]+", " ")), " ")
    inner = F.filter(_in_windows(flat, least, inner_templates), matches) if windows else F.array().cast("array<struct<score:double,name:string>>")
    rows = rows.select("doc_id", units.alias("units"), inner.alias("inner")).filter((F.size("units") > 0) | F.lit(windows))
    rows = rows.select("doc_id", "inner", F.transform("units", lambda u: F.split(u, " ")).alias("words"))
    rows = rows.select("doc_id", "inner", F.transform("words", pairs).alias("grams"))
    found = F.concat(F.filter(F.flatten(F.transform("grams", against)), matches), "inner")
    rows = rows.select("doc_id", found.alias("found")).filter(F.size("found") > 0)
    best = F.array_min("found")
    return rows.select("doc_id", F.array_sort(F.array_distinct(F.transform("found", lambda m: m["name"]))).alias("licenses"), best["name"].alias("best"), (-best["score"]).alias("dice"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_licenses(table(spark, sf_dir, "documents"), templates=TEMPLATES + TEXTS, windows=True).select("doc_id", F.array_join("licenses", ",").alias("licenses"), "best", F.round("dice", 6).alias("dice"))


def oracle(least: float = LEAST, templates=TEMPLATES) -> str:
    """The same without windows and TEXTS as DuckDB SQL."""
    values = ", ".join("('{}', [{}])".format(n, ", ".join(f"'{x}'" for x in bigrams(_words(t)))) for n, t in templates)
    fewest, most = bounds(templates, least)
    return f"""
WITH templates(name, grams) AS (VALUES {values}),
normal AS (
  SELECT doc_id, regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9\\n]+', ' ', 'g') AS t
  FROM documents),
units AS (
  SELECT doc_id, unnest(list_distinct(list_concat(string_split(t, chr(10)), regexp_split_to_array(t, '\\n *(?:\\n *)+'), [t]))) AS unit FROM normal),
words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(unit, '[ \\n]+'), lambda x: x <> '') AS w FROM units),
grams AS (
  SELECT doc_id, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g
  FROM words WHERE len(w) BETWEEN {fewest} AND {most}),
scored AS (
  SELECT d.doc_id, t.name, 2.0 * len(list_intersect(d.g, t.grams)) / (len(d.g) + len(t.grams)) AS dice
  FROM grams d JOIN templates t
    ON len(t.grams) <= len(d.g) * {(2 - least) / least!r} AND len(d.g) <= len(t.grams) * {(2 - least) / least!r})
SELECT doc_id, string_agg(DISTINCT name, ',' ORDER BY name) AS licenses,
  (list(name ORDER BY dice DESC, name))[1] AS best, round(max(dice), 6) AS dice
FROM scored WHERE dice >= {least} GROUP BY doc_id
"""
