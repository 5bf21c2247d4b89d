"""Licence notices in texts, by the Dice coefficient of word bigrams; DataFrame functions only.

Every line, sentence and paragraph of a text, and the whole text, is normalised to lower-case
words and compared with the licence templates that its number of bigrams allows: a coefficient
of t needs sizes whose ratio is at least t / (2 - t). Templates are one-sentence notices, standard
headers, the telling sentences of licence texts, and short licence texts as a whole.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

THRESHOLD = 0.75
TELLING = 5  # letters of a word that is rare enough to look for alone

# Sentences and paragraphs of public licence texts.
_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to
use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom
the Software is furnished to do so, subject to the following conditions:"""
_MIT_NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_MIT_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT
HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_GRANT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies."""
_ISC_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_GRANT = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:"""
_BSD_SOURCE = """Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer."""
_BSD_BINARY = """Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_THIRD = """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission."""
_BSD_WARRANTY = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN
NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS;
OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING
NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_APACHE_TERMS = """Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."""
_MPL_COPY = """If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""
_UNLICENSE = """This is free and unencumbered software released into the public domain."""


def _gnu(version: str, name: str = "", later: bool = True) -> str:
    """The header that the GNU licences ask for at the top of each file."""
    which = f"either version {version} of the License, or (at your option) any later version" if later else f"version {version} of the License"
    return f"""This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} General Public
License as published by the Free Software Foundation, {which}."""


# Public licence notices by their SPDX identifiers; "BSD" where the number of clauses doesn't show.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0-only", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0-only", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("Proprietary", "All rights reserved."),
    ("MIT", "The MIT License (MIT)"),
    ("MIT", _MIT_GRANT),
    ("MIT", _MIT_NOTICE),
    ("MIT", _MIT_WARRANTY),
    ("MIT", " ".join([_MIT_GRANT, _MIT_NOTICE, _MIT_WARRANTY])),
    ("ISC", _ISC_GRANT),
    ("ISC", _ISC_WARRANTY),
    ("ISC", " ".join([_ISC_GRANT, _ISC_WARRANTY])),
    ("BSD", _BSD_GRANT),
    ("BSD", _BSD_SOURCE),
    ("BSD", _BSD_BINARY),
    ("BSD", _BSD_WARRANTY),
    ("BSD-3-Clause", _BSD_THIRD),
    ("BSD-2-Clause", " ".join([_BSD_GRANT, _BSD_SOURCE, _BSD_BINARY, _BSD_WARRANTY])),
    ("BSD-3-Clause", " ".join([_BSD_GRANT, _BSD_SOURCE, _BSD_BINARY, _BSD_THIRD, _BSD_WARRANTY])),
    ("Apache-2.0", _APACHE_TERMS),
    ("GPL-3.0-or-later", _gnu("3")),
    ("GPL-2.0-or-later", _gnu("2")),
    ("GPL-3.0-only", _gnu("3", later=False)),
    ("GPL-2.0-only", _gnu("2", later=False)),
    ("LGPL-3.0-or-later", _gnu("3", "Lesser")),
    ("LGPL-2.1-or-later", _gnu("2.1", "Lesser")),
    ("AGPL-3.0-or-later", _gnu("3", "Affero")),
    ("MPL-2.0", _MPL_COPY),
    ("Unlicense", _UNLICENSE),
]


def templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TEMPLATES, "license string, notice string")


def normalised(text: Column) -> Column:
    """Lower-case words of letters and digits, joined by single spaces; version dots and hyphens part words."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def bigrams(line: Column) -> Column:
    """The set of word bigrams of a normalised line; a single word has none."""
    words = F.split(line, " ")
    pairs = F.zip_with(F.slice(words, F.lit(1), F.size(words) - 1), F.slice(words, F.lit(2), F.size(words) - 1), lambda a, b: F.concat_ws(" ", a, b))
    return F.when(F.size(words) > 1, F.array_distinct(pairs)).otherwise(F.array().cast("array<string>"))


def telltales(templates: list[set[str]], threshold: float) -> str:
    """A pattern that the lower-cased text of every passage holds that reaches the threshold with some template.

    A passage shares at least ``t / (2 - t)`` of a template's bigrams. So for each template words, or
    bigrams of short words, are chosen that occur in more bigrams than it may lack; words that serve
    many templates go first, as each text is searched for all of them.
    """
    left = [set(pairs) for pairs in sorted(templates, key=lambda p: (len(p), sorted(p)))]
    needs = [len(pairs) - math.ceil(len(pairs) * threshold / (2 - threshold) - 1e-9) + 1 for pairs in left]

    def take(found: Callable[[str], bool]) -> None:
        for i, pairs in enumerate(left):
            gone = {p for p in pairs if found(p)}
            left[i], needs[i] = pairs - gone, needs[i] - len(gone)

    chosen: list[str] = []
    while True:
        gains: Counter[str] = Counter()
        for pairs, need in zip(left, needs):
            if need > 0:
                held = Counter(w for p in pairs for w in set(p.split(" ")) if len(w) >= TELLING)
                gains.update({w: min(times, need) * len(w) for w, times in held.items()})
        if not gains:
            break
        word = max(gains, key=lambda w: (gains[w], w))
        chosen.append(word)
        take(lambda p: word in p.split(" "))
    for i in range(len(left)):
        while needs[i] > 0:
            pair = max(left[i], key=lambda p: (len(p), p))
            chosen.append(pair.replace(" ", "[^a-z0-9]+"))
            take(lambda p: p == pair)
    initials = sorted({c[0] for c in chosen})
    grouped = (f"{i}(?:{'|'.join(sorted(c[1:] for c in chosen if c[0] == i))})" for i in initials)
    return f"(?<![a-z0-9])(?:{'|'.join(grouped)})(?![a-z0-9])"


def _tidy(passage: Column) -> Column:
    return F.regexp_replace(passage, "^[ \t\r\n]+|[ \t\r\n]+$", "")


def _passages(text: Column, told: str) -> Column:
    """Lines with their numbers, then sentences, paragraphs and the text where they are no smaller unit, once each."""

    def telling(units: Column) -> Column:
        return F.filter(F.transform(units, _tidy), lambda u: F.lower(u).rlike(told))

    def rows(unit: str, units: Column) -> Column:
        return F.transform(units, lambda u: F.struct(F.lit(unit).alias("unit"), F.lit(0).alias("line"), u.alias("found")))

    split = F.split(text, "\n", -1)
    lines = F.transform(split, lambda u, i: F.struct(F.lit("line").alias("unit"), (i + 1).alias("line"), u.alias("found")))
    lines = F.filter(lines, lambda u: F.lower(u["found"]).rlike(told))
    sentences = telling(F.split(F.regexp_replace(text, "([.!?:])[ \t\r\n]+", "$1\u0001"), "\u0001|\n[ \t\r]*\n", -1))
    paragraphs = telling(F.split(text, "\n[ \t\r]*\n", -1))
    smaller = telling(split)
    parts = [lines]
    for unit, units in (("sentence", sentences), ("paragraph", paragraphs), ("text", telling(F.array(text)))):
        parts.append(rows(unit, F.array_except(units, smaller)))
        smaller = F.array_union(smaller, units)
    return F.concat(*parts)


def scan(
    docs: DataFrame, notices: DataFrame | None = None, threshold: float = THRESHOLD,
    key: str = "doc_id", text: str = "text", separator: str | None = "\n",
) -> DataFrame:
    """Passages that match a licence: ``doc_id``, ``unit``, ``line``, ``license``, ``dice`` and ``found``, the passage.

    Passages are lines (with their numbers, from 1), and sentences, paragraphs and the whole text (``line`` 0), which may
    run over several lines. A sentence ends with ``.``, ``!``, ``?`` or ``:`` before white space, or with its paragraph;
    blank lines part paragraphs. Larger units are trimmed and stand once a document, and only where they aren't a smaller
    unit too. With another ``separator`` passages are what it parts, without one a whole text is one; their
    ``unit`` is ``line``, too. ``notices`` holds
    ``license`` and ``notice``; each passage gets its best template, ties going to the first
    identifier by name. Null and empty texts and passages of one word match nothing; rows
    repeated in the input are repeated in the result; other columns are left out. The
    templates are a small table given by the caller: it becomes one constant array, so no
    join and no shuffle takes place.
    """
    notices = templates(docs.sparkSession) if notices is None else notices
    known = notices.select("license", bigrams(normalised(F.col("notice"))).alias("pairs")).distinct().orderBy("license", "pairs").collect()
    known = [r for r in known if r.license is not None and r.pairs]
    told = telltales([set(r.pairs) for r in known], threshold)
    # One look for the telltales spares most texts, and most lines of the others, the rest.
    docs = docs.where(F.lower(text).rlike(told))
    if separator == "\n":
        lines = docs.select(F.col(key).alias("doc_id"), F.inline(_passages(F.col(text), told)))
    else:
        passages = F.split(text, f"[{separator}]", -1) if separator else F.array(text)
        lines = docs.select(F.col(key).alias("doc_id"), F.posexplode(passages).alias("line", "found"))
        lines = lines.where(F.lower("found").rlike(told)).select("doc_id", F.lit("line").alias("unit"), (F.col("line") + 1).alias("line"), "found")
    if not known:
        return lines.select("doc_id", "unit", "line", F.lit("").alias("license"), F.lit(0.0).alias("dice"), "found").limit(0)
    ratio = threshold / (2 - threshold)
    least, most = (ratio * min(len(r.pairs) for r in known), max(len(r.pairs) for r in known) / ratio)
    normal = F.col("normal")
    words = F.length(normal) - F.length(F.translate(normal, " ", "")) + 1
    # A passage of w words has w - 1 bigrams at most, and half as many words as characters.
    # Generated columns are computed once; the planner would repeat plain ones in each filter that follows.
    lines = lines.where(F.length("found") >= 2 * least).select("*", F.explode(F.array(normalised(F.col("found")))).alias("normal"))
    lines = lines.where(words - 1 >= least).select("*", F.explode(F.array(bigrams(normal))).alias("pairs"))
    lines = lines.where(F.size("pairs").between(least, most))
    rows = [
        F.struct(F.lit(-i).alias("order"), F.lit(r.license).alias("license"), F.lit(len(r.pairs)).alias("size"), F.array(*map(F.lit, r.pairs)).alias("pairs"))
        for i, r in enumerate(known)
    ]
    size = F.size("pairs")
    fitting = F.filter(F.array(*rows), lambda t: (size >= t["size"] * ratio) & (size <= t["size"] / ratio))
    scored = F.transform(
        fitting,
        lambda t: F.struct((F.lit(2.0) * F.size(F.array_intersect(F.col("pairs"), t["pairs"])) / (size + t["size"])).alias("dice"), t["order"].alias("order"), t["license"].alias("license")),
    )
    best = F.filter(F.array(F.array_max(scored)), lambda b: b["dice"] >= threshold)
    return lines.select("doc_id", "unit", "line", "found", F.inline(best)).select("doc_id", "unit", "line", "license", "dice", "found")
