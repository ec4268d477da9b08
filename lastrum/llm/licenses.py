"""License scans by a positional index of rare words, in built-in SQL functions.

Templates are whole licence texts and notices. For each file, its RAREST licence words of the highest inverse document
frequency are looked up in the postings of the templates, and each occurrence proposes where a template would begin. The beginnings that the rarest word of a template's key phrase proposes are judged by the
intersection of the postings by relative position: the words of the template that agree on that beginning or on one up to WINDOW
words from it (a licence with words put in, left out or numbered otherwise moves its later words), each counted once. Their share of the
template's words that are at least as rare as the commonest word looked up is its score. Beginnings with a share of LEAST or more
are kept, and then the mandatory key phrase has to stand there word for word; a long text has several key phrases, of which
one has to. A phrase is a template of which every word is looked up and has to agree on one beginning, so it is found at every place.

Document frequencies are counted over all documents in a first pass; what reaches the driver is one count for each word of
the templates. The second pass judges each row by itself: no shuffle, so hot words, copies and sources cost nothing extra, and
its work is in proportion to the words of the file.

Defined results: null and empty texts have no words, no labels and score 0. Repeated rows give repeated results, whatever
their doc_id, which may be null. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word: a run of digits, letters a-z in either case, and characters beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Licence words of a file that are looked up, besides those of phrases.
RAREST = 12
#: Share of a template's asked words (those looked up, and rarer ones that the file lacks) that must agree on where it begins.
LEAST = 0.6
#: Words by which the place of a template's word may differ from where the beginning puts it.
WINDOW = 8


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    #: The mandatory phrase within the text.
    key: str
    base: bool = False

    @property
    def words(self) -> list[str]:
        return re.findall(WORD, self.text.lower())

    @property
    def key_words(self) -> list[str]:
        return re.findall(WORD, self.key.lower())

    @property
    def key_at(self) -> int:
        n = len(self.key_words)
        return next(i for i in range(len(self.words)) if self.words[i : i + n] == self.key_words)


def phrase(label: str, text: str) -> Template:
    return Template(label, text, text, True)


def whole(label: str, text: str, *keys: str) -> list[Template]:
    """A long text, of which one of several key phrases has to stand."""
    return [Template(label, text, key) for key in keys]


def spdx(identifier: str) -> Template:
    return Template(identifier.lower(), f"SPDX-License-Identifier: {identifier}", f"SPDX-License-Identifier: {identifier}")


# The base phrases with their labels; then licence texts and notices, and the key phrases of each.
BASE = (
    phrase("cc-by", "cc by"),
    phrase("gpl", "general public license"),
    phrase("reserved", "all rights reserved"),
)
NOTICES = (
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0", "Apache License Version 2 0"),
    *whole("apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless
        required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
        BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
        language governing permissions and limitations under the License.""", "in compliance with the License", "agreed to in writing software distributed under the License", "language governing permissions and limitations"),
    Template("mit", "Released under the MIT License", "MIT License"),
    *whole("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
        associated documentation files (the "Software"), to deal in the Software without restriction, including without
        limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,
        and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above
        copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.""",
        "Permission is hereby granted free of charge", "to deal in the Software without restriction", "copies or substantial portions of the Software"),
    *whole("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
        hereby granted, provided that the above copyright notice and this permission notice appear in all copies.""",
        "distribute this software for any purpose with or without fee", "provided that the above copyright notice and this permission notice appear"),
    *whole("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be
        held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software
        for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the
        following restrictions""", "alter it and redistribute it freely", "held liable for any damages arising from the use"),
    *whole("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
        the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice,
        this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
        distribution.""", "Redistribution and use in source and binary forms", "retain the above copyright notice this list of conditions", "materials provided with the distribution"),
    Template("gpl-2.0", "Licensed under the GNU General Public License, version 2", "GNU General Public License version 2"),
    Template("gpl-2.0", "Licensed under the GPL v2", "GPL v2"),
    Template("gpl-3.0", "Licensed under the GPL v3", "GPL v3"),
    Template("gpl-3.0", "Licensed under the GNU General Public License, version 3", "GNU General Public License version 3"),
    Template("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
        Public License as published by the Free Software Foundation""", "GNU General Public License as published"),
    Template("lgpl-3.0", "Licensed under the GNU Lesser General Public License, version 3", "GNU Lesser General Public License version 3"),
    Template("agpl-3.0", "Licensed under the GNU Affero General Public License, version 3", "GNU Affero General Public License version 3"),
    Template("mpl-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL
        was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""", "Mozilla Public License v 2 0"),
    Template("cc-by-4.0", "Licensed under CC BY 4.0", "CC BY 4 0"),
    Template("cc-by-4.0", "licensed under a Creative Commons Attribution 4.0 International License", "Creative Commons Attribution 4 0"),
    Template("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", "CC BY SA 4 0"),
    Template("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", "CC BY NC 4 0"),
    Template("cc0-1.0", "Released under CC0 1.0", "CC0 1 0"),
    *whole("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
        publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any
        purpose, commercial or non-commercial, and by any means.""", "free and unencumbered software", "released into the public domain"),
    *map(spdx, "MIT Apache-2.0 BSD-2-Clause BSD-3-Clause ISC Zlib GPL-2.0 GPL-3.0 LGPL-2.1 LGPL-3.0 AGPL-3.0 MPL-2.0 CC0-1.0 Unlicense".split()),
)


def vocabulary(templates: tuple[Template, ...]) -> list[str]:
    return sorted({w for t in templates for w in t.words})


def _strings(words: list[str]) -> Column:
    return F.array(*map(F.lit, words)) if words else F.array().cast("array<string>")


def words(text: Column) -> Column:
    """The words with A-Z lower-cased; only pure ASCII words are changed, and only those can be words of a template."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({WORD})"))
    return F.when(F.octet_length(text) == F.char_length(text), F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({WORD})"))).otherwise(
        F.transform(found, lambda w: F.when(F.octet_length(w) == F.char_length(w), F.lower(w)).otherwise(w))
    )


def frequencies(docs: DataFrame, templates: tuple[Template, ...]) -> tuple[int, dict[str, int]]:
    """The number of documents, and in how many of them each word of the templates occurs."""
    known = _strings(vocabulary(templates))
    rows = docs.select(F.array_intersect(words(F.col("text")), known).alias("found"))
    counts = {r["word"]: r["n"] for r in rows.select(F.explode(F.array_append("found", "")).alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()}
    return counts.pop("", 0), counts


def scan(docs: DataFrame, templates: tuple[Template, ...] = BASE + NOTICES, rarest: int = RAREST, least: float = LEAST, window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, places (array of start, template number k and share of agreement, by start)."""
    total, counts = frequencies(docs, templates)
    idf = {w: math.log((total + 1) / (counts.get(w, 0) + 1)) for w in vocabulary(templates)}
    by_idf = sorted(idf, key=lambda w: (-idf[w], w))
    number = {w: i for i, w in enumerate(by_idf)}
    known = F.create_map(*[x for w in by_idf for x in (F.lit(w), F.lit(number[w]))])
    numbers = lambda values: F.array(*map(F.lit, values))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words(F.col("text")).alias("words"))
    # the file's licence words as their numbers, rarest first
    rows = rows.withColumn("own", F.array_intersect(_strings(by_idf), F.col("words")))
    # only templates whose key phrase can stand in the file are looked up; a file that holds none of their rarest words has none
    must = [max(t.key_words, key=lambda w: (idf[w], w)) for t in templates]
    rows = rows.withColumn("some", F.arrays_overlap("own", _strings(sorted(set(must)))))
    keys = F.array(*[_strings(t.key_words) for t in templates])
    able = F.filter(F.sequence(F.lit(0), F.lit(len(templates) - 1)), lambda k: F.size(F.array_except(F.get(keys, k), F.col("own"))) == 0)
    rows = rows.withColumn("able", F.when(F.col("some"), able))
    phrases = [k for k, t in enumerate(templates) if t.base]
    of_phrases = F.flatten(F.transform(F.filter("able", lambda k: k.isin(phrases)), lambda k: F.get(keys, k)))
    anchors = F.transform("able", lambda k: F.get(_strings(must), k))
    looked = F.array_distinct(F.concat(F.slice("own", 1, rarest), anchors, of_phrases) if rarest else of_phrases)
    rows = rows.withColumn("looked", F.transform(F.when(F.size("able") > 0, looked), lambda w: F.element_at(known, w)))
    # positions of those words; files without any skip the index
    index = F.filter(F.transform("words", lambda w, i: F.struct(i.alias("i"), F.try_element_at(known, w).alias("w"))), lambda p: F.array_contains("looked", p["w"]))
    rows = rows.withColumn("index", F.when(F.size("looked") > 0, index))
    # postings by word number; a proposal is one number, in the order of template, beginning and place in the template
    wide = max(len(t.words) for t in templates) + 1
    apart = wide << 32
    shift = wide + window
    postings = F.array(*[F.array(*[F.struct(F.lit(k).alias("k"), F.lit(at).alias("at")) for k, t in enumerate(templates) for at, x in enumerate(t.words) if x == w]) for w in by_idf])
    to_number = lambda p: F.transform(F.filter(F.get(postings, p["w"]), lambda q: F.array_contains("able", q["k"])), lambda q: q["k"] * F.lit(apart) + (p["i"] - q["at"] + shift).cast("long") * wide + q["at"])
    rows = rows.withColumn("proposed", F.array_sort(F.flatten(F.transform("index", to_number))))
    each = F.array(*[F.array(*[F.lit(number[w]) for w in t.words]) for t in templates])
    cut = F.coalesce(F.element_at(known, F.get("own", F.lit(rarest - 1))), F.lit(len(by_idf))) if rarest else F.lit(-1)
    rows = rows.withColumn("cut", cut)
    asked = F.transform(F.sequence(F.lit(0), F.lit(len(templates) - 1)), lambda k: F.when(F.array_contains("able", k), F.size(F.filter(F.get(each, k), lambda w: (w <= F.col("cut")) | F.array_contains("looked", w)))).otherwise(F.lit(0)))
    rows = rows.withColumn("asked", F.when(F.size("proposed") > 0, asked))
    # beginnings: those that a template's anchor, the rarest word of its key phrase, proposes
    key_at, is_base = numbers(t.key_at for t in templates), numbers(t.base for t in templates)
    anchor_at = numbers(t.key_at + t.key_words.index(w) for t, w in zip(templates, must, strict=True))
    template = lambda x: F.floor(x / F.lit(apart)).cast("int")
    begun = F.transform("proposed", lambda x, i: F.when(x % wide == F.get(anchor_at, template(x)), F.struct(x.alias("x"), i.alias("i"), template(x).alias("k"))))
    rows = rows.withColumn("begun", F.filter(begun, lambda b: b.isNotNull()))

    def counted(b: Column) -> Column:
        # a beginning has a proposal for each place of its template at most, so those of the window are not far away in the order
        span = F.when(F.get(is_base, b["k"]), 0).otherwise(window)
        reach = (span + 1) * F.get("asked", b["k"])
        first = F.greatest(b["i"] - reach, F.lit(0))
        zero = b["x"] - b["x"] % wide
        near = F.filter(F.slice("proposed", first + 1, 2 * reach + 1), lambda x: (x >= zero - span * wide) & (x < zero + (span + 1) * wide))
        agree = F.size(F.array_distinct(F.transform(near, lambda x: x % wide)))
        start = (F.floor(b["x"] % F.lit(apart) / wide) - shift).cast("int")
        return F.struct(start.alias("start"), b["k"].alias("k"), (agree / F.get("asked", b["k"])).alias("share"))

    def stands(p: Column) -> Column:
        begin, key = p["start"] + F.get(key_at, p["k"]), F.get(keys, p["k"])
        return (begin >= 0) & (F.slice("words", F.greatest(begin, F.lit(0)) + 1, F.size(key)) == key)

    enough = F.filter(F.transform("begun", counted), lambda p: p["share"] >= F.when(F.get(is_base, p["k"]), 1.0).otherwise(least))
    places = F.array_sort(F.filter(enough, stands))
    return rows.select("doc_id", F.size("words").cast("long").alias("n_words"), F.coalesce(places, F.array().cast("array<struct<start:int,k:int,share:double>>")).alias("places"))


def digest(scanned: DataFrame, templates: tuple[Template, ...] = BASE + NOTICES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (largest share found)."""
    labels = F.array(*[F.lit(t.label) for t in templates])
    base = F.filter("places", lambda p: p["k"] < sum(t.base for t in templates))
    starts = F.transform(base, lambda p: p["start"].cast("long"))
    named = lambda places: F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: F.get(labels, p["k"])))), ",")
    return scanned.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        named(base).alias("base_labels"),
        named("places").alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda p: p["share"])), F.lit(0.0)).alias("score"),
    )
