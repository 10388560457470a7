"""License scans by patience alignment against templates.

Where a text may hold a template is settled by counting: a window of the text, half as long again as
the template, must hold enough of the template's words.  There template and text are aligned: equal
ends are matched, then the words that occur once on either side anchor the rest, of them the longest
increasing subsequence is kept, and the gaps between anchors are aligned in the same way.  The
coverage is the share of the template's words that are matched.  A template of at most ``SHORT`` words
must stand word for word and without gaps, since few words are soon found in any order of a sentence.

A window without enough of the template's words cannot reach the coverage asked for, so none is lost
by the count, and texts without enough of the words anywhere are passed at the cost of a set lookup.

Templates are given as a mapping or as a table (``templates_of``); those below are the default.

Nulls and edges: words are runs of letters and digits, in lower case; a null or empty text holds no
license; a template may be found several times, but not overlap itself; different templates may
overlap or cover the same words, and each is returned, in the order of the templates and then of the
places; a template without words is none; a very long text is scanned in one pass over the places of
the templates' words; rows with a null id are carried along; repeated rows each return a row; an empty
table returns no rows.  Other columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapquery.llm._shared import tidied

#: Public license texts and the notices by which works name a license.
TEMPLATES = {
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "MIT notice": "Released under the MIT License",
    "MIT": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
        "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        'copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH '
        "REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution."
    ),
    "GPL-3.0 notice": "licensed under the GNU General Public License, version 3",
    "GPL": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
        "Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "all rights reserved": "All rights reserved",
}

SHORT = 12  # words
TEMPLATE_BYTES = 16 << 20  # of all templates, at most: each task holds them

words_of = re.compile(r"[^\W_]+").findall


def increasing(places: list[int]) -> list[int]:
    """Indices of a longest increasing subsequence (the piles of a game of patience)."""
    tops: list[int] = []
    piles: list[int] = []
    before = [-1] * len(places)
    for i, p in enumerate(places):
        k = bisect_left(tops, p)
        before[i] = piles[k - 1] if k else -1
        tops[k : k + 1] = [p]
        piles[k : k + 1] = [i]
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def align(template: list[str], text: list[str]) -> list[tuple[int, int]]:
    """Matched places (of the template, of the text), rising in both."""
    matched, todo = [], [(0, len(template), 0, len(text))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and template[a] == text[c]:
            matched.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and template[b - 1] == text[d - 1]:
            b, d = b - 1, d - 1
            matched.append((b, d))
        if a == b or c == d:
            continue
        own, other = Counter(template[a:b]), Counter(text[c:d])
        at = {w: i for i, w in enumerate(text[c:d], c) if other[w] == 1}
        pairs = [(i, at[w]) for i, w in enumerate(template[a:b], a) if own[w] == 1 and w in at]
        if not pairs:
            continue
        anchors = [pairs[k] for k in increasing([p[1] for p in pairs])]
        matched += anchors
        for (i, j), (k, m) in zip([(a - 1, c - 1), *anchors], [*anchors, (b, d)], strict=True):
            todo.append((i + 1, k, j + 1, m))
    return sorted(matched)


class Scanner:
    """Finds templates in texts, each with at least a share ``least`` of its words."""

    def __init__(self, templates: dict[str, str], least: float) -> None:
        self.least = least
        self.templates = [(name, words, Counter(words)) for name, t in templates.items() if (words := words_of(t.lower()))]
        self.vocabulary = frozenset().union(*(c for _, _, c in self.templates))

    def __call__(self, text: str | None) -> tuple[int, list[tuple[str, float, int, int]]]:
        """Number of words, and (template, coverage, first word, last word exclusive) of each find."""
        words = words_of(text.lower()) if text else []
        present, found = self.vocabulary.intersection(words), []
        if not present:
            return len(words), []
        where = [i for i, w in enumerate(words) if w in present]
        for name, template, counts in self.templates:
            short = len(template) <= SHORT
            need = len(template) if short else self.least * len(template)
            if sum(n for w, n in counts.items() if w in present) < need:
                continue
            places, width, skip = [i for i in where if words[i] in counts], len(template) if short else -(-3 * len(template) // 2), -1
            end = 0
            for k, first in enumerate(places):
                while end < len(places) and places[end] < first + width:
                    end += 1
                if first < skip or end - k < need:
                    continue
                matched = align(template, words[first : first + width])
                coverage = len(matched) / len(template)
                if len(matched) >= need:
                    skip = first + matched[-1][1] + 1
                    found.append((name, coverage, first + matched[0][1], skip))
        return len(words), found


def templates_of(table: DataFrame, name_col: str = "name", text_col: str = "text") -> dict[str, str]:
    """Templates from a table, in the order of their names; its size is checked, and rows with a null are left out."""
    rows = table.select(F.col(name_col).cast("string").alias("name"), F.col(text_col).alias("text")).dropna()
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > TEMPLATE_BYTES:
        raise ValueError(f"templates of {size} bytes; at most {TEMPLATE_BYTES}")
    return {r.name: r.text for r in rows.orderBy("name", "text").collect()}


FOUND = "array<struct<template:string,coverage:double,first:int,last:int>>"


def scan(docs: DataFrame, templates: dict[str, str] | DataFrame | None = None, least: float = 0.85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, found) of each row."""
    kind = docs.schema[id_col].dataType.simpleString()
    templates = templates_of(templates) if isinstance(templates, DataFrame) else templates
    scanner = Scanner(TEMPLATES if templates is None else templates, least)
    fields = pa.list_(pa.struct([("template", pa.string()), ("coverage", pa.float64()), ("first", pa.int32()), ("last", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                each = [scanner(t) for t in part.column(1).to_pylist()]
                found = [[dict(zip(("template", "coverage", "first", "last"), f, strict=True)) for f in e[1]] for e in each]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([e[0] for e in each], pa.int64()), pa.array(found, fields)], names=["id", "n_words", "found"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(tidied(run), f"id {kind}, n_words long, found {FOUND}")
