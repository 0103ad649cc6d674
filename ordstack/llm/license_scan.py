"""Licence scan: normalised text against licence templates by Dice coefficient over word bigrams.

A document is looked at line by line and, where lines stand together, paragraph by paragraph. Two
bigram sets of sizes m and n can't reach a coefficient t unless t / (2 - t) <= m / n <= (2 - t) / t, so
most blocks meet no template at all; the rest are compared exactly. One pass, no shuffle.

A notice inside a longer line, wrapped inside a paragraph, or over several paragraphs fills no block. So
runs of words of the whole text are compared too: those that begin and end with a bigram of the template
and hold enough of them for the coefficient.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ordstack.llm.corpus import columns, read, spans

#: Licence notices by SPDX identifier: fixed values, as their authors word them.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
                   "except in compliance with the License. You may obtain a copy of the License at "
                   "http://www.apache.org/licenses/LICENSE-2.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of "
                         "the GNU General Public License as published by the Free Software Foundation, either "
                         "version 3 of the License, or (at your option) any later version."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the \"Software\"), to deal in the Software without restriction, "
            "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
            "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
            "subject to the following conditions:"),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to "
                     "endorse or promote products derived from this software without specific prior written "
                     "permission."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring "
                "rights to this work."),
    ("ISC", "Released under the ISC License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted, provided that the above copyright notice and this permission notice appear in all "
            "copies.\n\n"
            "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE "
            "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE "
            "FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM "
            "LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
            "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("LGPL-2.1", "Licensed under the GNU Lesser General Public License, version 2.1."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the "
                "MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, "
             "and to alter it and redistribute it freely, subject to the following restrictions:"),
)
LEAST = 0.8
_WORD = re.compile(r"[a-z0-9]+")
_BLANK = re.compile(r"\n[\x20\x09-\x0D]*\n")

Sized = tuple[str, frozenset[tuple[str, str]]]


def bigrams(text: str) -> frozenset[tuple[str, str]]:
    """Distinct pairs of neighbouring words: runs of ASCII letters and digits after lower-casing."""
    return frozenset(pairwise(_WORD.findall(text.lower())))


def dice(a: frozenset, b: frozenset) -> float:
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 0.0


def blocks(text: str) -> Iterator[tuple[int, list[str]]]:
    """Number of words before, and words, of lines, then of paragraphs of several lines. Every part of the
    text is in one of the lines."""
    at = 0
    for line in text.split("\n"):
        words = _WORD.findall(line.lower())
        yield at, words
        at += len(words)
    at = 0
    for paragraph in _BLANK.split(text):
        words = _WORD.findall(paragraph.lower())
        if "\n" in paragraph.strip("\n"):
            yield at, words
        at += len(words)


class Scanner:
    """Compares blocks and, with ``places``, runs of words that no matching block touches."""

    def __init__(self, templates=TEMPLATES, least: float = LEAST, places: bool = False):
        self.least, self.places = least, places
        self.templates: list[Sized] = [(name, bigrams(text)) for name, text in templates]
        if not 0 < least <= 1 or any(not b for _, b in self.templates):
            raise ValueError("a template needs two words, and the coefficient lies in (0, 1]")
        ratio = least / (2 - least)
        #: Templates that a block of each number of bigrams may match.
        self.by_size: dict[int, list[Sized]] = {}
        for t in self.templates:
            n = len(t[1])
            for m in range(int(ratio * n), int(n / ratio) + 2):
                if ratio * n <= m + 1e-9 and m <= n / ratio + 1e-9:
                    self.by_size.setdefault(m, []).append(t)
        #: Templates that hold each bigram; per template the shared bigrams a run needs, and how long it may be.
        self.holders: dict[tuple[str, str], list[int]] = {}
        self.needs: list[tuple[int, int]] = []
        for i, (_, text) in enumerate(templates):
            n = len(self.templates[i][1])
            for pair in self.templates[i][1]:
                self.holders.setdefault(pair, []).append(i)
            length = len(_WORD.findall(text.lower())) - 1
            self.needs.append((max(1, math.ceil(ratio * n - 1e-9)), int(length / ratio + 1e-9)))

    def scan(self, text: str | None) -> list[tuple[str, float, int]]:
        """(licence, best coefficient, matching blocks and places) of each licence found, in order of name."""
        found: dict[str, tuple[float, int]] = {}
        matched: list[tuple[int, int]] = []
        for at, words in blocks(text or ""):
            if len(words) < 2:
                continue
            made = frozenset(pairwise(words))
            best: dict[str, float] = {}
            for name, template in self.by_size.get(len(made), ()):
                score = dice(made, template)
                if score >= self.least:
                    best[name] = max(score, best.get(name, 0.0))
            for name, score in best.items():
                top, n = found.get(name, (0.0, 0))
                found[name] = (max(top, score), n + 1)
                matched.append((at, at + len(words)))
        if self.places and text:
            for name, score in self._places(text, matched):
                top, n = found.get(name, (0.0, 0))
                found[name] = (max(top, score), n + 1)
        return [(name, *found[name]) for name in sorted(found)]

    def _places(self, text: str, matched: list[tuple[int, int]]) -> Iterator[tuple[str, float]]:
        """Licence and coefficient of the best runs of words that don't overlap each other or ``matched``: of
        licences with similar notices the nearest is told."""
        pairs = list(pairwise(_WORD.findall(text.lower())))
        holders = self.holders
        hits: dict[int, list[int]] = {}
        for i, pair in enumerate(pairs):
            if pair in holders:
                for t in holders[pair]:
                    hits.setdefault(t, []).append(i)
        runs: list[tuple[float, int, int, str]] = []
        for t, at in hits.items():
            need, reach = self.needs[t]
            for j in range(len(at) - need + 1):
                if at[j + need - 1] - at[j] < reach:
                    score, lo, hi = self._best_run(pairs, at, j, reach, len(self.templates[t][1]))
                    if score >= self.least:
                        runs.append((score, lo, hi, self.templates[t][0]))
        # matching blocks overlap, lines being parts of paragraphs: merged, ranges are apart and in order
        starts: list[int] = []
        ends: list[int] = []
        for lo, hi in sorted(matched):
            if ends and lo < ends[-1]:
                ends[-1] = max(ends[-1], hi)
            else:
                starts.append(lo)
                ends.append(hi)
        for score, lo, hi, name in sorted(runs, key=lambda r: (-r[0], r[1] - r[2], r[1], r[3])):
            i = bisect_right(ends, lo)  # the first range that ends beyond the run's start
            if i == len(starts) or hi <= starts[i]:
                starts.insert(i, lo)
                ends.insert(i, hi)
                yield name, score

    @staticmethod
    def _best_run(pairs: list, at: list[int], j: int, reach: int, n: int) -> tuple[float, int, int]:
        """Coefficient, first word and end of the best run from the j-th hit on, ``reach`` bigrams at most."""
        start = done = at[j]
        seen: set = set()
        shared, best = 0, (0.0, start, start)
        for i in range(j, len(at)):
            if at[i] - start >= reach:
                break
            seen.update(pairs[done : at[i]])
            done = at[i] + 1
            if pairs[at[i]] not in seen:
                shared += 1
                seen.add(pairs[at[i]])
            score = 2 * shared / (len(seen) + n)
            if score > best[0]:
                best = (score, start, at[i] + 2)
        return best


def scan(df: DataFrame, key: str = "doc_id", templates=TEMPLATES, least: float = LEAST) -> DataFrame:
    """One row per row of ``df`` and licence found: key, ``licence``, ``dice``, ``n_blocks`` (blocks that
    match, and places elsewhere in the text that do).

    Null and empty texts have none. A null key stays null; repeated rows are reported each.
    """
    df = columns(df, key, "text")
    Scanner(templates, least)  # raises here for templates that can't be used

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, least, places=True)
        for batch in batches:
            for lo, hi in spans(batch.column(1)):
                part = batch.slice(lo, hi - lo)
                at, rows = [], []
                for i, text in enumerate(part.column(1).to_pylist()):
                    for row in scanner.scan(text):
                        at.append(i)
                        rows.append(row)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(at, pa.int32())),
                        pa.array([r[0] for r in rows], pa.string()),
                        pa.array([r[1] for r in rows], pa.float64()),
                        pa.array([r[2] for r in rows], pa.int64()),
                    ],
                    names=[key, "licence", "dice", "n_blocks"],
                )

    kind = dict(df.dtypes)[key]
    return df.mapInArrow(run, f"`{key}` {kind}, licence string, dice double, n_blocks long")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences found in every document."""
    return scan(read(spark, sf_dir))


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _bigrams_sql(words: str) -> str:
    return f"list_distinct(list_transform(list_zip({words}[1:-2], {words}[2:]), lambda p: p[1] || ' ' || p[2]))"


OP6_SQL = rf"""WITH t AS (SELECT name, {_bigrams_sql("ws")} AS bs FROM (SELECT name,
    regexp_extract_all(lower(body), '[a-z0-9]+') AS ws
    FROM (VALUES {", ".join(f"({_text(n)}, {_text(b)})" for n, b in TEMPLATES)}) v(name, body))),
d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text FROM documents),
p AS (SELECT id, doc_id, trim(unnest(string_split_regex(text, '\n[\x20\x09-\x0D]*\n')), chr(10)) AS b FROM d),
b AS (SELECT id, doc_id, row_number() OVER () AS block, regexp_extract_all(lower(b), '[a-z0-9]+') AS ws FROM (
    SELECT id, doc_id, unnest(string_split(text, chr(10))) AS b FROM d
    UNION ALL SELECT id, doc_id, b FROM p WHERE contains(b, chr(10)))),
s AS (SELECT id, doc_id, block, {_bigrams_sql("ws")} AS bs FROM b WHERE len(ws) BETWEEN 2 AND 400),
m AS (SELECT id, doc_id, block, name, max(2.0::DOUBLE * len(list_intersect(s.bs, t.bs)) / (len(s.bs) + len(t.bs))) AS score
    FROM s JOIN t ON len(s.bs) BETWEEN len(t.bs) * 0.6 AND len(t.bs) * 1.6 GROUP BY ALL)
SELECT doc_id, name AS licence, max(score) AS dice, count(*) AS n_blocks FROM m WHERE score >= {LEAST}
GROUP BY id, doc_id, name"""
