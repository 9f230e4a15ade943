"""License scans by conditional compression.

A *block* is a word that licenses use, with as many words on both sides as a statement
can have; overlapping ones are one, and line breaks and comment signs do not count. It is
compressed with each template as the compressor's raw dictionary. The more a template
explains of a block, the smaller the block becomes, so templates are ranked by this. The
best ones are compared with the block word by word: a template is confirmed if few of its
words are missing, and none that tells licenses apart (numbers and the like). The
statement found is compressed alone and with its template, and must shrink by that.

Documents without such words never leave the JVM; the others are handled one by one, so
nothing is shuffled and memory is bounded by one text.

Defined results: a null or empty text has no findings. Repeated rows have the same
findings each, an empty table has none. Blocks of equal reductions go to the template
with fewer differences, then to the first in the list.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from difflib import Match, SequenceMatcher
from itertools import islice

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Wordings by which texts state their license.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD", "Released under the BSD License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("proprietary", "All rights reserved. No part of this work may be reproduced without permission."),
    ("proprietary", "All rights reserved."),
)
SIGN = (
    r"(?i)licen[cs]|copyright|permission|public\W+(?:\w+\W+)?domain|unencumbered|\ball\W+(?:\w+\W+){0,2}rights\W+(?:\w+\W+){0,2}reserved"
    r"|redistribut|cc[ -]by|free software|spdx"
)
_TELLING = {
    "mit", "apache", "gnu", "lesser", "library", "affero", "general", "mozilla", "mpl", "bsd", "isc", "by", "nc", "sa", "nd", "cc",
    "cc0", "attribution", "sharealike", "noncommercial", "noderivatives", "creative", "commons", "unencumbered", "waived", "rights",
}
MAX_MISSING = 0.15  # share of a template's words
MIN_REDUCTION = 0.2

_SIGN = re.compile(SIGN)
_WORD = re.compile(r"[^\W_]+")
_LONGEST = max(len(_WORD.findall(text)) for _, text in TEMPLATES)
_AROUND = 2 * _LONGEST  # words: a confirmed statement has no more, its own and added ones
_WINDOW = 3 * _AROUND


@dataclass(frozen=True)
class Finding:
    license: str
    template: int
    start: int
    end: int
    plain_bytes: int
    given_bytes: int
    missing: str
    extra: str


def _words_before(text: str, at: int, most: int) -> int:
    """Where the last ``most`` words before a place begin."""
    size = 8 * most
    while True:
        low = max(0, at - size)
        starts = [low + m.start() for m in _WORD.finditer(text[low:at])]
        if len(starts) > most:
            return starts[-most]
        if not low:
            return 0
        size *= 2


def _words_after(text: str, at: int, most: int) -> int:
    """Where the first ``most`` words after a place end."""
    last = next(islice(_WORD.finditer(text, at), most, None), None)
    return last.start() if last else len(text)


def blocks(text: str, around: int = _AROUND) -> Iterator[tuple[int, int]]:
    """Spans of candidate blocks: words with a sign and so many words on both sides; overlapping ones are one."""
    held: tuple[int, int] | None = None
    for sign in _SIGN.finditer(text):
        end = _words_after(text, sign.end(), around)
        if held and _words_before(text, sign.start(), around) <= held[1]:
            held = held[0], end
        else:
            if held:
                yield held
            held = _words_before(text, sign.start(), around), end
    if held:
        yield held


def _tells(word: str) -> bool:
    return word in _TELLING or word[0].isdigit()


def _compare(own: list[str], words: list[str], same: list[Match]) -> tuple[list[str], list[str], int, int]:
    """Words missing and added between the first and the last match, and where these are."""
    first, last = same[0].b, same[-1].b + same[-1].size
    kept = {i for m in same for i in range(m.a, m.a + m.size)}
    used = {i for m in same for i in range(m.b, m.b + m.size)}
    return [w for i, w in enumerate(own) if i not in kept], [words[i] for i in range(first, last) if i not in used], first, last


def _without_strays(same: list[Match]) -> list[Match]:
    """Matches without those at the ends that are farther from the rest than they are long."""
    low, high = 0, len(same)
    while high - low > 1 and same[low + 1].b - same[low].b - same[low].size > same[low].size:
        low += 1
    while high - low > 1 and same[high - 1].b - same[high - 2].b - same[high - 2].size > same[high - 1].size:
        high -= 1
    return same[low:high]


class Scanner:
    """Compressors of all templates, made once in a worker."""

    def __init__(self, templates: tuple[tuple[str, str], ...] = TEMPLATES):
        raw = zstandard.DICT_TYPE_RAWCONTENT
        self._templates = templates
        self._words = [_WORD.findall(text.lower()) for _, text in templates]
        self._bags = [Counter(words) for words in self._words]
        self._alone = zstandard.ZstdCompressor(level=9, write_content_size=False)
        self._given = [
            zstandard.ZstdCompressor(level=9, write_content_size=False, dict_data=zstandard.ZstdCompressionDict(text.lower().encode(), dict_type=raw))
            for _, text in templates
        ]

    def _may_hold(self, template: int, words: Counter[str]) -> bool:
        """Whether the words suffice in number; none that tells licenses apart may be missing."""
        lacking = self._bags[template] - words
        return lacking.total() <= MAX_MISSING * len(self._words[template]) and not any(map(_tells, lacking))

    def _differences(self, template: int, words: list[str]) -> tuple[list[str], list[str], int, int] | None:
        """Words missing and added where the template is confirmed, and the first and last word there.

        Each stretch around the longest common run is compared by itself, so that equal
        words of the text before and behind are not taken for the template's."""
        own = self._words[template]
        matcher = SequenceMatcher(None, own, words, autojunk=False)
        parts = [(0, len(words))]
        while parts:
            low, high = parts.pop()
            if not self._may_hold(template, Counter(words[low:high])):
                continue
            run = matcher.find_longest_match(0, len(own), low, high)
            if not run.size:
                continue
            start = max(low, run.b - run.a - len(own))
            stretch = words[start : min(high, run.b - run.a + 2 * len(own))]
            same = [m for m in SequenceMatcher(None, own, stretch, autojunk=False).get_matching_blocks() if m.size]
            for matches in (_without_strays(same), same):
                missing, extra, first, last = _compare(own, stretch, matches)
                telling = any(map(_tells, (*missing, *extra)))
                if not telling and len(missing) <= MAX_MISSING * len(own) and len(extra) <= len(own):
                    return missing, extra, start + first, start + last
            parts += (run.b + run.size, high), (low, run.b)
        return None

    def _best(self, text: str, start: int, end: int) -> Finding | None:
        """The confirmed statement that explains most of a part."""
        part = text[start:end]
        spans = [(m.start(), m.end()) for m in _WORD.finditer(part)]
        words = [part[a:b].lower() for a, b in spans]
        bag = Counter(words)
        may = [i for i in range(len(self._words)) if self._may_hold(i, bag)]
        data = part.lower().encode("utf-8", "surrogatepass")
        given = {i: len(self._given[i].compress(data)) for i in may}
        best = None
        for i in sorted(may, key=lambda i: (given[i], i)):
            # A long template beats the short one inside it: what it leaves unsaid of the part counts.
            if best is not None and given[i] > best[0][0]:
                break
            difference = self._differences(i, words)
            if difference is None:
                continue
            missing, extra, first, last = difference
            a, b = start + spans[first][0], start + spans[last - 1][1]
            said = text[a:b].lower().encode("utf-8", "surrogatepass")
            alone, told = len(self._alone.compress(said)), len(self._given[i].compress(said))
            rank = (given[i], len(missing) + len(extra), i)
            if alone - told >= MIN_REDUCTION * alone and (best is None or rank < best[0]):
                best = rank, Finding(self._templates[i][0], i, a, b, alone, told, " ".join(missing), " ".join(extra))
        return best and best[1]

    def _scan_window(self, text: str, start: int, end: int) -> list[Finding]:
        """Confirmed findings: the best of all words, then of those left of and right of each finding."""
        found, parts = [], [(start, end)]
        while parts:
            low, high = parts.pop()
            best = self._best(text, low, high)
            if best:
                found.append(best)
                parts += (part for part in ((low, best.start), (best.end, high)) if _SIGN.search(text, *part))
        return found

    def scan_block(self, text: str, start: int, end: int) -> Iterator[Finding]:
        """Confirmed findings in a block, in windows that overlap by the words of a statement.
        One that begins in the overlap is left to the next window, which has all of it."""
        while True:
            words = list(islice(_WORD.finditer(text, start, end), _WINDOW + 1))
            if len(words) <= _WINDOW:
                yield from self._scan_window(text, start, end)
                return
            edge = words[_WINDOW - _AROUND].start()
            found = [f for f in self._scan_window(text, start, words[_WINDOW].start()) if f.start < edge]
            yield from found
            start = max(edge, *(f.end for f in found)) if found else edge

    def scan(self, text: str | None) -> list[Finding]:
        found = [f for start, end in blocks(text or "") for f in self.scan_block(text, start, end)]
        return sorted(found, key=lambda f: (f.start, f.end))


_SCHEMA = (
    "doc_id bigint, license string, template int, start bigint, `end` bigint, plain_bytes bigint, given_bytes bigint, "
    "missing string, extra string"
)


def find_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each confirmed license statement: where it is (code points), its template,
    the statement's compressed sizes alone and given the template, and the words that differ."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner()
        names = [part.split()[0].strip("`") for part in _SCHEMA.split(", ")]
        for batch in batches:
            rows = [
                (doc_id, f.license, f.template, f.start, f.end, f.plain_bytes, f.given_bytes, f.missing, f.extra)
                for doc_id, text in zip(batch["doc_id"].astype("Int64"), batch["text"])
                for f in scanner.scan(text)
            ]
            if rows:
                yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})

    signed = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).where(F.col("text").rlike(SIGN))
    found = signed.mapInPandas(run, _SCHEMA)
    exact = (F.col("missing") == "") & (F.col("extra") == "")
    return found.withColumn("exact", exact).withColumnRenamed("doc_id", id_col)
