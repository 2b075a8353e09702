"""License scan by conditional compression.

Words that name a license are cues. A template's statement has at most (1 + MOST_CHANGED) times its words, so what may state
it around a cue is a bounded stretch of words, whatever lines it is wrapped into and however long its line is. Templates are
compared word by word with the stretches of their length around every cue, and a template is confirmed where few enough
words are missing or strange. Only templates of whose words too few occur in a stretch at all are left out before.

The words around a cue that confirmed statements span are compressed alone and with every template as zstandard raw dictionary.
The size that this saves, as a share of what the template itself weighs, orders the templates, and the first confirmed one is
the cue's. Where statements of several cues overlap, the one with fewer changes stands, and the other cue is asked again for
one that stands clear, so all others are reported side by side. A cue without a confirmed template is told with the one that
saves most of the words within the longest template's reach.

Texts without a candidate are told apart before Python sees them. One narrow pass: no shuffle, no state.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import columnar
from tidemark.llm.shared import text_batches

CUE = r"(?i)licen[sc]|copyright|spdx|permission\W+is\W+hereby\W+granted|redistribution\W+and\W+use|public\W+domain|all\W+rights\W+reserved"
MOST_CHANGED = 0.2

# Wordings by which works state their license, several for one license where usage differs.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software'),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Released under CC0 1.0 into the public domain."),
    ("proprietary", "All rights reserved."),
)


_WORD = re.compile(r"[\w.+-]*\w")
_CUE = re.compile(CUE)


def _words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _statements(words: list[str], own: list[str]) -> list[tuple[int, int, int]]:
    """(changes, start, end): for every end, the stretch of words with the fewest words missing from or strange to `own`.

    An alignment by columns; a cell holds its changes in the upper half and its start, negated, in the lower, so of equal
    ones the shortest stands.
    """
    one, known = 1 << 32, {w: np.array([x == w for x in own]) for w in set(own) & set(words)}
    down = np.arange(len(own) + 1, dtype=np.int64) * one
    far = np.int64(1 << 62)
    cell, out = down.copy(), []
    for j, w in enumerate(words):
        after = cell + one
        if w in known:
            after[1:] = np.minimum(after[1:], np.where(known[w], cell[:-1], far))
        after[0] = -(j + 1)
        cell = np.minimum.accumulate(after - down) + down
        changes, start = -((-int(cell[-1])) // one), -int(cell[-1])
        out.append((changes, start % one, j + 1))
    return out


def _free(taken: list[tuple], start: int, end: int) -> bool:
    """Whether no stretch of the sorted list, none of which overlaps another, overlaps this one."""
    at = bisect_left(taken, (start,))
    return (at == 0 or taken[at - 1][1] <= start) and (at == len(taken) or taken[at][0] >= end)


def _apart(statements: Iterable[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of (changes, start, end) those that overlap none with fewer changes, as (start, end, changes)."""
    out: list[tuple] = []
    for changes, start, end in sorted(statements):
        if _free(out, start, end):
            insort(out, (start, end, changes))
    return out


class Scanner:
    def __init__(self, templates: tuple[tuple[str, str], ...] = TEMPLATES):
        self.templates = templates
        self.plain = zstandard.ZstdCompressor(level=9)
        self.given = [zstandard.ZstdCompressor(level=9, dict_data=zstandard.ZstdCompressionDict(t.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for _, t in templates]
        self.weight = [len(self.plain.compress(t.encode())) for _, t in templates]
        self.words = [_words(t) for _, t in templates]
        self.counts = [Counter(w) for w in self.words]
        self.most = [int(MOST_CHANGED * len(w) + 1e-9) for w in self.words]  # changes that still confirm
        self.reach = [len(w) + m for w, m in zip(self.words, self.most)]  # words of the longest statement
        self.ranked = lru_cache(1024)(self.rank)  # a text may hold one stretch many times

    def saved(self, stretch: str, template: int) -> float:
        """The share of its own weight that a template saves."""
        raw = stretch.encode()
        return (len(self.plain.compress(raw)) - len(self.given[template].compress(raw))) / self.weight[template]

    def rank(self, stretch: str) -> list[tuple[float, int]]:
        """Templates by the share of their own weight that they save, best first, ties in the order of the list."""
        raw = stretch.encode()
        alone = len(self.plain.compress(raw))
        saved = [((alone - len(c.compress(raw))) / w, i) for i, (c, w) in enumerate(zip(self.given, self.weight))]
        return sorted(saved, key=lambda x: (-x[0], x[1]))

    def candidates(self, words: list[str], cues: list[int]) -> list[list[tuple[int, int, int]]]:
        """Per template the statements around the cues that its words confirm: (end, start, changes) by end."""
        out = []
        for own, reach, most, counts in zip(self.words, self.reach, self.most, self.counts):
            found, low, high = [], 0, 0
            for n, c in enumerate(cues):
                if not high:
                    low = max(0, c - reach + 1)
                high = min(len(words), c + reach)
                if n + 1 < len(cues) and cues[n + 1] - reach + 1 <= high:
                    continue  # the next cue's stretch goes on from here
                part, high = words[low:high], 0
                there = Counter(part)
                if sum(min(k, there[w]) for w, k in counts.items()) < len(own) - most:
                    continue
                found += [(low + end, low + start, changes) for changes, start, end in _statements(part, own) if changes <= most]
            out.append(found)
        return out

    def first(self, best: list, found: list, cue: int, free: Callable[[int, int], bool], stretch: Callable[[int, int], str]) -> tuple[float, int, int, int, int] | None:
        """(changed, -words, template, start, end) of the statement at a cue, or else near it, whose template saves most.

        The stretch that its statements span is compressed with every template; of those its words confirm, the first in the
        order of what they save is told, in its wording with the fewest changes. Other readings of a template's statement come last.
        """
        for readings, at in ((best, True), (best, False), (found, False)):
            fits = {}
            for i, (some, reach) in enumerate(zip(readings, self.reach)):
                near = some[bisect_left(some, (cue + 1 if at else cue - reach + 2,)) : bisect_left(some, (cue + reach + 1,))]
                ways = [(changes, start, end) for end, start, changes in near if cue - reach < start and (start <= cue or not at) and free(start, end)]
                if ways:
                    fits[i] = min(ways)
            if fits:
                order = self.ranked(stretch(min(x[1] for x in fits.values()), max(x[2] for x in fits.values())))
                i = next(i for _, i in order if i in fits)
                changes, start, end = fits[i]
                return changes / len(self.words[i]), -len(self.words[i]), i, start, end
        return None

    def confirmed(self, words: list[str], cues: list[int], stretch: Callable[[int, int], str]) -> list[tuple[float, int, int, int]]:
        """(changed, template, start, end) of the statements around the cues, in text order, none overlapping another."""
        found = self.candidates(words, cues)
        best = [sorted((end, start, changes) for start, end, changes in _apart((changes, start, end) for end, start, changes in some)) for some in found]
        taken: list[tuple] = []
        free = partial(_free, taken)
        left = cues if any(found) else []
        while left:  # until no cue has a statement that stands clear of those taken
            told = {c: x for c in left if (x := self.first(best, found, c, free, stretch))}
            for changed, _, i, start, end in sorted(set(told.values())):
                if free(start, end):
                    insort(taken, (start, end, changed, i))
            left = list(told)
        return [(changed, i, start, end) for start, end, changed, i in taken]

    def scan(self, text: str) -> list[dict]:
        spans = [(m.start(), m.end()) for m in _WORD.finditer(text)]
        words = [text[a:b].lower() for a, b in spans]
        starts = [a for a, _ in spans]
        cues = sorted({bisect_right(starts, m.start()) - 1 for m in _CUE.finditer(text)})
        out, last = [], -1
        breaks = [-1, *[m.start() for m in re.finditer("\n", text)], len(text)]
        line = lambda place: bisect_left(breaks, place, 1)
        stretch = lambda a, b: text[spans[a][0] : spans[b - 1][1]]
        sure = self.confirmed(words, cues, stretch)
        covered = set()
        for changed, i, a, b in sure:
            first, final = line(spans[a][0]), line(spans[b - 1][0])
            covered.update(range(first, final + 1))
            out.append({"start": breaks[first - 1] + 1, "end": breaks[final], "license": self.templates[i][0], "saved": self.saved(stretch(a, b), i), "changed": changed})
        for c in cues:
            n = line(spans[c][0])
            if n in covered or n == last:
                continue
            last, reach = n, max(self.reach)
            a, b = max(0, c - reach + 1), min(len(words), c + reach)
            saved, i = self.ranked(stretch(a, b))[0]
            a, b = max(0, c - self.reach[i] + 1), min(len(words), c + self.reach[i])
            changed = min(x[0] for x in _statements(words[a:b], self.words[i])) / len(self.words[i])
            out.append({"start": breaks[n - 1] + 1, "end": breaks[n], "license": None, "saved": saved, "changed": changed})
        return sorted(out, key=lambda b: (b["start"], b["end"]))


def scan(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per row of docs: the columns `keep` and blocks, an array of (start, end, license, saved, changed).

    A block is the lines that a statement stands on; several statements on one line are as many blocks. Offsets are in code
    points, the end exclusive; license is null, and the block a line, where a line with a cue has no confirmed statement.
    Of templates confirmed at a cue the one that saves most of its own size stands, then the earlier in the list; of several
    cues' statements that overlap the one with the smaller share of changed words, then the longer template. A null or empty text has no
    blocks, and so has a text without a cue, however long. Repeated rows get equal results, an empty table an empty one, and
    other columns of docs are not read, whatever their names.
    """
    text_batches(docs.sparkSession)
    body = F.coalesce(F.col(text), F.lit(""))
    taken = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.when(body.rlike(CUE), body).otherwise("").alias("t"))
    block = "array<struct<start:long,end:long,license:string,saved:double,changed:double>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("license", pa.string()), ("saved", pa.float64()), ("changed", pa.float64())]))
        for part in columnar.blocks(batches, "t"):
            found = [scanner.scan(t) if t else [] for t in part.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[part.column(i).combine_chunks() for i in range(len(keep))], pa.array(found, kind)], [*[f"k{i}" for i in range(len(keep))], "blocks"])

    kinds = ", ".join(f"k{i} {f.dataType.simpleString()}" for i, f in enumerate(taken.schema.fields[:-1]))
    rows = taken.mapInArrow(run, f"{kinds}, blocks {block}")
    return rows.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "blocks")
