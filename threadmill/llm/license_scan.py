"""License scans by conditional compression.

Templates are the notices of each license, its paragraphs and, where it is short enough to be pasted,
its full text. A wording states a license if it has COVERED of the template's words in order, with at
most EXTRA more between them.

(1) Candidate blocks: whatever edits that bound allows, enough pairs of neighbouring words of the
template are left in the text, within the longest a wording can be (see Template.pairs). So the pairs of
all words are looked up in those of all templates, and the surroundings of places with enough of them
are the blocks in question; nothing else can be a wording. (2) The words of the block are aligned with
the template's. (3) What is aligned is compressed alone and with the template as raw zstandard
dictionary. (4) Wordings that overlap are ranked by the bytes saved; of those that save about as much as
the best, the one whose exact differences in wording are fewest wins. It is taken out, and the rest is
ranked again, so that a text gives all its licenses.
"""

from __future__ import annotations

import difflib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame

from . import license_texts as full
from .common import GOLD, U64, buffer_of, fmix, only, slices, word_hashes, word_spans

#: License id -> wordings: the usual notices and the texts people paste.
TEMPLATES: dict[str, list[str]] = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "SPDX-License-Identifier: MIT",
        full.MIT,
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "MIT License",
        "License: MIT",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
        full.APACHE_2,
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "SPDX-License-Identifier: GPL-3.0-only",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "SPDX-License-Identifier: GPL-2.0-only",
        "SPDX-License-Identifier: GPL-2.0-or-later",
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0-or-later", "SPDX-License-Identifier: LGPL-3.0-only", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-only", "SPDX-License-Identifier: AGPL-3.0-or-later", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0", "Mozilla Public License Version 2.0", full.MPL_2],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-2-Clause", full.BSD_2],
    "BSD-3-Clause": [
        "Licensed under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
        full.BSD_3,
    ],
    "ISC": ["Licensed under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "SPDX-License-Identifier: ISC", full.ISC],
    "Zlib": [full.ZLIB, "SPDX-License-Identifier: Zlib", "Licensed under the zlib License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
    "CC-BY-NC-SA-4.0": ["Licensed under CC BY-NC-SA 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."],
    "CC-BY-NC-ND-4.0": ["Licensed under CC BY-NC-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."],
    "CC0-1.0": ["Released under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "SPDX-License-Identifier: CC0-1.0", full.CC0_1],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense", full.UNLICENSE],
    "All-Rights-Reserved": ["Copyright. All rights reserved.", "All rights reserved."],
}
COVERED = 0.85  # share of the template's words that a wording has in order
EXTRA = 0.5  # words in between that the template hasn't, as a share of its words
NOTICE = 60  # words; all numbers of a template no longer than that (versions, years) must be there
NEAR = 0.9  # wordings that save this share of the best one's bytes are told apart by their differences
SCHEMA = "doc_id bigint, block_no int, license string, template_no int, bytes_alone int, bytes_given int, coverage double, missing array<string>, extra array<string>"
Key = tuple[tuple[str, int, str], ...]
_plain = None


def flat(templates: dict[str, list[str]]) -> Key:
    return tuple((name, no, text) for name in sorted(templates) for no, text in enumerate(templates[name]))


def words_of(text: str) -> tuple[list[str], list[int]]:
    """The words of a text, lower case, and their hashes."""
    array = pc.utf8_lower(pa.array([text], pa.large_string()))
    data, off = buffer_of(array)
    start, end, _ = word_spans(data, off)
    raw = data.tobytes()
    return [raw[a:b].decode("utf-8", "replace") for a, b in zip(start, end, strict=True)], word_hashes(array)[0].tolist()


def pairs_of(h: np.ndarray) -> np.ndarray:
    """A hash of every two neighbouring words."""
    return fmix(h[:-1] * GOLD + h[1:])


@dataclass
class Template:
    name: str
    no: int
    words: list[str]
    hashes: list[int]
    numbers: set[int]  # places of words that must be there
    given: zstandard.ZstdCompressor

    @classmethod
    def of(cls, name: str, no: int, text: str) -> Template:
        words, hashes = words_of(text)
        if len(words) < 2:
            raise ValueError(f"a template has two words or more: {text}")
        raw = zstandard.ZstdCompressionDict((" " * 8 + " ".join(words)).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        given = zstandard.ZstdCompressor(level=3, dict_data=raw, write_content_size=False, write_checksum=False, write_dict_id=False)
        numbers = {i for i, w in enumerate(words) if w.isdigit()} if len(words) <= NOTICE else set()
        return cls(name, no, words, hashes, numbers, given)

    @property
    def least(self) -> int:
        """Words that a wording has of the template's."""
        return math.ceil(COVERED * len(self.words) - 1e-9)

    @property
    def most(self) -> int:
        """Words that it has besides, between them; none in a template of two words."""
        return int(EXTRA * len(self.words)) if len(self.words) > 2 else 0

    @property
    def pairs(self) -> int:
        """The least number of neighbours that a wording shares with the template: of n - 1, a missing
        word takes two and a word between takes one. At least one is left (tested for all templates)."""
        n = len(self.words)
        return max(1, n - 1 - 2 * (n - self.least) - self.most)

    @property
    def span(self) -> int:
        """The most words from the first to the last of a wording."""
        return len(self.words) + self.most


class Index:
    """The pairs of neighbouring words of all templates."""

    def __init__(self, key: Key) -> None:
        self.templates = [Template.of(*x) for x in key]
        own = [np.unique(pairs_of(np.array(t.hashes, dtype=U64))) for t in self.templates]
        pair, which = np.concatenate(own), np.repeat(np.arange(len(own)), [len(x) for x in own])
        order = np.argsort(pair, kind="stable")
        self.pair, first = np.unique(pair[order], return_index=True)
        self.which, self.first = which[order], np.append(first, len(pair))
        self.seen = np.zeros(1 << 20, bool)
        self.seen[self.pair >> U64(44)] = True

    def blocks(self, words: np.ndarray, woff: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(document, template, first word, last word + 1) of all blocks in question, ordered; words count
        over all documents. Blocks of a template go on from where a wording that starts in the one
        before must have been seen there."""
        if len(words) < 2:
            return []
        h = pairs_of(words)
        at = np.flatnonzero(self.seen[h >> U64(44)])
        place = np.minimum(np.searchsorted(self.pair, h[at]), len(self.pair) - 1)
        ok = self.pair[place] == h[at]
        at, place = at[ok], place[ok]
        doc = np.searchsorted(woff, at, "right") - 1
        ok = at + 1 < woff[doc + 1]  # neighbours in one document
        at, place, doc = at[ok], place[ok], doc[ok]
        n = self.first[place + 1] - self.first[place]
        rows = np.repeat(np.arange(len(at)), n)
        t = self.which[np.repeat(self.first[place], n) + np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)]
        order = np.lexsort((at[rows], t))
        t, rows = t[order], rows[order]
        out = []
        cuts = np.searchsorted(t, np.arange(len(self.templates) + 1))
        for i, x in enumerate(self.templates):
            own = rows[cuts[i] : cuts[i + 1]]
            r = x.pairs - 1
            if len(own) <= r:
                continue
            p, d = at[own], doc[own]
            good = np.flatnonzero((p[r:] - p[: len(p) - r] <= x.span - 2) & (d[r:] == d[: len(d) - r]))
            until = -1
            for j in good.tolist():
                if p[j] > until:
                    a, b = int(woff[d[j]]), int(woff[d[j] + 1])
                    out.append((int(d[j]), i, max(a, int(p[j]) - x.span), min(b, int(p[j]) + 2 * x.span + 2)))
                    until = int(p[j]) + x.span
        return sorted(out)


@lru_cache(maxsize=4)
def index_of(key: Key) -> Index:
    return Index(key)


def _aligned(a: list[int], b: list[int]) -> tuple[list[tuple[int, int, int]], int, int]:
    """The run of matching stretches (place in a, place in b, length) that has the most common words less
    words of b in between; the numbers of both."""
    stretches = [m for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() if m.size]
    best, run, start, total = (0, 0, 0), 0, 0, 0
    for i, m in enumerate(stretches):
        gap = m.b - stretches[i - 1].b - stretches[i - 1].size if i else 0
        if i == 0 or total - gap <= 0:
            start, total = i, m.size
        else:
            total += m.size - gap
        if total > best[0]:
            best = (total, start, i + 1)
    run = [tuple(m) for m in stretches[best[1] : best[2]]]
    common = sum(m[2] for m in run)
    return run, common, (run[-1][1] + run[-1][2] - run[0][1] - common) if run else 0


@dataclass
class Finding:
    template: Template
    first: int  # words of the wording
    end: int
    alone: int = 0
    given: int = 0
    coverage: float = 0.0
    missing: tuple[str, ...] = ()
    extra: tuple[str, ...] = ()

    @property
    def saved(self) -> int:
        return self.alone - self.given

    @property
    def order(self) -> tuple:
        return (len(self.missing) + len(self.extra), -self.saved, self.template.name, self.template.no, self.first)


def confirm(template: Template, hashes: list[int], words: list[str], first: int) -> Finding | None:
    """The wording of the template in a block that begins with word `first`, if its differences are few
    and the template saves bytes."""
    global _plain
    run, common, between = _aligned(template.hashes, hashes)
    if common < template.least or between > template.most:
        return None
    got = {i for a, _, n in run for i in range(a, a + n)}
    if template.numbers - got:
        return None
    lo, hi = run[0][1], run[-1][1] + run[-1][2]
    there = {i for _, b, n in run for i in range(b, b + n)}
    if _plain is None:
        _plain = zstandard.ZstdCompressor(level=3, write_content_size=False, write_checksum=False)
    raw = " ".join(words[lo:hi]).encode()
    alone, given = len(_plain.compress(raw)), len(template.given.compress(raw))
    if given >= alone:
        return None
    missing = tuple(w for i, w in enumerate(template.words) if i not in got)
    return Finding(template, first + lo, first + hi, alone, given, common / len(template.words), missing, tuple(words[i] for i in range(lo, hi) if i not in there))


def winners(found: list[Finding]) -> list[Finding]:
    """Wordings that don't overlap: the best is taken, what overlaps it goes, and so on."""
    out: list[Finding] = []
    rest: list[Finding] = []
    until = -1
    for f in [*sorted(found, key=lambda f: (f.first, f.end)), None]:  # wordings that hang together are ranked together
        if f is None or f.first >= until:
            left, rest = sorted(rest, key=lambda f: (-f.saved, *f.order)), []
            while left:
                top = left[0]
                best = min((f for f in left if f.first < top.end and top.first < f.end and f.saved >= NEAR * top.saved), key=lambda f: f.order)
                out.append(best)
                left = [f for f in left if not (f.first < best.end and best.first < f.end)]
        if f is not None:
            rest.append(f)
            until = max(until, f.end)
    return sorted(out, key=lambda f: f.first)


_BLANK = re.compile(rb"\n[ \t\r\f\v]*\n\s*")


def _block_numbers(raw: bytes, places: list[int]) -> list[int]:
    """The number of the block of each place: blocks are divided by blank lines."""
    lead = len(raw) - len(raw.lstrip())
    starts = [m.end() for m in _BLANK.finditer(raw) if m.start() >= lead and m.end() < len(raw)]
    return np.searchsorted(np.array(starts, dtype=np.int64), np.array(places), "right").tolist()


def scan_texts(texts: pa.Array, key: Key) -> list[tuple[int, int, Finding]]:
    """(row, block number, finding), ordered by row and place; one finding of a license in a block."""
    index = index_of(key)
    lower = pc.fill_null(pc.utf8_lower(texts.cast(pa.large_string())), "")
    words, woff = word_hashes(lower)
    blocks = index.blocks(words, woff)
    if not blocks:
        return []
    data, off = buffer_of(lower)
    start, end, _ = word_spans(data, off)
    out, at = [], 0
    while at < len(blocks):
        doc, found = blocks[at][0], {}
        base, own = int(woff[doc]), {}
        raw = data[off[doc] : off[doc + 1]].tobytes()
        while at < len(blocks) and blocks[at][0] == doc:
            _, t, a, b = blocks[at]
            todo = [(a, b)]
            while todo:  # a block may hold several wordings of the template
                a, b = todo.pop()
                if b - a < index.templates[t].least:
                    continue
                shown = [own.setdefault(i, raw[start[i] - off[doc] : end[i] - off[doc]].decode("utf-8", "replace")) for i in range(a, b)]
                f = confirm(index.templates[t], words[a:b].tolist(), shown, a - base)
                if f:
                    found[t, f.first, f.end] = f
                    todo += [(a, base + f.first), (base + f.end, b)]
            at += 1
        taken = winners(list(found.values()))
        numbers = _block_numbers(raw, [int(start[base + f.first] - off[doc]) for f in taken])
        best: dict[tuple[int, str], Finding] = {}
        for no, f in zip(numbers, taken, strict=True):
            cell = (no, f.template.name)
            if cell not in best or (-f.saved, *f.order) < (-best[cell].saved, *best[cell].order):
                best[cell] = f
        out += [(doc, no, best[no, name]) for no, name in sorted(best)]
    return out


def scan_text(text: str, key: Key) -> list[tuple[int, Finding]]:
    return [(no, f) for _, no, f in scan_texts(pa.array([text], pa.large_string()), key)]


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """A row for each license that a block of a document states: the template, the compressed size of its
    wording alone and given the template, and the exact differences in wording. Blocks are divided by
    blank lines and count from 0 over the others; a wording may go on through several and belongs to
    the one in which it begins.

    Null and empty texts, and texts without license wording, give no rows. Of equal findings of a license
    in a block the first counts. A null doc_id stays; repeated rows give repeated rows; an empty table,
    or no templates, gives no rows. Other columns are ignored, whatever their names. A text is never
    cut: one of n bytes takes about 100 n bytes of memory in its task.
    """
    docs = only(docs, "doc_id", "text")
    key = flat(TEMPLATES if templates is None else templates)
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.string())]
    shared = docs.sparkSession.sparkContext.broadcast(key)  # the templates, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = scan_texts(part.column("text"), shared.value) if shared.value else []
                if found:
                    ids = part.column("doc_id").to_pylist()
                    rows = [(ids[i], no, f.template.name, f.template.no, f.alone, f.given, f.coverage, list(f.missing), list(f.extra)) for i, no, f in found]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return docs.mapInArrow(run, SCHEMA)
