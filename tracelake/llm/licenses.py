"""Operator 9: license notices by MinHash over overlapping windows, verified by exact containment.

Templates are grouped by length. A text's windows for a length n have 1.25 n words and start every
n / 4 words (the last one ends with the text), so any passage of n words lies whole in a window. A
window and a template collide in a band if their least shingle under the band's hash is the same: one
row a band, and ``BANDS`` bands. A window that holds a template has a similarity of 0.5 at least with
it, so the chance to collide is 1 - 0.5^24, over 0.9999999. A collision is verified: the share of the
template's 5-word shingles that the window holds must reach ``CONTAINMENT``; a template of fewer than
``SHORT`` words must be held whole, as one other word there can be the license's name or version. Of
finds that overlap, the best wins: the one with most shingles held, less three for each one missed.

Words are runs of letters and digits in lower case, so wrapping and punctuation don't matter. A text
none of whose shingles is a template's is done with after hashing its shingles: no window of it can
collide.

Rows: null text has no words and no license. Overlapping windows that hold one template are one find,
from the first to the last shingle matched. A repeated row is scanned alike. An empty table gives no
rows. Only id and text are read. Templates are broadcast: a list of at most ``MAX_TEMPLATE_WORDS``.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from itertools import takewhile

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import lowered, map_arrow, strings

SHINGLE = 5
CONTAINMENT = 0.8
SHORT = 20
BANDS = 24
MAX_TEMPLATE_WORDS = 1_000_000

# Notices by which works are put under a license.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "all-rights-reserved": "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher.",
}

_WORD = re.compile(r"[^\W_]+")
_SEEDS = np.random.default_rng(20_25).integers(1, 1 << 63, (2, BANDS), dtype=np.uint64) | np.uint64(1)


def shingles_of(words: list[str]) -> np.ndarray:
    """The hash of each 5-word shingle, in order; fewer words make one."""
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh3_64_intdigest
    parts = [w.encode() for w in words]
    if len(parts) <= SHINGLE:
        return np.array([digest(b" ".join(parts))], np.uint64)
    joined = b" ".join(parts)
    ends = np.cumsum([len(w) + 1 for w in parts]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return np.array([digest(joined[a:b]) for a, b in zip(starts[: len(parts) - SHINGLE + 1].tolist(), ends[SHINGLE - 1 :].tolist(), strict=True)], np.uint64)


def _mixed(h: np.ndarray, band: int) -> np.ndarray:
    x = h * _SEEDS[0, band]
    return (x ^ (x >> np.uint64(31))) * _SEEDS[1, band]


class Index:
    """Templates by length, each length with its bands: least mixed shingle -> templates."""

    def __init__(self, templates: list[tuple[str, str]]):
        words = [_WORD.findall(v.lower()) for _, v in templates]
        self.names = [k for k, _ in templates]
        self.short = [len(w) < SHORT for w in words]
        self.shingles = [np.unique(shingles_of(w)) for w in words]
        self.all = np.unique(np.concatenate([*self.shingles, np.zeros(0, np.uint64)]))
        self.lengths: dict[int, list[dict[int, list[int]]]] = {}
        self.least: dict[int, int] = {}  # shingles of a length's smallest template
        for k, w in enumerate(words):
            if n := len(w):
                bands = self.lengths.setdefault(n, [{} for _ in range(BANDS)])
                self.least[n] = min(self.least.get(n, n), len(self.shingles[k]))
                for b in range(BANDS):
                    bands[b].setdefault(int(_mixed(self.shingles[k], b).min()), []).append(k)

    def find(self, words: list[str], containment: float) -> list[tuple[str, int, int, float]]:
        """(template, first word, last word, containment) of every find."""
        h = shingles_of(words)
        if not len(self.all) or not len(h):
            return []
        known = np.flatnonzero(self.all[np.minimum(np.searchsorted(self.all, h), len(self.all) - 1)] == h)
        if not len(known):
            return []
        out = []
        for n, bands in self.lengths.items():
            # a window with fewer known shingles than a template's share can't hold one
            need = max(1, int(np.ceil((1 if n < SHORT else containment) * self.least[n] - 1e-9)))
            if len(known) < need:
                continue
            size = max(1, -(-5 * n // 4) - SHINGLE + 1)  # shingles of a window
            step = max(1, n // 4)
            last = max(0, len(h) - size)
            starts = np.unique(np.append(np.arange(0, last + 1, step), last))
            inside = np.searchsorted(known, starts + size) - np.searchsorted(known, starts) >= need
            met: dict[tuple[int, int], None] = {}
            for s in starts[inside].tolist():
                part = h[s : s + size]
                for b in range(BANDS):
                    for k in bands[b].get(int(_mixed(part, b).min()), ()):
                        met[k, s] = None
            finds: dict[int, list[list]] = {}
            for k, s in met:
                mask = np.isin(h[s : s + size], self.shingles[k])
                share = len(np.unique(h[s : s + size][mask])) / len(self.shingles[k])
                if share >= (1 if self.short[k] else containment):
                    at = np.flatnonzero(mask)
                    a, z = s + int(at[0]), s + int(at[-1]) + min(SHINGLE, len(words)) - 1
                    spans = finds.setdefault(k, [])
                    if spans and a <= spans[-1][1]:
                        spans[-1] = [min(a, spans[-1][0]), max(z, spans[-1][1]), max(share, spans[-1][2])]
                    else:
                        spans.append([a, z, share])
            out += [(k, *x) for k, spans in finds.items() for x in spans]
        best: list[tuple[int, int, int, float]] = []
        kept: list[tuple[int, int]] = []  # by first word; two of them share less than half of either, so last words ascend too
        for k, a, z, share in sorted(out, key=lambda x: (-len(self.shingles[x[0]]) * (4 * x[3] - 3), self.names[x[0]], x[1])):
            at = bisect_left(kept, (a, z))
            near = [x for x in takewhile(lambda x: x[1] >= a, (kept[i] for i in range(at - 1, -1, -1)))] + [x for x in takewhile(lambda x: x[0] <= z, (kept[i] for i in range(at, len(kept))))]
            if all(2 * (min(z, y) - max(a, x) + 1) < min(z - a, y - x) + 1 for x, y in near):
                best.append((k, a, z, share))
                kept.insert(at, (a, z))
        return sorted(((self.names[k], *x) for k, *x in best), key=lambda x: (x[1], x[2], x[0]))


def scan(docs: DataFrame, templates: dict[str, str] | list[tuple[str, str]] | None = None, containment: float = CONTAINMENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for every license found: the id, ``license``, ``start``, ``end`` (code points) and ``containment``."""
    given = list((TEMPLATES if templates is None else dict(templates)).items()) if not isinstance(templates, list) else templates
    if (n := sum(len(v.split()) for _, v in given)) > MAX_TEMPLATE_WORDS:
        raise ValueError(f"{n} words of templates; {MAX_TEMPLATE_WORDS} at most are broadcast")
    id_type = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(Index(given))

    def run(batch):
        index = shared.value
        out: dict[str, list] = {k: [] for k in (id_col, "license", "start", "end", "containment")}
        for doc, text in zip(batch.column("id").to_pylist(), strings(batch, "text"), strict=True):
            low = lowered(text)
            words = _WORD.findall(low)
            if found := index.find(words, containment):
                spans = [m.span() for m in _WORD.finditer(low)]
                for k, a, z, share in found:
                    for c, v in ((id_col, doc), ("license", k), ("start", spans[a][0]), ("end", spans[z][1]), ("containment", share)):
                        out[c].append(v)
        if out[id_col]:
            yield out

    return map_arrow(docs, {"id": F.col(id_col), "text": F.col(text_col).cast("string")}, f"`{id_col}` {id_type}, license string, start int, end int, containment double", run)
