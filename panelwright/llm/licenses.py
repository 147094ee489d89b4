"""License scans with MinHash bands over overlapping text windows.

Templates and windows of like length are compared by MinHash over five-word
shingles. The windows of a size class hold twice as many shingles as its
longest template and begin every half window, so wherever a template stands,
one window holds all of it. Bands that agree in one row retrieve templates;
their number is set so that a window with enough of a template collides with
it with the wanted probability. What is retrieved is verified by the exact
share of the template's shingles in the window.

One row a band: a hash of 64 bits agrees by chance next to never, so more rows
would lose recall and spare nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import mix, text_blocks, word_hashes, word_spans

SHINGLE_WORDS = 5
CONTAINMENT = 0.8
#: Probability of retrieval of a window that holds CONTAINMENT of a template.
RECALL = 0.999

# Names and public wordings of licenses and license notices.
TEMPLATES = {
    "Apache-2.0 line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "MIT line": "Released under the MIT License.",
    "MIT line 2": "Licensed under the MIT License.",
    "MIT grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MIT disclaimer": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "BSD grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "ISC grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "GPL-3.0 line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "MPL-2.0 notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "CC-BY-NC-4.0 line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0 line": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0 line": "Licensed under CC BY-SA 4.0.",
    "CC-BY-4.0 notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "All rights reserved": "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher.",
}

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 32  # punctuation separates words


def shingles(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the five-word shingles of all texts in order, the first of each text, and the words' first of each.

    ASCII letters lose their case, ASCII punctuation is white space. A text of
    fewer words has one shingle, one without words none.
    """
    fold = _FOLD[raw]
    starts, ends, first = word_spans(fold, offsets)
    words = word_hashes(fold, starts, ends)
    n_words = np.diff(first)
    count = np.where(n_words >= SHINGLE_WORDS, n_words - SHINGLE_WORDS + 1, np.minimum(n_words, 1))
    run = np.concatenate(([0], np.cumsum(count)))
    at = np.repeat(first[:-1] - run[:-1], count) + np.arange(run[-1])
    width = np.repeat(np.minimum(n_words, SHINGLE_WORDS), count)
    out = np.zeros(len(at), dtype=np.uint64)
    for k in range(SHINGLE_WORDS):
        more = width > k
        out[more] = mix(out[more] * np.uint64(3) + words[at[more] + k])
    return out, run, first


def bands(size: int, window: int, containment: float = CONTAINMENT, recall: float = RECALL) -> int:
    """Bands of one row that retrieve a template of ``size`` shingles from a window of ``window`` with the recall.

    A window that holds the share c of the template resembles it by at least
    c * size / (window + (1 - c) * size); that is the chance that a row agrees.
    """
    alike = containment * size / (window + (1 - containment) * size)
    return ceil(log(1 - recall) / log(1 - alike))


class Scanner:
    """Templates by size class, their band keys, and exact shingle sets."""

    def __init__(self, templates: dict[str, str], containment: float = CONTAINMENT, recall: float = RECALL):
        self.containment = containment
        self.names = sorted(templates)
        texts = [templates[n].encode() for n in self.names]
        offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
        hashes, run, _ = shingles(np.frombuffer(b"".join(texts), np.uint8), offsets)
        self.sets = [np.unique(hashes[a:b]) for a, b in zip(run, run[1:])]
        # Class 2^k: templates of 2^(k-1) + 1 .. 2^k shingles.
        self.classes: dict[int, list[int]] = {}
        for t, (a, b) in enumerate(zip(run, run[1:])):
            if b > a:
                self.classes.setdefault(1 << max(0, int(b - a - 1).bit_length()), []).append(t)
        self.count = {c: max(bands(max(1, c // 2 + 1), 2 * c, containment, recall) if c > 1 else bands(1, 2, containment, recall), 1) for c in self.classes}
        self.keys: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for c, own in self.classes.items():
            rows = [(self.row(self.sets[t], k).min(), t) for k in range(self.count[c]) for t in own]
            key = np.array([r[0] for r in rows], dtype=np.uint64)
            order = np.argsort(key, kind="stable")
            self.keys[c] = key[order], np.array([r[1] for r in rows])[order]

    @staticmethod
    def row(hashes: np.ndarray, k: int) -> np.ndarray:
        """The k-th hash function on shingle hashes; the row number is part of the value, so rows do not mix."""
        return (hashes ^ np.uint64((k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xD6E8FEB86659FD93)

    def block(self, hashes: np.ndarray, run: np.ndarray) -> list[tuple[int, int, int, float]]:
        """(text, template, first shingle, containment) of the best window of each pair."""
        best: dict[tuple[int, int], tuple[float, int]] = {}
        if not len(hashes):
            return []
        text_of = np.repeat(np.arange(len(run) - 1), np.diff(run))
        steps = {c: self._steps(run, c) for c in self.classes}
        found: dict[int, set] = {c: set() for c in self.classes}
        for k in range(max(self.count.values())):
            row = self.row(hashes, k)
            for c, (cut, end) in steps.items():
                if k >= self.count[c]:
                    continue
                low = np.minimum.reduceat(row, cut)
                joined = low.copy()  # a window is a step and the one after it in the same text
                follows = end[:-1] == cut[1:]
                same = text_of[cut[:-1]] == text_of[cut[1:]]
                joined[:-1] = np.where(follows & same, np.minimum(low[:-1], low[1:]), low[:-1])
                keys, owner = self.keys[c]
                at = np.searchsorted(keys, joined)
                hit = np.flatnonzero(keys[np.minimum(at, len(keys) - 1)] == joined)
                for w in hit.tolist():
                    j = int(at[w])
                    while j < len(keys) and keys[j] == joined[w]:
                        found[c].add((w, int(owner[j])))
                        j += 1
        for c, pairs in found.items():
            cut, _ = steps[c]
            for w, t in sorted(pairs):
                a = int(cut[w])
                d = int(text_of[a])
                b = min(a + 2 * c, int(run[d + 1]))
                inside = np.isin(self.sets[t], hashes[a:b])
                share = float(inside.mean())
                if share >= self.containment:
                    first = a - int(run[d]) + int(np.flatnonzero(np.isin(hashes[a:b], self.sets[t]))[0])
                    old = best.get((d, t))
                    if old is None or (share, -first) > (old[0], -old[1]):
                        best[d, t] = (share, first)
        return [(d, t, first, share) for (d, t), (share, first) in sorted(best.items())]

    @staticmethod
    def _steps(run: np.ndarray, c: int) -> tuple[np.ndarray, np.ndarray]:
        """Begins and ends of the steps of c shingles that every text is cut into."""
        size = np.diff(run)
        n = -(-size // c)
        first = np.repeat(np.cumsum(n) - n, n)
        cut = np.repeat(run[:-1], n) + (np.arange(int(n.sum())) - first) * c
        return cut, np.minimum(cut + c, np.repeat(run[1:], n))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text",
         containment: float = CONTAINMENT, recall: float = RECALL) -> DataFrame:
    """(id, template, containment, first_shingle): templates that a window of the whole text holds, best window each.

    Containment is the share of the template's distinct shingles in the window;
    ties take the earliest. Null and empty texts hold none; repeated rows give
    repeated results; templates without words are ignored. The templates are a
    fixed list that every task carries.
    """
    templates = TEMPLATES if templates is None else templates
    shared = docs.sparkSession.sparkContext.broadcast(templates)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(shared.value, containment, recall)
        for part, raw, offsets in text_blocks(batches, "t"):
            hashes, run, _ = shingles(raw, offsets)
            rows = scanner.block(hashes, run) if scanner.classes else []
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0).take(pa.array([r[0] for r in rows], pa.int64())), pa.array([scanner.names[r[1]] for r in rows], pa.string()),
                    pa.array([r[3] for r in rows], pa.float64()), pa.array([r[2] for r in rows], pa.int64()),
                ],
                names=["id", "template", "containment", "first_shingle"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    return rows.mapInArrow(task, f"id {kind}, template string, containment double, first_shingle long").withColumnRenamed("id", id_col)
