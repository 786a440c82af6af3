"""Operator 2: licence notices, by MinHash bands over text windows.

Texts and templates are words (runs of letters, digits and non-ASCII bytes, case
folded), and shingles are pairs of neighbouring words. A window of shingles has
``ROWS * BANDS`` least hashes; where a band of them equals that of a template's
window, the template is a candidate there. A pair of windows of Jaccard
similarity J meets with probability 1 - (1 - J^ROWS)^BANDS: 1 for a verbatim
copy, at least 0.99 from 0.75 on. A candidate is then verified: the share of
the template's distinct shingles within the surrounding text (its containment)
must reach ``CONTAINMENT``.

A short template is one window, met by windows at every word. A long one has
windows of ``WINDOW`` shingles at each of its words, so those of a text may
stand ``STRIDE`` apart and a verbatim passage still holds one that is equal. A
text shorter than a window is a window of its own.

How it scales. One map over the scan; the templates' tables are sent with the
task. A list of more than ``GROUP_WORDS`` words is dealt in groups, each a map of
its own, so that what is sent is bounded. Nothing is shuffled.

Results that hold by definition:

* null and empty texts, and those of one word, match nothing; rows with a null id
  are scanned; very long texts are read whole;
* one result per row of the documents and template: its best containment, and
  the first place that has it, as a word number; repeated rows give repeated
  results;
* a template without two words is an error; equal templates each match;
* other columns are never read; an empty table gives an empty table.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textscan
from .common import OWN, col, table

#: Notices in common use. Their wording is that of the licences' own instructions and of customary one-line notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-notice": (
        'you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 '
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, '
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
    ),
    "MIT": "Released under the MIT License",
    "MIT-permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the "
        "Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
        "Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the "
        "Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
        "and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be "
        "included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT "
        "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
        "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
        "DEALINGS IN THE SOFTWARE."
    ),
    "BSD-3-Clause-text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source "
        "code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright "
        "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the "
        "copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES "
        "OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."
    ),
    "ISC-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this "
        "permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED "
        "WARRANTIES OF MERCHANTABILITY AND FITNESS."
    ),
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
}
CONTAINMENT = 0.8
ROWS, BANDS = 2, 6
#: Shingles of a long template's windows, and how far those of a text stand apart.
WINDOW, STRIDE = 32, 8
#: Words of the templates that are scanned for together, about.
GROUP_WORDS = 200_000

_WORD = np.full(256, 32, np.uint8)
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _WORD[_a:_b] = np.arange(_a, _b)
_MULTIPLIERS = textscan.mix(np.arange(ROWS * BANDS, dtype=np.uint64), 77) | np.uint64(1)


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingle at each word, whether it lies in one text, first word of each text and the end)."""
    words = textscan.scan(_WORD[data], offsets)
    pair, whole = textscan.grams(words, 2)
    return pair, whole, words.first


def _text_shingles(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    pair, whole, _ = shingles(raw, np.array([0, len(raw)]))
    return pair[whole]


def _band_keys(least: list[np.ndarray]) -> list[np.ndarray]:
    keys = []
    for b in range(BANDS):
        key = least[b * ROWS].astype(np.uint64)
        for h in least[b * ROWS + 1 : (b + 1) * ROWS]:
            key = key * np.uint64(0x9E3779B97F4A7C15) + h
        keys.append((key * np.uint64(0xD6E8FEB86659FD93)) ^ np.uint64(b))
    return keys


def _hashes(pair: np.ndarray) -> list[np.ndarray]:
    return [((pair * m) >> np.uint64(32)).astype(np.uint32) for m in _MULTIPLIERS]


class Templates:
    """Band tables of the templates, by window size."""

    def __init__(self, templates: dict[str, str]):
        self.names = list(templates)
        self.sets = [_text_shingles(t) for t in templates.values()]
        for name, s in zip(self.names, self.sets, strict=True):
            if not len(s):
                raise ValueError(f"template {name} has fewer than two words")
        self.lengths = np.array([len(s) for s in self.sets])
        self.distinct = [np.unique(s) for s in self.sets]
        self.classes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for w in sorted({min(n, WINDOW) for n in self.lengths.tolist()}):
            keys, owner = [], []
            for t, s in enumerate(self.sets):
                if min(len(s), WINDOW) == w:
                    for key in _band_keys([textscan.window_min(h, w) for h in _hashes(s)]):
                        keys.append(key)
                        owner.append(np.full(len(key), t))
            key, who = np.concatenate(keys), np.concatenate(owner)
            order = np.argsort(key, kind="stable")
            key, who = key[order], who[order]
            seen = np.zeros(1 << 16, bool)
            seen[(key >> np.uint64(48)).astype(np.int64)] = True
            self.classes[w] = key, who, seen

    def candidates(self, pair: np.ndarray, whole: np.ndarray, first: np.ndarray):
        """(shingle where a window begins, template), each once."""
        n, hashes = len(pair), _hashes(pair)
        sizes = np.diff(first)
        # from each shingle, how many of its text follow
        left = np.repeat(first[1:], sizes) - np.arange(n) - 1
        some = sizes > 1
        begin, count = first[:-1][some], sizes[some] - 1  # shingles of each text; at its last word there is none
        least = []
        if len(begin):
            edges = np.stack([begin, begin + count], axis=1).reshape(-1)
            edges = edges[:-1] if edges[-1] >= n else edges
            least = [np.minimum.reduceat(h, edges)[::2] for h in hashes]
        found = []

        def look(keys, at, key, who, seen):
            for band in keys:
                maybe = np.flatnonzero(seen[(band >> np.uint64(48)).astype(np.int64)])
                if len(maybe):
                    lo, hi = np.searchsorted(key, band[maybe], "left"), np.searchsorted(key, band[maybe], "right")
                    hit = np.repeat(maybe, hi - lo)
                    owner = who[textscan.flat(lo, hi - lo)]
                    found.append(np.stack([at[hit], owner]))

        for w, table_ in self.classes.items():
            short = np.flatnonzero(count < w)
            if len(short):
                look(_band_keys([h[short] for h in least]), begin[short], *table_)
            if n < w:
                continue
            fits = left[: n - w + 1] >= w
            if w == WINDOW:
                inside = np.arange(n) - np.repeat(first[:-1], sizes)
                # a text's last window counts too, wherever it begins
                fits &= (inside[: n - w + 1] % STRIDE == 0) | (left[: n - w + 1] == w)
            at = np.flatnonzero(fits)
            if len(at):
                look(_band_keys([textscan.window_min(h, w)[at] for h in hashes]), at, *table_)
        if not found:
            return np.zeros((2, 0), np.int64)
        return np.unique(np.concatenate(found, axis=1), axis=1)

    def matches(self, data: np.ndarray, offsets: np.ndarray, containment: float):
        """(text, template, containment, word) of the best match of each template in each text."""
        pair, whole, first = shingles(data, offsets)
        best: dict[tuple[int, int], tuple[float, int]] = {}
        at, who = self.candidates(pair, whole, first)
        texts = np.searchsorted(first, at, side="right") - 1
        for p, t, d in zip(at.tolist(), who.tolist(), texts.tolist(), strict=True):
            n = int(self.lengths[t])
            a, b = max(int(first[d]), p - n), min(int(first[d + 1]) - 1, p + 2 * n)
            share = float(np.isin(self.distinct[t], pair[a:b]).mean())
            if share >= containment:
                where = p - int(first[d])
                have = best.get((d, t))
                if have is None or (-share, where) < (-have[0], have[1]):
                    best[d, t] = share, where
        return [(d, t, share, where) for (d, t), (share, where) in sorted(best.items())]


def _scan(templates: dict[str, str], containment: float):
    def run(batches):
        own = Templates(templates)
        for batch in batches:
            data, offsets = textscan.buffer(batch.column(1))
            for a, b in textscan.slices(offsets):
                found = own.matches(data, offsets[a : b + 1], containment)
                if found:
                    d, t, share, where = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(np.array(d) + a)), pa.array([own.names[x] for x in t]), pa.array(share), pa.array(np.array(where, np.int32))],
                        ["doc_id", "license", "containment", "word_at"],
                    )

    return run


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, license, containment, word_at) for each notice found in each row."""
    given = docs.select(col(id_col).cast("bigint").alias(f"{OWN}id"), col(text_col).cast("string").alias(f"{OWN}text")).where(f"{OWN}text is not null")
    groups, words = [{}], 0
    for name, text in (templates or TEMPLATES).items():
        words += len(text.split())
        if words > GROUP_WORDS and groups[-1]:
            groups, words = [*groups, {}], len(text.split())
        groups[-1][name] = text
    found = [given.mapInArrow(_scan(g, containment), "doc_id bigint, license string, containment double, word_at int") for g in groups]
    return reduce(DataFrame.unionByName, found)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
