"""License scans: an exact set-similarity join of text blocks with templates.

A text's blocks are its windows of twice a stride's words, one every stride.
Templates are gathered by length: the stride is ``STRIDE``, or that doubled
until a stride holds the template and as many more words as the threshold lets
it lack.  A template is found in a block when the block holds at least
``THRESHOLD`` of its distinct words, or all of them if they are fewer than
``WHOLE`` - four words of five stand together in many a text.  Words are ordered
by how often they occur in all texts, rarest first (one pass counts the
templates' words); only blocks that hold one of a template's first ``size -
needed + 1`` words can match, so only those are candidates; of them, blocks with
too few of the templates' words, and templates whose first word found stands too
far back to leave enough, are dropped (length and positional filter); the
overlap of the rest is counted exactly.  Templates are a bounded table that
every task gets; nothing else is shuffled or broadcast.

Phrases, found word by word, give labels of their own, with all their places.

Defined results: null and empty text has no words, no labels (empty strings),
score 0 and null places; repeated rows are scanned alike; a long text is scanned
whole, block by block; words equally frequent are ordered by their hash; columns
besides doc_id and text aren't read; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbuf as tb

STRIDE = 32
THRESHOLD = 0.8
WHOLE = 12

#: Grants and notices, whole or in the sentences that files carry.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "mit": (
        "Released under the MIT License",
        "Licensed under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    ),
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Released under the BSD License",
    ),
    "gpl-2.0": ("This work is licensed under the GNU General Public License, version 2",),
    "gpl-3.0": (
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; "
        "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    ),
    "lgpl": ("it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",),
    "agpl-3.0": ("licensed under the GNU Affero General Public License version 3",),
    "mpl-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",),
    "cc-by-4.0": ("licensed under a Creative Commons Attribution 4.0 International License",),
    "cc-by-sa-4.0": ("Licensed under CC BY-SA 4.0", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    "cc-by-nc-4.0": ("Licensed under CC BY-NC 4.0", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    "cc0-1.0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",),
    "isc": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",),
    "unlicense": ("This is free and unencumbered software released into the public domain",),
    "bsd-2-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
        "in the documentation and/or other materials provided with the distribution.",
    ),
    "zlib": (
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, "
        "subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. "
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. "
        "3. This notice may not be removed or altered from any source distribution.",
    ),
    "proprietary": ("No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher",),
}
PHRASES: dict[str, str] = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

_MEMBER = np.zeros(256, bool)
_MEMBER[0x30:0x3A] = _MEMBER[0x41:0x5B] = _MEMBER[0x61:0x7B] = _MEMBER[0x80:] = True


def tokens(buf: np.ndarray, offs: np.ndarray) -> tuple[tb.Words, np.ndarray]:
    w = tb.words(buf, offs, _MEMBER)
    return w, tb.hashes(w, lower=True)


def _hashed(text: str) -> list[int]:
    raw = np.frombuffer(text.encode(), np.uint8)
    return tokens(raw, np.array([0, raw.size]))[1].tolist()


def needed(size: int, threshold: float, whole: int = WHOLE) -> int:
    """How many of a template's ``size`` distinct words a block must hold."""
    return size if size < whole else math.ceil(threshold * size - 1e-9)


def stride(words: int, threshold: float) -> int:
    """The stride for a template of so many words."""
    s = STRIDE
    while s < words / threshold - 1e-9 and s < words + STRIDE:
        s *= 2
    return s


def by_stride(templates: dict[str, tuple[str, ...]], threshold: float) -> dict[int, dict[str, tuple[str, ...]]]:
    out: dict[int, dict[str, tuple[str, ...]]] = {}
    for label, ts in templates.items():
        for t in ts:
            group = out.setdefault(stride(len(_hashed(t)), threshold), {})
            group[label] = (*group.get(label, ()), t)
    return out


class Index:
    """Templates of one stride, and phrases, by word number; words numbered by their hash's order."""

    def __init__(self, templates: dict[str, tuple[str, ...]], phrases: dict[str, str], threshold: float = THRESHOLD, step: int = STRIDE):
        flat = [(label, list(dict.fromkeys(_hashed(t)))) for label, ts in templates.items() for t in ts]
        self.stride = step
        spoken = [(label, _hashed(p)) for p, label in phrases.items()]
        self.words = np.unique(np.array([h for _, hs in [*flat, *spoken] for h in hs], np.uint64))
        number = {h: i for i, h in enumerate(self.words.tolist())}
        self.labels = [label for label, _ in flat]
        self.sets = [[number[h] for h in hs] for _, hs in flat]
        self.phrases = [(label, [number[h] for h in hs]) for label, hs in spoken]
        self.matrix = np.zeros((self.words.size, len(flat)), np.float32)
        for k, s in enumerate(self.sets):
            self.matrix[s, k] = 1
        self.size = np.array([len(s) for s in self.sets])
        self.needed = np.array([needed(len(s), threshold) for s in self.sets])
        self.order(np.zeros(self.words.size))

    def order(self, frequency: np.ndarray) -> None:
        """Order each template's words by frequency and mark its prefix."""
        place = np.empty(self.words.size, np.int64)
        place[np.lexsort((self.words, frequency))] = np.arange(self.words.size)
        self.prefix = np.zeros_like(self.matrix, bool)
        self.position = np.full(self.matrix.shape, 1 << 20)
        for k, s in enumerate(self.sets):
            ranked = sorted(s, key=lambda t: place[t])
            self.position[ranked, k] = np.arange(len(ranked))
            self.prefix[ranked[: len(s) - self.needed[k] + 1], k] = True
        self.starts = self.prefix.any(1)

    def numbers(self, h: np.ndarray) -> np.ndarray:
        if not self.words.size:
            return np.full(h.size, -1)
        at = np.minimum(np.searchsorted(self.words, h), self.words.size - 1)
        return np.where(self.words[at] == h, at, -1)


def find_templates(ix: Index, row: np.ndarray, nth: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, templates and containments of all (block, template) pairs that meet the threshold.

    The arguments tell the template words found: row, place in the row, number.
    """
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    first = ix.starts[word]
    if not first.any():
        return none

    def blocks(r, p):
        later = p // ix.stride
        early = later > 0
        return np.concatenate([r, r[early]]), np.concatenate([later, later[early] - 1]), early

    r, b, _ = blocks(row[first], nth[first])
    width = int(nth.max()) // ix.stride + 2
    wanted = np.unique(r * width + b)
    near = np.isin(row, wanted // width)
    r, b, early = blocks(row[near], nth[near])
    t = np.concatenate([word[near], word[near][early]])
    key = r * width + b
    at = np.minimum(np.searchsorted(wanted, key), wanted.size - 1)
    ok = wanted[at] == key
    pair = np.unique(at[ok] * ix.words.size + t[ok])
    block, t = pair // ix.words.size, pair % ix.words.size
    out = []
    for i in range(0, wanted.size, 8192):  # blocks by the thousand, so that their matrix stays small
        lo, hi = np.searchsorted(block, [i, i + 8192])
        k = block[lo:hi] - i
        m = np.zeros((min(8192, wanted.size - i), ix.words.size), np.float32)
        m[k, t[lo:hi]] = 1
        candidate = (m @ ix.prefix.astype(np.float32)) > 0
        candidate &= m.sum(1)[:, None] >= ix.needed  # length
        where, which = np.nonzero(candidate)
        left = np.where(m[where] > 0, ix.position[:, which].T, 1 << 20).min(1)
        far = ix.size[which] - left >= ix.needed[which]  # position
        where, which = where[far], which[far]
        both = (m[where] * ix.matrix[:, which].T).sum(1)
        good = both >= ix.needed[which]
        out.append((wanted[i + where[good]] // width, which[good], both[good] / ix.size[which[good]]))
    return tuple(np.concatenate([o[j] for o in out]) for j in range(3))


def word_counts(docs: DataFrame, words: np.ndarray) -> np.ndarray:
    """How often each of the templates' words (sorted hashes) occurs in all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(words.size, np.int64)
        for batch in batches:
            buf, offs = tb.buffers(batch.column(0))
            for i, j in tb.slices(offs):
                _, h = tokens(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                at = np.minimum(np.searchsorted(words, h), words.size - 1)
                total += np.bincount(at[words[at] == h], minlength=total.size)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total)], ["word", "n"])

    out = np.zeros(words.size)
    if words.size:
        for r in docs.select("text").mapInArrow(tb.lean(run), "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect():
            out[r.word] = r.n
    return out


def scan(docs: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES, phrases: dict[str, str] = PHRASES, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` of every row; the score is the highest containment found, 1 for a phrase."""
    spoken = Index({}, phrases)
    groups = [Index(ts, {}, threshold, step) for step, ts in sorted(by_stride(templates, threshold).items())]
    every = np.unique(np.concatenate([np.zeros(0, np.uint64), *(ix.words for ix in groups)]))
    often = word_counts(docs, every)
    for ix in groups:
        ix.order(often[np.searchsorted(every, ix.words)])
    shared = docs.sparkSession.sparkContext.broadcast((spoken, groups))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spoken, groups = shared.value
        for batch in batches:
            buf, offs = tb.buffers(batch.column("text"))
            for i, j in tb.slices(offs):
                w, h = tokens(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                n = w.counts()
                begin = np.cumsum(n) - n
                t = spoken.numbers(h)
                base: list[set[str]] = [set() for _ in range(w.rows)]
                places = np.zeros(w.rows, np.int64)
                low, high = np.full(w.rows, 1 << 60), np.full(w.rows, -1)
                for label, p in spoken.phrases:
                    at = np.flatnonzero(t == p[0])
                    at = at[at + len(p) <= t.size]
                    for k in range(1, len(p)):
                        at = at[t[at + k] == p[k]]
                    at = at[w.row[at] == w.row[at + len(p) - 1]]
                    r = w.row[at]
                    places += np.bincount(r, minlength=w.rows)
                    np.minimum.at(low, r, at - begin[r])
                    np.maximum.at(high, r, at - begin[r])
                    for x in np.unique(r):
                        base[x].add(label)
                score = np.where(places > 0, 1.0, 0.0)
                more = [set(b) for b in base]
                for ix in groups:
                    t = ix.numbers(h)
                    hit = np.flatnonzero(t >= 0)
                    if not hit.size:
                        continue
                    r, which, share = find_templates(ix, w.row[hit], hit - begin[w.row[hit]], t[hit])
                    np.maximum.at(score, r, share)
                    for a, b in zip(r.tolist(), which.tolist()):
                        more[a].add(ix.labels[b])
                some = places > 0
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(i, j - i),
                        pa.array(n),
                        pa.array(places),
                        pa.array(low, mask=~some),
                        pa.array(high, mask=~some),
                        pa.array([",".join(sorted(x)) for x in base], pa.string()),
                        pa.array([",".join(sorted(x)) for x in more], pa.string()),
                        pa.array(score),
                    ],
                    ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(tb.lean(run), f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
