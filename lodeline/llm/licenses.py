"""License scans: winnowed fingerprints pick candidates, banded alignment measures them.

Every template's shingles of ``k`` words are hashed and winnowed (the smallest hash of each window of ``w`` shingles),
and an inverted index leads from a fingerprint to its templates and places. Of a template of at most ``SHORT`` words all
shingles are kept, of so few words that one is left whatever edits the similarity allows. All shingles of a document are
looked up, so any shingle shared at a template's fingerprint makes a candidate: template, and where in the document it would start.
Candidates of one template whose starts lie within the band are one region, which a banded local alignment of words
(+2 match, -1 mismatch or gap) compares with the template; what lies before and after the best match is aligned again,
until nothing is left that reaches the similarity. Reported is what reaches the similarity: the share of the
template's words matched (coverage), the same against the longer of template and span (similarity), and the span.

Templates are a stated query set. A task holds the index of ``MAX_TEMPLATES`` of them at once; where there are more, it
takes one such part after the other over the documents that it holds, ``hold_bytes`` of them at a time.

Defined cases: null and empty texts match nothing; a template of at most k words is found only with all its words,
others between them as the similarity allows; templates without words match nothing; repeated rows are each reported; a
match inside a longer match of another template is left out; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeline.llm.common import ship, slices, texts_of
from lodeline.llm.words import ALNUM, Words, split

#: Templates that one index holds.
MAX_TEMPLATES = 10_000
#: Templates of at most so many words are looked up by all their shingles.
SHORT = 16
_MIX = np.uint64(0xD6E8FEB86659FD93)

#: Public notices as they are written.
TEMPLATES = {
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "MIT-line": "Released under the MIT License.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "Apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 '
    'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
    "See the License for the specific language governing permissions and limitations under the License.",
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
    "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
}


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on."""
    n = max(0, len(hashes) - k + 1)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * _MIX + hashes[j : j + n]
    return out ^ (out >> np.uint64(31))


def winnow(hashes: np.ndarray, w: int) -> list[int]:
    """Places of the smallest hash of each window of w, the last one where several are equal."""
    if len(hashes) <= w:
        return [int(len(hashes) - 1 - np.argmin(hashes[::-1]))] if len(hashes) else []
    return sorted({i + w - 1 - int(np.argmin(hashes[i : i + w][::-1])) for i in range(len(hashes) - w + 1)})


def surviving(n: int, least: int, similarity: float) -> int:
    """Words of the longest run that is left in every match of a template of n words, at the worst.

    A match of m words lacks n - m of the template's and holds m / similarity - m others at most; each splits a run.
    """
    return min((-(-m // (1 + n - m + int(m / similarity + 1e-9) - m)) for m in range(least, n + 1)), default=0) if n else 0


def align(template: list[bytes], words: list[bytes], shift: int, band: int) -> tuple[int, int, int, int]:
    """(score, matches, first, end) of the best local alignment near the diagonal word = template + shift.

    Of equal scores the one that ends first in the template, then in the words, counts.
    """
    size, n = 2 * band + 1, len(words)
    zero = (0, 0, -1)
    above = [zero] * size
    best = (0, 0, 0, 0)
    for i, t in enumerate(template):
        row = [zero] * size
        for d in range(size):
            j = i + shift + d - band
            if not 0 <= j < n:
                continue
            s, m, first = above[d]
            cell = (s + 2, m + 1, first if s else j) if words[j] == t else (s - 1, m, first)
            if d + 1 < size and above[d + 1][0] - 1 > cell[0]:
                cell = (above[d + 1][0] - 1, *above[d + 1][1:])
            if d and row[d - 1][0] - 1 > cell[0]:
                cell = (row[d - 1][0] - 1, *row[d - 1][1:])
            if cell[0] > 0:
                row[d] = cell
                if cell[0] > best[0]:
                    best = (cell[0], cell[1], cell[2], j + 1)
        above = row
    return best


class Index:
    """Inverted index from fingerprints to (template, place)."""

    def __init__(self, templates: dict[str, str], k: int = 5, w: int = 4, band: int = 8, similarity: float = 0.8):
        self.k, self.band, self.similarity = k, band, similarity
        self.names = list(templates)
        words = split([templates[n].encode() for n in self.names], ALNUM)
        self.words = [[_word(words, i) for i in range(words.docs[t], words.docs[t + 1])] for t in range(len(self.names))]
        places: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
        for t, own in enumerate(self.words):
            hashes = words.hashes[words.docs[t] : words.docs[t + 1]]
            size = surviving(len(own), self._least(len(own)), similarity) if len(own) <= SHORT else k
            if size:
                found = shingles(hashes, size)
                for at in range(len(found)) if len(own) <= SHORT else winnow(found, w):
                    places[size, int(found[at])].append((t, at))
        self.sizes = sorted({s for s, _ in places})
        self.places = dict(places)
        self.known = {s: np.array(sorted(h for q, h in places if q == s), np.uint64) for s in self.sizes}

    def _least(self, n: int) -> int:
        """Words that a match of a template of n words has at least."""
        return n if n <= self.k else math.ceil(self.similarity * n - 1e-9)

    def scan(self, texts: list[bytes]) -> list[list[tuple[str, int, int, int, int]]]:
        """For each text its matches: (template, start, end in code points, matched words, words of the span)."""
        return [_outermost(m) for m in self.every(texts)]

    def every(self, texts: list[bytes]) -> list[list[tuple[str, int, int, int, int]]]:
        """The same with matches that lie inside others."""
        words = split(texts, ALNUM)
        starts: dict[tuple[int, int], list[int]] = defaultdict(list)
        for size in self.sizes:
            found = shingles(words.hashes, size)
            known = self.known[size]
            at = np.minimum(np.searchsorted(known, found), len(known) - 1)
            hits = np.flatnonzero(known[at] == found)
            docs = np.searchsorted(words.docs, hits, "right") - 1
            inside = hits + size <= words.docs[docs + 1]
            for p, d in zip(hits[inside].tolist(), docs[inside].tolist(), strict=True):
                for t, place in self.places[size, int(found[p])]:
                    starts[d, t].append(p - place)
        out: list[list] = [[] for _ in texts]
        base = np.cumsum([0] + [len(x) + 1 for x in texts])
        last, points = -1, np.zeros(0, np.int64)
        for (d, t), anchors in sorted(starts.items()):
            if d != last:
                last, points = d, _points_before(texts[d])
            out[d] += self._measure(words, int(base[d]), points, d, t, sorted(set(anchors)))
        return out

    def _measure(self, words: Words, base: int, points: np.ndarray, d: int, t: int, anchors: list[int]):
        """Matches of one template in text d, which starts at byte ``base`` of all texts."""
        low, high = int(words.docs[d]), int(words.docs[d + 1])
        group = [anchors[0]]
        for a in [*anchors[1:], None]:
            if a is not None and a - group[-1] <= self.band:
                group.append(a)
                continue
            for first, end, matched in self._along(words, t, group, low, high):
                z = end - 1
                stop = int(words.at[z] + words.ends[z] - words.starts[z])
                yield (self.names[t], int(points[words.at[first] - base]), int(points[stop - base]), matched, end - first)
            group = [a]

    def _along(self, words: Words, t: int, group: list[int], low: int, high: int):
        """(first, end, matched) of all matches of one chain of starts, a bounded piece of it after the other.

        No match is longer than ``most`` words. A piece leaves out what starts in its last ``most`` words, which the
        next piece holds whole.
        """
        most = int(len(self.words[t]) / self.similarity) + 1
        while group:
            piece = [a for a in group if a <= group[0] + 4 * most + self.band]
            found = self._within(words, t, piece, low, high)
            if len(piece) == len(group):
                yield from found
                return
            sure = piece[-1] - most
            found = [f for f in found if f[0] < sure]
            yield from found
            low = max([low, *[end for _, end, _ in found]])
            group = [a for a in group if a >= sure - most]

    def _within(self, words: Words, t: int, anchors: list[int], low: int, high: int) -> list[tuple[int, int, int]]:
        """The best match near the anchors, and those in the words before and after it."""
        template, out = self.words[t], []
        need, todo = self._least(len(template)), [(anchors, low, high)]
        while todo:
            anchors, low, high = todo.pop()
            if not anchors:
                continue
            wide = self.band + (anchors[-1] - anchors[0] + 1) // 2
            middle = (anchors[0] + anchors[-1]) // 2
            first, last = max(low, middle - wide), min(high, middle + wide + len(template))
            if last - first < need:
                continue
            own = [_word(words, i) for i in range(first, last)]
            there = set(own)
            if sum(w in there for w in template) < need:
                continue
            _, matched, begin, end = align(template, own, middle - first, wide)
            if not matched:
                continue
            if matched >= max(need, self.similarity * (end - begin)):
                out.append((first + begin, first + end, matched))
            # Starts as the fingerprints tell them may be off by the words that an edit adds or drops.
            slack = max(self.band, len(template) // 4 + 1)
            todo.append(([a for a in anchors if a < first + begin], first, first + begin))
            todo.append(([a for a in anchors if a > first + end - slack], first + end, last))
        return out


def _points_before(text: bytes) -> np.ndarray:
    """Code points before each byte of a text, and before its end."""
    out = np.zeros(len(text) + 1, np.int64)
    np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80, out=out[1:])
    return out


def _word(words: Words, i: int) -> bytes:
    return words.data[words.starts[i] : words.ends[i]].tobytes()


def _outermost(matches: list) -> list:
    """Without repeats, and without what lies inside a longer match."""
    unique = sorted(set(matches), key=lambda m: (m[1], m[1] - m[2], m[0]))
    out, reach = [], -1
    for m in unique:
        if m[2] > reach or (out and (m[1], m[2]) == (out[-1][1], out[-1][2])):
            out.append(m)
            reach = max(reach, m[2])
    return out


def scan(docs: DataFrame, templates: dict[str, str] | None = None, hold_bytes: int = 16 << 20, at_once: int = MAX_TEMPLATES, **options) -> DataFrame:
    """(doc_id, matches): matches has template, start, end, matched, words, coverage of each."""
    ship(docs.sparkSession)
    templates = TEMPLATES if templates is None else templates
    names = list(templates)
    parts = [{n: templates[n] for n in names[i : i + at_once]} for i in range(0, len(names), at_once)]
    item = pa.struct([("template", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("matched", pa.int64()), ("words", pa.int64()), ("coverage", pa.float64())])

    def run(batches):
        made: dict[int, Index] = {}

        def index(i: int) -> Index:
            if i not in made:
                made.clear()
                made[i] = Index(parts[i], **options)
            return made[i]

        def search(group: list[pa.RecordBatch]):
            texts = [t for batch in group for t in texts_of(batch.column(1))]
            found: list[list] = [[] for _ in texts]
            sizes: dict[str, int] = {}
            for i in range(len(parts)):
                own = index(i)
                sizes |= {n: len(w) for n, w in zip(own.names, own.words, strict=True)}
                for a, b in slices(texts):
                    for k, more in enumerate(own.every(texts[a:b]), a):
                        found[k] += more
            told = [[dict(zip(("template", "start", "end", "matched", "words", "coverage"), (*m, m[3] / sizes[m[0]]), strict=True)) for m in _outermost(ms)] for ms in found]
            at = 0
            for batch in group:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(told[at : at + batch.num_rows], pa.list_(item))], ["doc_id", "matches"])
                at += batch.num_rows

        group, size = [], 0
        for batch in batches:
            group.append(batch)
            size += batch.nbytes
            if size >= hold_bytes or len(parts) < 2:
                yield from search(group)
                group, size = [], 0
        if group:
            yield from search(group)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, matches array<struct<template:string,start:long,end:long,matched:long,words:long,coverage:double>>")


def op4_license_scan(spark, sf_dir: str) -> DataFrame:
    """Whole ``documents``: number of matches, and each as template:start:end:matched:words, in order."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    told = F.transform("matches", lambda m: F.concat_ws(":", m["template"], m["start"], m["end"], m["matched"], m["words"]))
    return found.select("doc_id", F.size("matches").cast("long").alias("n_matches"), F.array_join(told, ",").alias("matches"), F.coalesce(F.array_max(F.transform("matches", lambda m: m["coverage"])), F.lit(0.0)).alias("coverage"))
