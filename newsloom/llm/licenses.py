"""License scans: MinHash bands over overlapping text windows, verified by exact shingle containment.

Each template belongs to a size class. Texts are cut into blocks of a power of two shingles, enough for every
template of the class, and a window is two blocks in a row, so that windows overlap by half and a template lies within one
wherever it stands. A band is one coordinate of a window, the least hash of its shingles under one permutation. If
a window holds enough of a template, the two agree on a band with the Jaccard similarity of their shingles, which
is known from their sizes; each class takes as many bands as leave no more than MISSED of such windows without a
common one. (Templates of one shingle need windows of one, and one band.) Windows that share a band retrieve a
template, which is then verified: its distinct shingles in the window, over all that it has.

The templates are a fixed list of short public notices, so they travel with the tasks, and the scan shuffles
nothing. Null or empty texts hold no license. Null ids are kept; repeated rows come back as often as they came in.
Columns other than id and text are not looked at.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.spans import PrefixHash, mix, word_edges, words_of
from newsloom.llm.tables import small_batches

MISSED = 1e-5
SHINGLE = 5
FACTORS = mix(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)

# Notices of well-known public licenses, as their texts recommend them, and usual short forms.
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is "
        "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License.",
    ],
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of "
        "the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions:",
    ],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version.",
    ],
    "cc-by-nc-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "cc-by-4.0": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "bsd-3-clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met:",
        "Licensed under the BSD 3-Clause License.",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
        "was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
}


def word_runs(joined: bytes, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of the run of words that begins at each word, in reading order, with its start and end in bytes."""
    start, end = word_edges(joined)
    if not len(start):
        return np.zeros(0, dtype=np.uint64), start, end
    last = max(len(start) - size, 0)
    a, b = start[: last + 1], end[min(size, len(end)) - 1 :]
    return PrefixHash(joined).spans(a, b), a, b


def _coordinates(hashes: np.ndarray, coordinate: int) -> np.ndarray:
    """A permutation of 64-bit words: the hashes are mixed already, so an odd factor is enough."""
    return hashes * FACTORS[coordinate]


def block_for(size: int) -> int:
    return 1 << (size - 1).bit_length()


def bands_for(block: int, size: int, threshold: float, missed: float = MISSED) -> int:
    """Bands that a template of ``size`` shingles needs to be retrieved but for a share ``missed``."""
    held = math.ceil(threshold * size - 1e-9)
    window = block if block == 1 else 2 * block
    alike = held / (window + size - held)
    return 1 if alike >= 1 else math.ceil(math.log(missed) / math.log(1 - alike))


class Scanner:
    def __init__(self, templates: dict[str, list[str]], shingle: int, threshold: float):
        self.shingle, self.threshold = shingle, threshold
        self.names: list[str] = []
        self.sets: list[np.ndarray] = []
        for name, texts in templates.items():
            for text in texts:
                hashes = np.unique(word_runs(words_of(text), shingle)[0])
                if len(hashes):
                    self.names.append(name)
                    self.sets.append(hashes)
        # block length -> band -> value -> templates
        self.classes: dict[int, list[dict[int, list[int]]]] = {}
        for t, hashes in enumerate(self.sets):
            block = block_for(len(hashes))
            bands = self.classes.setdefault(block, [])
            need = bands_for(block, len(hashes), threshold)
            bands += [{} for _ in range(need - len(bands))]
        for t, hashes in enumerate(self.sets):
            block = block_for(len(hashes))
            for c, values in enumerate(self.classes[block]):
                values.setdefault(int(_coordinates(hashes, c).min()), []).append(t)

    def scan(self, texts: list[bytes]) -> list[dict[str, tuple[float, int]]]:
        """For each text the licenses found: the share of a template that a window holds, and the window's place."""
        runs = [word_runs(t, self.shingle)[0] for t in texts]
        size = np.array([len(r) for r in runs], dtype=np.int64)
        base = np.concatenate([[0], np.cumsum(size)])
        hashes = np.concatenate(runs) if runs else np.zeros(0, dtype=np.uint64)
        best: list[dict[str, tuple[float, int]]] = [{} for _ in texts]
        if not len(hashes):
            return best
        # Blocks begin anew with each text; a block of 2^i is made of two of the level below, at ``left, right``.
        levels, block, count = [], 1, size
        while block <= max(self.classes):
            if block > 1:
                below, count = count, -(-count // 2)
                owner = np.repeat(np.arange(len(texts)), count)
                nth = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
                left = (np.cumsum(below) - below)[owner] + 2 * nth
                right = np.minimum(left + 1, np.cumsum(below)[owner] - 1)
            else:
                owner = np.repeat(np.arange(len(texts)), count)
                nth = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
                left = right = None
            following = np.minimum(np.arange(len(owner)) + 1, np.cumsum(count)[owner] - 1)
            levels.append((block, owner, base[owner] + nth * block, left, right, following))
            block *= 2
        windows = {block: (owner, starts) for block, owner, starts, *_ in levels}
        retrieved: set[tuple[int, int, int]] = set()
        for c in range(max(len(bands) for bands in self.classes.values())):
            least = _coordinates(hashes, c)
            for block, _, _, left, right, following in levels:
                if block > 1:
                    least = np.minimum(least[left], least[right])
                bands = self.classes.get(block, [])
                if c >= len(bands):
                    continue
                window = least if block == 1 else np.minimum(least, least[following])
                wanted = np.array(sorted(bands[c]), dtype=np.uint64)
                place = np.minimum(np.searchsorted(wanted, window), len(wanted) - 1)
                for at in np.flatnonzero(wanted[place] == window):
                    retrieved.update((block, int(at), t) for t in bands[c][int(window[at])])
        for block, at, t in retrieved:
            owner, starts = windows[block]
            text, first = int(owner[at]), int(starts[at])
            inside = hashes[first : min(first + (block if block == 1 else 2 * block), int(base[text + 1]))]
            share = float(np.isin(self.sets[t], inside).sum() / len(self.sets[t]))
            place, name = first - int(base[text]), self.names[t]
            held = best[text].get(name)
            if share >= self.threshold and (held is None or (-share, place) < (-held[0], held[1])):
                best[text][name] = (share, place)
        return best


def scan_licenses(
    docs: DataFrame,
    templates: dict[str, list[str]] | None = None,
    shingle: int = SHINGLE,
    threshold: float = 0.8,
) -> DataFrame:
    """``(doc_id, license, containment, first_word)``: a row for each license that a document holds.

    ``containment`` is the largest share of a template's shingles within a window, ``first_word`` the place of the
    first such window.
    """
    chosen = TEMPLATES if templates is None else templates

    def step(batches):
        scanner = Scanner(chosen, shingle, threshold)
        for batch in batches:
            out: list[tuple] = []
            found = scanner.scan([words_of(t) for t in batch.column("text").to_pylist()])
            for doc, held in zip(batch.column("doc_id").to_pylist(), found, strict=True):
                out += [(doc, name, *where) for name, where in sorted(held.items())]
            columns = list(zip(*out, strict=True)) if out else [[], [], [], []]
            kinds = (pa.int64(), pa.string(), pa.float64(), pa.int64())
            yield pa.record_batch(
                [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)],
                names=["doc_id", "license", "containment", "first_word"],
            )

    slim = small_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return slim.mapInArrow(step, "doc_id long, license string, containment double, first_word long")
