"""Licence texts in documents: MinHash bands over overlapping windows retrieve templates, shingle containment decides.

Windows are ``2 * BLOCK`` shingles long and begin at every ``BLOCK``-th.  Each of the ``BANDS`` bands is one minimum, and its
table leads from a minimum to the templates that hold it.  A window with a share j of its shingles in a template retrieves
it with probability 1 - (1 - j) ** BANDS: 0.9997 for a single common shingle of 16, and more for every longer notice.  Only
retrieved templates are compared, each with the windows that retrieved it.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import cache
from importlib.resources import files

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from harborbook.llm.texts import bare_word_hashes, rolled, steps

WORDS, BLOCK, BANDS, LEAST = 5, 8, 128, 0.75
#: Words of all templates together, which go to every task.
MOST_WORDS = 1_000_000

# Common licence notices in their usual variants.  Signs at the edges of words do not count.
NOTICES = {
    "AGPL-3.0": (
        "GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License",
        "Licensed under the GNU Affero General Public License v3.0",
        "Licensed under the GNU Affero General Public License, version 3",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License 2.0",
        "Licensed under the Apache 2.0 License",
        "Licensed under the Apache-2.0 License",
        "Licensed under Apache License, Version 2.0",
        "Licensed under the Apache License, v2.0",
        "Licensed under the Apache Software License, Version 2.0",
        "Released under the Apache License, Version 2.0",
        "Released under the Apache License 2.0",
        "Released under the Apache 2.0 License",
        "Distributed under the Apache License, Version 2.0",
        "Under the terms of the Apache License, Version 2.0",
        "The ASF licenses this file to You under the Apache License, Version 2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software "
        'distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied. See the License for the specific language governing permissions and limitations under "
        "the License.",
    ),
    "BSD": (
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file",
        "Released under the BSD License",
        "Licensed under the BSD License",
        "Distributed under the BSD License",
        "Under the terms of the BSD License",
    ),
    "BSD-3-Clause": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",),
    "CC-BY-4.0": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "licensed under the Creative Commons Attribution 4.0 International License",
        "licensed under Creative Commons Attribution 4.0 International",
        "Licensed under CC BY 4.0",
        "Licensed under CC-BY 4.0 International",
        "under the terms of the Creative Commons Attribution 4.0 International License",
    ),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
        "licensed under the Creative Commons Attribution-NonCommercial 4.0 International License",
    ),
    "CC-BY-SA-4.0": (
        "Licensed under CC BY-SA 4.0.",
        "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
        "licensed under the Creative Commons Attribution-ShareAlike 4.0 International License",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "Licensed under the GNU General Public License v2.0",
        "GNU General Public License as published by the Free Software Foundation; either version 2 of the License",
        "GNU General Public License version 2 as published by the Free Software Foundation",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License, version 3",
        "Licensed under the GNU General Public License v3.0",
        "Licensed under the GNU GPL v3",
        "GNU General Public License as published by the Free Software Foundation, either version 3 of the License",
        "GNU General Public License version 3 as published by the Free Software Foundation",
    ),
    "LGPL-2.1": ("GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License",),
    "LGPL-3.0": (
        "Licensed under the GNU Lesser General Public License v3.0",
        "GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License",
        "Distributed under the MIT License",
        "Available under the MIT License",
        "Published under the MIT License",
        "Released under an MIT License",
        "Licensed under an MIT License",
        "Licensed under a MIT License",
        "Released under the MIT Licence",
        "Licensed under the MIT Licence",
        "Under the terms of the MIT License",
        "This project is MIT licensed",
        "Use of this source code is governed by an MIT-style license that can be found in the LICENSE file",
    ),
    "MIT-text": ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
        "Licensed under the Mozilla Public License 2.0",
        "Licensed under the Mozilla Public License, v. 2.0",
        "Licensed under the Mozilla Public License, Version 2.0",
    ),
}


@cache
def catalogue() -> dict[str, tuple[str, ...]]:
    """``NOTICES``, and each file of ``licence_texts`` as a template ``<name>-text``.

    These are the whole texts, without copyright lines where a licence begins with them.  Licences that hold the text of
    another one (BSD-3-Clause that of BSD-2-Clause) are found beside it; the containment tells which fits better.
    """
    out = dict(NOTICES)
    for file in files("harborbook.llm").joinpath("licence_texts").iterdir():
        name = file.name.removesuffix(".txt") + "-text"
        out[name] = (*out.get(name, ()), file.read_text(encoding="utf-8"))
    return out


_ODD = np.random.default_rng(20240501).integers(0, 1 << 63, (2, BANDS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _order(shingles: np.ndarray, band: int) -> np.ndarray:
    """Values that put shingles into the order of a band."""
    return ((shingles * _ODD[0, band]) ^ (shingles >> np.uint64(31))) * _ODD[1, band]


def _shingled(words: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingle, first word, text) of all whole shingles of all texts."""
    values = rolled(words, WORDS)
    end = np.repeat(before[1:], np.diff(before))[: len(values)]
    at = np.flatnonzero(np.arange(len(values)) + WORDS <= end)
    return values[at], at, np.searchsorted(before, at, side="right") - 1


def _blocks(at: np.ndarray, text: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where blocks begin, and whether the next block belongs to the same text."""
    number = (at - before[text]) // BLOCK
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(number) != 0) | (np.diff(text) != 0)
    first = np.flatnonzero(new)
    follows = np.zeros(len(first), bool)
    follows[:-1] = text[first[1:]] == text[first[:-1]]
    return first, follows


def _window_minima(low: np.ndarray, follows: np.ndarray) -> np.ndarray:
    return np.where(follows, np.minimum(low, np.append(low[1:], low[-1:])), low)


class _Templates:
    """Names and shingles of all templates; a name has one for each of its variants, which follow each other."""

    def __init__(self, texts: Mapping[str, str | Sequence[str]]):
        variants = [(n, v) for n in sorted(texts) for v in ([texts[n]] if isinstance(texts[n], str) else texts[n])]
        self.names = [n for n, _ in variants]
        data = pa.array([v for _, v in variants], pa.string())
        self.sets: list[np.ndarray] = []
        for _, body, starts in steps(data, 1 << 62):
            words, _, before, _ = bare_word_hashes(body, starts)
            if len(words) > MOST_WORDS:
                raise ValueError(f"templates have {len(words)} words; {MOST_WORDS} are allowed")
            shingles, at, text = _shingled(words, before)
            self.sets = [np.unique(shingles[text == k]) for k in range(len(self.names))]
        # A template may lie anywhere in a window, so each of its shingles may be the least one.
        of = np.repeat(np.arange(len(self.sets)), np.array([len(x) for x in self.sets], np.int64))
        shingles = np.concatenate([np.zeros(0, np.uint64), *self.sets])
        self.bands = [_Band(_order(shingles, k), of) for k in range(BANDS)]


class _Band:
    """From a minimum to the numbers of the templates that have it."""

    def __init__(self, minima: np.ndarray, templates: np.ndarray):
        by = np.argsort(minima, kind="stable")
        self.templates = templates[by].astype(np.int64)
        self.values, self.start = np.unique(minima[by], return_index=True)
        self.count = np.diff(np.append(self.start, len(by)))

    def retrieve(self, minima: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in ``minima``, template) for every template of every minimum."""
        hit = np.flatnonzero(_member(minima, self.values))
        slot = np.searchsorted(self.values, minima[hit])
        n = self.count[slot]
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(hit, n), self.templates[np.repeat(self.start[slot], n) + inside]


def _member(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def license_notices(docs: DataFrame, templates: Mapping[str, str | Sequence[str]] | None = None, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, license, containment, n_places, first_word, end_word): documents that hold a template.

    A document holds a template if three quarters of the distinct five-word shingles of this stand in windows that
    retrieve it (A-Z as a-z).  Signs at the edges of words, comment marks too, do not count.  Templates are those of
    ``catalogue()`` if none are given; of the variants of one the best is reported, then the first.  ``n_places`` counts
    occurrences of its commonest shingle, the words (of all that the text has) are the first and the one after the last of
    its shingles.  Templates of fewer than five words, null and empty texts match nothing.  Null and repeated ids are
    reported row by row.
    """
    known = docs.sparkSession.sparkContext.broadcast(_Templates(catalogue() if templates is None else templates))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = known.value
        for batch in batches:
            out: list[tuple] = []
            for row, body, starts in steps(batch.column("text")):
                words, number, before, words_before = bare_word_hashes(body, starts)
                shingles, at, of = _shingled(words, before)
                if not len(shingles):
                    continue
                first, follows = _blocks(at, of, before)
                pairs = np.zeros(0, np.int64)  # window * number of templates + template
                for k in range(BANDS):
                    minima = _window_minima(np.minimum.reduceat(_order(shingles, k), first), follows)
                    window, template = table.bands[k].retrieve(minima)
                    pairs = np.union1d(pairs, window * len(table.names) + template)
                if not len(pairs):
                    continue
                window, template = np.divmod(pairs, len(table.names))
                pairs = np.append(pairs, pairs[follows[window]] + len(table.names))  # both blocks of a window
                block, template = np.divmod(np.unique(pairs), len(table.names))
                by = np.lexsort((block, template, of[first[block]]))
                block, template = block[by], template[by]
                doc_of = of[first[block]]
                ends = np.append(first[1:], len(shingles))
                edges = np.flatnonzero((np.diff(template, prepend=-1) != 0) | (np.diff(doc_of, prepend=-1) != 0))
                best: dict[tuple[int, str], tuple] = {}
                for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(block)], strict=True):
                    wanted, name, doc = table.sets[template[a]], table.names[template[a]], int(doc_of[a])
                    n = ends[block[a:b]] - first[block[a:b]]
                    if n.sum() < LEAST * len(wanted):
                        continue
                    inside = np.arange(n.sum()) + np.repeat(first[block[a:b]] - (np.cumsum(n) - n), n)
                    inside = inside[_member(shingles[inside], wanted)]
                    kinds, counts = np.unique(shingles[inside], return_counts=True)
                    share = len(kinds) / len(wanted)
                    if len(kinds) >= LEAST * len(wanted) and ((doc, name) not in best or share > best[doc, name][2]):
                        spot = at[inside]
                        first_word, last_word = (int(number[k] - words_before[doc]) for k in (spot[0], spot[-1] + WORDS - 1))
                        best[doc, name] = (row + doc, name, share, int(counts.max()), first_word, last_word + 1)
                out.extend(best.values())
            columns = [batch.column("id").take(pa.array([o[0] for o in out], pa.int64()))]
            kinds_ = (pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
            columns += [pa.array([o[k + 1] for o in out], t) for k, t in enumerate(kinds_)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "license", "containment", "n_places", "first_word", "end_word"])

    base = docs.selectExpr(f"`{doc_id}` AS id", f"`{text}` AS text")
    kind = base.schema["id"].dataType.simpleString()
    return base.mapInArrow(scan, f"doc_id {kind}, license string, containment double, n_places bigint, first_word bigint, end_word bigint")
