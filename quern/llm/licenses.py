"""Licence scans: a trained paragraph classifier, confirmed by comparison with templates.

A paragraph is a block of lines between lines without a word; line feeds in it are read as spaces, and as only letters and
digits are read, so are comment marks.  Within it every run of words that holds at least ``CONFIRM`` of some
template's word pairs is sought in one pass (the shortest ones, widened to what goes on with the template), whether it is
a line, is wrapped over some, or stands in a longer block.  Runs have no greatest length.

A sparse multinomial logistic regression over words and pairs of words of a run, with ``CONTEXT`` words on either side
(weighted by 1 / sqrt(number of features)), gives one of ``FAMILIES`` or "unknown".  It is trained here once, on the
driver, and its weights go to the workers: on variants of the templates (words dropped, words of other texts around
them) and on paragraphs without a licence as the unknown class; only n-grams of the templates are features.  Every fifth variant
is held out: its scores set the temperature (least log loss), and the least probability that is believed is the smallest
at which at most one in a hundred unknown paragraphs passes.  Below it a run is unknown.

A prediction is confirmed where the run has ``CONFIRM`` of the pairs of a template of that family, and of those besides its name, and the words that
tell it from others: the template's name as it stands (such as "lesser general public license"), none of the pairs that make it
another family's (``CONTRARY``), and no negation right before it.

Defined results: null or empty texts give no rows; repeated rows give repeated rows; equal
probabilities go to the family listed first.  A notice's span is that of its lines, its number that of the first.  Of notices of one family that
overlap, and of one within another, that which holds more of a template's word pairs stays, then that of fewer lines.
"""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from functools import cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

#: Family -> names under which it is granted, and SPDX identifiers.
NAMES = {
    "Apache": (["Apache License, Version 2.0", "Apache License 2.0", "Apache License", "Apache 2.0 License", "Apache-2.0"], ["Apache-2.0", "Apache-1.1"]),
    "MIT": (["MIT License", "MIT licence"], ["MIT", "MIT-0"]),
    "ISC": (["ISC License"], ["ISC"]),
    "BSD": (["BSD License", "BSD 3-Clause License", "BSD 2-Clause License", "3-Clause BSD License", "BSD-3-Clause", "BSD-2-Clause", "BSD-style license"], ["BSD-3-Clause", "BSD-2-Clause", "0BSD"]),
    "LGPL": (["GNU Lesser General Public License", "GNU Library General Public License", "Lesser General Public License", "GNU LGPL", "LGPL", "LGPLv3", "LGPLv2"], ["LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-or-later", "LGPL-2.0-only"]),
    "AGPL": (["GNU Affero General Public License", "Affero General Public License", "GNU AGPL", "AGPL", "AGPLv3"], ["AGPL-3.0-only", "AGPL-3.0-or-later"]),
    "GPL": (["GNU General Public License", "General Public License", "GNU GPL", "GPL", "GPLv2", "GPLv3"], ["GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later"]),
    "MPL": (["Mozilla Public License", "Mozilla Public License, version 2.0", "Mozilla Public License, v. 2.0", "MPL 2.0"], ["MPL-2.0", "MPL-1.1"]),
    "EPL": (["Eclipse Public License", "Eclipse Public License v2.0", "EPL 2.0"], ["EPL-2.0", "EPL-1.0"]),
    "BSL": (["Boost Software License", "Boost Software License, Version 1.0"], ["BSL-1.0"]),
    "Unlicense": (["Unlicense"], ["Unlicense"]),
    "Zlib": (["zlib License", "zlib/libpng license"], ["Zlib"]),
    "CC0": (["CC0 1.0", "CC0", "Creative Commons Zero", "CC0 1.0 Universal"], ["CC0-1.0"]),
    "CC-BY": (["CC BY 4.0", "CC-BY", "Creative Commons Attribution", "Creative Commons Attribution 4.0 International License"], ["CC-BY-4.0", "CC-BY-3.0"]),
    "CC-BY-SA": (["CC BY-SA 4.0", "CC BY-SA", "Creative Commons Attribution-ShareAlike", "Creative Commons Attribution Share Alike"], ["CC-BY-SA-4.0", "CC-BY-SA-3.0"]),
    "CC-BY-ND": (["CC BY-ND 4.0", "CC BY-ND", "Creative Commons Attribution-NoDerivatives", "Creative Commons Attribution-NoDerivs"], ["CC-BY-ND-4.0"]),
    "CC-BY-NC": (["CC BY-NC 4.0", "CC BY-NC", "Creative Commons Attribution-NonCommercial", "Creative Commons Attribution-NonCommercial 4.0 International License"], ["CC-BY-NC-4.0"]),
    "CC-BY-NC-SA": (["CC BY-NC-SA 4.0", "CC BY-NC-SA", "Creative Commons Attribution-NonCommercial-ShareAlike"], ["CC-BY-NC-SA-4.0"]),
    "CC-BY-NC-ND": (["CC BY-NC-ND 4.0", "CC BY-NC-ND", "Creative Commons Attribution-NonCommercial-NoDerivatives", "Creative Commons Attribution-NonCommercial-NoDerivs"], ["CC-BY-NC-ND-4.0"]),
}
FORMS = ["Licensed under the {}", "Licensed under {}", "Released under the {}", "Released under {}", "This work is licensed under a {}", "distributed under the terms of the {}", "made available under the {}", "License: {}"]
_FREE = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
_NO_WARRANTY = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {}General Public License for more details."
#: Family -> (text, the name in it without which it isn't that family's).
BODIES = {
    "Apache": [
        ("you may not use this file except in compliance with the License", ""),
        ("You may obtain a copy of the License at apache.org/licenses", "apache org licenses"),
        ('distributed under the License is distributed on an "AS IS" BASIS', ""),
    ],
    "MIT": [
        ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "any person obtaining a copy"),
        ("and associated documentation files, to deal in the Software without restriction", ""),
        ("The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software", "substantial portions"),
    ],
    "ISC": [("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "without fee")],
    "BSD": [
        ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", ""),
        ("Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", ""),
        ("Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation", ""),
        ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ""),
    ],
    "LGPL": [(_FREE.format("Lesser "), "lesser general public license"), (_NO_WARRANTY.format("Lesser "), "lesser general public license")],
    "AGPL": [(_FREE.format("Affero "), "affero general public license"), (_NO_WARRANTY.format("Affero "), "affero general public license")],
    "GPL": [(_FREE.format(""), "general public license"), (_NO_WARRANTY.format(""), "general public license")],
    "MPL": [("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at", "")],
    "EPL": [("This program and the accompanying materials are made available under the terms of the Eclipse Public License v. 2.0", "eclipse public license")],
    "BSL": [("Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", "person or organization")],
    "Unlicense": [("This is free and unencumbered software released into the public domain.", "unencumbered software"), ("Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary", "")],
    "Zlib": [("Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely", ""), ("The origin of this software must not be misrepresented; you must not claim that you wrote the original software", "")],
    "CC0": [
        ("This work is dedicated to the public domain under CC0 1.0.", "cc0"),
        ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", ""),
    ],
    "CC-BY": [("This work is licensed under a Creative Commons Attribution 4.0 International License.", "creative commons attribution")],
    "Proprietary": [
        ("All rights reserved.", "all rights reserved"),
        ("Copyright 2020 Example Inc. All rights reserved.", "all rights reserved"),
        ("This material may not be reproduced, distributed or transmitted in any form without the prior written permission of the publisher.", ""),
        ("This software is proprietary and confidential. Unauthorized copying of this file, via any medium, is strictly prohibited", ""),
    ],
}
#: Paragraphs about licences, rights and versions that grant nothing, and ordinary ones.
UNKNOWN = [
    "He lost his driver's license on the way to work.",
    "The committee discussed the rights of all workers in the public sector.",
    "Version 2.0 of the report was released under pressure in the spring.",
    "She reserved a table for all of us under her name.",
    "The general asked for permission to use the software without a warranty.",
    "Copies of the notice were distributed to any person at the door, free of charge.",
    "The Apache helicopter landed in source village, version unknown.",
    "Students of MIT released a study on the history of printing.",
    "The public domain is a subject of this work on copyright law.",
    "License plates are issued by the state and must be kept clean.",
    "This work is the best version of the story in any form.",
    "All of the files are in the list and in the following order:",
    "The source of the river is in the north, and its form changes with the seasons.",
    "We use words of all kinds, to be read by the public in the evening.",
    "The following conditions were met by none of them: rain, wind and snow.",
    "Creative people work in common rooms.",
    "International trade and commercial attribution are different fields.",
    "The Mozilla foundation published a report on the general public and its terms of use.",
    "The eclipse was seen by the public under a clear sky; the license of the boat had expired.",
    "A boost in software sales, version 1.0 of the plan, and a license fee of zero.",
    "The lesser of two evils was distributed under the table by the state library.",
]
FAMILIES = [*NAMES, "Proprietary", "unknown"]
#: Pairs of words that make a run another family's.
CONTRARY = {
    "GPL": {("lesser", "general"), ("library", "general"), ("affero", "general")},
    "CC-BY": {(a, b) for a in ("by", "attribution") for b in ("sa", "nd", "nc", "sharealike", "share", "noderivatives", "noderivs", "no", "noncommercial", "non")},
    "CC-BY-NC": {(a, b) for a in ("nc", "noncommercial", "commercial") for b in ("sa", "nd", "sharealike", "share", "noderivatives", "noderivs", "no")},
}
CONFIRM, SEED = 0.5, 7
#: Words between the pairs of one notice, at most, where a run is widened; words beside a run that the classifier reads.
APART, CONTEXT = 8, 2
_NEGATIONS = {"not", "never", "isn", "aren", "wasn", "neither", "nor", "without", "no", "nothing", "cannot"}
_WORD = re.compile(r"[^\W_]+")
Pair = tuple[str, str]


def _words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _templates() -> list[tuple[int, str, tuple[str, ...]]]:
    """(family, text, name)"""
    out = []
    for family, (names, ids) in NAMES.items():
        c = FAMILIES.index(family)
        out += [(c, form.format(name), tuple(_words(name))) for name in names for form in FORMS]
        out += [(c, f"SPDX-License-Identifier: {i}", tuple(_words(f"identifier {i}"))) for i in ids]
    for family, bodies in BODIES.items():
        out += [(FAMILIES.index(family), text, tuple(_words(name))) for text, name in bodies]
    return out


def features(words: list[str]) -> set[str]:
    return {*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))}


def _variants(rng: random.Random, templates: list[tuple[int, str, tuple[str, ...]]]) -> list[tuple[list[str], int]]:
    fill = [w for u in UNKNOWN for w in _words(u)]
    per = Counter(c for c, _, _ in templates)
    out = []
    for c, text, _ in templates:
        ws = _words(text)
        for _ in range(max(30 if len(ws) > 12 else 5, 240 // per[c])):
            kept = [w for w in ws if rng.random() > rng.choice([0, 0, 0.05, 0.1])]
            before, after = (rng.choices(fill, k=rng.choice([0, 0, 0, 1, CONTEXT, 4])) for _ in range(2))
            out.append((before + kept + after, c))
    none = len(FAMILIES) - 1
    for u in UNKNOWN:
        out += [([w for w in _words(u) if rng.random() > 0.1], none) for _ in range(20)]
    vocabulary = [w for _, t, _ in templates for w in _words(t)]
    for _ in range(700):  # words of templates and others, shuffled
        out.append((rng.choices(vocabulary, k=rng.randint(1, 6)) + rng.choices(fill, k=rng.randint(2, 14)), none))
    rng.shuffle(out)
    return out


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Model:
    """The classifier; ``fit`` gives the one of the templates above."""

    def __init__(self):
        given = _templates()
        found = sorted({f for _, t, _ in given for f in features(_words(t))})
        self.index = {f: i for i, f in enumerate(found)}
        #: (family, pairs, name), and which templates hold a pair.
        self.templates = [(c, frozenset(zip(ws, ws[1:], strict=False)), name) for c, t, name in given for ws in [_words(t)]]
        self.holding: dict[Pair, list[int]] = defaultdict(list)
        for k, (_, pairs, _) in enumerate(self.templates):
            for x in pairs:
                self.holding[x].append(k)
        rows = _variants(random.Random(SEED), given)
        x = np.stack([self.vector(p) for p, _ in rows])
        y = np.array([c for _, c in rows])
        held = np.arange(len(rows)) % 5 == 0
        w = v = np.zeros((x.shape[1], len(FAMILIES)))
        tx, ty = x[~held], np.eye(len(FAMILIES))[y[~held]]
        step, t = 1.0 / (0.5 * np.linalg.norm(tx, 2) ** 2 / len(tx)), 1.0
        for _ in range(300):  # accelerated proximal gradient: the l1 term keeps the weights sparse
            new = v - step * (tx.T @ (_softmax(tx @ v) - ty) / len(tx))
            new[:-1] = np.sign(new[:-1]) * np.maximum(0, np.abs(new[:-1]) - step * 3e-5)
            after = (1 + np.sqrt(1 + 4 * t * t)) / 2
            w, v, t = new, new + (t - 1) / after * (new - w), after
        z, hy = x[held] @ w, y[held]
        losses = {t: -np.log(_softmax(z / t)[np.arange(len(hy)), hy] + 1e-12).mean() for t in np.geomspace(0.05, 3, 40)}
        self.temperature = min(losses, key=losses.get)
        p = _softmax(z / self.temperature)
        self.held_out_accuracy = float((p.argmax(axis=1) == hy).mean())
        wrong = np.sort(p[hy == len(FAMILIES) - 1, :-1].max(axis=1))
        self.least = float(max(0.5, wrong[int(0.99 * (len(wrong) - 1))]))
        self.w = w.astype(np.float32)

    def vector(self, words: list[str]) -> np.ndarray:
        fs = features(words)
        v = np.zeros(len(self.index) + 1)
        for f in fs:
            if f in self.index:
                v[self.index[f]] = 1 / np.sqrt(len(fs))
        v[-1] = 1
        return v

    def probabilities(self, words: list[str]) -> np.ndarray:
        fs = features(words)
        at = sorted(self.index[f] for f in fs if f in self.index)
        z = self.w[-1].astype(np.float64)
        if at:
            z = z + self.w[at].sum(axis=0, dtype=np.float64) / np.sqrt(len(fs))
        return _softmax(z / self.temperature)

    def candidates(self, words: list[str]) -> dict[int, list[tuple[int, Pair]]]:
        """template -> (place, pair) of its pairs, for the templates of which the words hold CONFIRM of the pairs."""
        hits = [(k, x) for k, x in enumerate(zip(words, words[1:], strict=False)) if x in self.holding]
        if not hits:
            return {}
        counts = Counter(t for x in {x for _, x in hits} for t in self.holding[x])
        out = {}
        for t, n in counts.items():
            pairs = self.templates[t][1]
            if n >= CONFIRM * len(pairs):
                out[t] = [h for h in hits if h[1] in pairs]
        return out

    def judged(self, words: list[str], first: int, last: int, t: int) -> tuple[float, float] | None:
        """(probability, similarity) if the run of words is a notice of the template's family."""
        c, pairs, name = self.templates[t]
        run = words[first : last + 1]
        have = set(zip(run, run[1:], strict=False))
        alike = len(pairs & have) / len(pairs)
        if alike < CONFIRM or name and not _contains(words[max(0, first - 1) : last + 4], name):
            return None
        beside = pairs.difference(zip(name, name[1:], strict=False))  # a name alone grants nothing
        if len(beside & have) < CONFIRM * len(beside):
            return None
        near = words[max(0, first - 1) : last + 4]
        if CONTRARY.get(FAMILIES[c], frozenset()) & set(zip(near, near[1:], strict=False)):
            return None
        if _NEGATIONS & set(words[max(0, first - 4) : first]):
            return None
        p = self.probabilities(words[max(0, first - CONTEXT) : last + 1 + CONTEXT])
        return (float(p[c]), alike) if int(p.argmax()) == c and p[c] >= self.least else None

    def classify(self, paragraph: str) -> tuple[str, float, float]:
        """(family or unknown, its probability, similarity to that family's nearest template) of the best notice in a paragraph."""
        found = self.notices([paragraph])
        return found[0][2:] if found else ("unknown", float(self.probabilities(_words(paragraph))[-1]), 0.0)

    def notices(self, lines: list[str]) -> list[tuple[int, int, str, float, float]]:
        """(first line, last line, family, probability, similarity) of the notices of a block, by first line."""
        by_line = [_words(line) for line in lines]
        ws = [w for line in by_line for w in line]
        of = [n for n, line in enumerate(by_line) for _ in line]  # the line of each word
        best: dict[tuple[int, int, str], tuple[int, float, float]] = {}
        for t, hits in self.candidates(ws).items():
            c, pairs, _ = self.templates[t]
            for wide, short in _runs(hits, CONFIRM * len(pairs)):
                for first, last in (wide, short):  # the widened run, else the shortest
                    if got := self.judged(ws, first, last, t):
                        at = (of[first], of[last], FAMILIES[c])
                        best[at] = max(best.get(at, (0, 0.0, 0.0)), (round(got[1] * len(pairs)), *got))
                        break
        out, over = [], defaultdict(dict)  # over: line -> family -> last line of the notice that covers it
        for (first, last, family), (_, p, alike) in sorted(best.items(), key=lambda x: (-x[1][0], x[0][1] - x[0][0], -x[1][1], x[0][0], FAMILIES.index(x[0][2]))):
            if any(b >= last for b in over[first].values()) or any(family in over[k] for k in range(first, last + 1)):
                continue
            out.append((first, last, family, p, alike))
            for k in range(first, last + 1):
                over[k][family] = last
        return sorted(out)


def _contains(words: list[str], name: tuple[str, ...]) -> bool:
    n = len(name)
    return any(tuple(words[k : k + n]) == name for k, w in enumerate(words[: len(words) - n + 1]) if w == name[0])


def _runs(hits: list[tuple[int, Pair]], least: float) -> set[tuple[tuple[int, int], tuple[int, int]]]:
    """(widened, shortest) runs of words, as first and last, with so many different pairs; hits are (place, pair), by place.

    A run is widened to pairs that it hasn't yet, as long as each is at most ``APART`` words from the one before."""
    out, counts, first = set(), Counter(), 0
    for last, (end, x) in enumerate(hits):
        counts[x] += 1
        while len(counts) >= least and (counts[hits[first][1]] > 1 or len(counts) - 1 >= least):
            counts[hits[first][1]] -= 1
            if not counts[hits[first][1]]:
                del counts[hits[first][1]]
            first += 1
        if len(counts) < least:
            continue
        begin, have, wide = hits[first][0], set(counts), []
        for way, side in ((-1, range(first - 1, -1, -1)), (1, range(last + 1, len(hits)))):
            edge = begin if way < 0 else end
            for h in side:
                if abs(hits[h][0] - edge) > APART:
                    break
                if hits[h][1] not in have:
                    have.add(hits[h][1])
                    edge = hits[h][0]
            wide.append(edge)
        out.add(((wide[0], wide[1] + 1), (begin, end + 1)))
    return out


@cache
def fit() -> Model:
    """The model, trained once a process, on the driver."""
    return Model()


def scan(df: DataFrame, key: str = "doc_id", text: str = "text", model: Model | None = None) -> DataFrame:
    """One row for each notice: key, paragraph (its first line, from 0), begin, finish (code points), family, probability, similarity."""
    arrow = pa.schema([("key", pa.int64()), ("paragraph", pa.int64()), ("begin", pa.int64()), ("finish", pa.int64()), ("family", pa.string()), ("probability", pa.float64()), ("similarity", pa.float64())])
    # its size is that of the templates', under 1 MB: it goes to the workers with the function
    model = model or fit()

    def make():
        seen: dict[str, list] = {}

        def work(cols):
            rows = []
            for key, said in zip(*cols, strict=True):
                lines = (said or "").split("\n")
                starts = [0, *accumulate(len(line) + 1 for line in lines)]
                block = 0
                for n, line in enumerate([*lines, ""]):
                    if _WORD.search(line):
                        continue
                    if n > block:
                        joined = "\n".join(lines[block:n])
                        got = seen.get(joined)
                        if got is None:
                            got = model.notices(lines[block:n])
                            if len(joined) < 300 and len(seen) < 20_000:
                                seen[joined] = got
                        for first, last, *rest in got:
                            rows.append((key, block + first, starts[block + first], starts[block + last + 1] - 1, *rest))
                    block = n + 1
            return [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in arrow]

        return work

    rows = df.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("t"))
    return map_rows(rows, make, "key bigint, paragraph bigint, begin bigint, finish bigint, family string, probability double, similarity double", arrow).withColumnRenamed("key", key)
