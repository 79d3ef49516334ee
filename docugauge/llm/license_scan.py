"""License scans: a paragraph classifier whose predictions a template must confirm, all of it Spark functions.

Marks of comments at the begin of lines (``#``, ``//``, ``*``, ...) are taken off first. A paragraph is a line,
or a run of lines that are joined, as notices are often hard-wrapped: lines without a blank one between
them, each with a word of the gate (below) or next to one that has. Lines that are confirmed by themselves
are left out of the run, and it counts if it is confirmed or none of its lines is predicted. A paragraph
has one family, and the number of its first line.

Features are the word 1-, 2- and 3-grams of the templates and of the sentences that name no licence, but
for those of common words alone. Weights are a sparse multinomial logistic regression (accelerated
proximal gradient steps, which leave most weights at zero), fitted on the templates with words left out and
text around them against ordinary lines and sentences that merely speak of licences. For the temperature
that calibrates it, whole templates are held out in turn, with the sentences and ordinary lines of the same
turn, and judged by a classifier that was fitted on the others. Fitting takes a bounded sample: SAMPLE
documents by order of a hash, SAMPLE_CHARS characters of each, and the templates.

A paragraph whose likeliest class is a family with probability LEAST or more is predicted to be of that
family. It is confirmed if it holds at least COVER of the 2-grams of a template of the family.

Scoring is one projection over whole texts without a shuffle. The gate is a list of words, derived from the
weights: all features that hold none of them can't, together, lift a family above the unknown class, so a
line without them can't be predicted and isn't scored. What is scored needs about 20 times its own size in
memory, a line or run at a time.

Null and empty texts have no licence; a null text has no paragraphs. Repeated rows and ties are judged
row by row, ties of classes go to the unknown class, then by family name. Other columns pass through.
"""

from __future__ import annotations

import random
import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docugauge.llm.frames import fresh, let, some

SAMPLE, SAMPLE_CHARS = 300, 3000
LEAST, COVER = 0.5, 0.75
UNKNOWN = "unknown"

# Notices by which common licences are named, and the first paragraphs of their usual headers.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. The ASF licenses this file to you under the Apache License, Version 2.0",
    ),
    "BSD-3-Clause": (
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "This software is provided under the BSD license.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "To view a copy of this license, visit http://creativecommons.org/licenses/by-nc/4.0/"),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "To view a copy of this license, visit http://creativecommons.org/licenses/by-sa/4.0/"),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GPLv3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    ),
    "LGPL-3.0": (
        "Licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.",
        "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
        "SPDX-License-Identifier: MIT",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    "proprietary": ("All rights reserved.", "Unauthorized copying of this file is strictly prohibited.", "Copyright (c) the authors. All rights reserved.", "Proprietary and confidential. No part may be reproduced without prior written consent of the owner."),
}
# Sentences that speak of licences and name none.
OTHERS = (
    "You need a license to drive a car.", "The license plate was missing.", "He lost his fishing license.", "The software license has expired.", "A public hearing was held in general.", "All his rights were read to him.", "The rights of the people are reserved to the states.",
    "Permission was not granted.", "We asked for permission to use the picture.", "Copyright law differs by country.", "The copyright of this picture is not clear.", "Please copy the following conditions.", "She was licensed under the old rules.", "This work is done.", "The terms of the agreement were met.",
    "Version 3 of the program was released.", "Released in May.", "Licensed practitioners only.", "A license may be needed.", "Free of charge and without restriction.", "Distribution of food and its use.", "The Apache people live in the south.", "MIT is a university.", "Commons were held in common.", "The source of the river is not known.", "Any person may obtain a copy of the report.",
)
_WORD = re.compile(r"[a-z0-9]+")
#: Marks of comments, at the begin of a line; lower case, as the text is by then.
MARKS = r"(?m)^[ \t]*(?:(?:/?\*+/?|//+|#+|--+>?|;+|%+|<!--|rem\b|dnl\b)[ \t]*)+"
#: Share of ordinary lines beyond which a word is common, and turns of held-out templates.
COMMON, TURNS = 0.01, 3


def grams(text: str, sizes: tuple[int, ...] = (1, 2, 3)) -> set[str]:
    words = _WORD.findall(text.lower())
    return {" ".join(words[i : i + n]) for n in sizes for i in range(len(words) - n + 1)}


#: What can be a feature.
VOCABULARY = frozenset(g for lines in (*TEMPLATES.values(), OTHERS) for t in lines for g in grams(t))


def features(text: str) -> set[str]:
    return grams(text) & VOCABULARY


class Classifier:
    """Sparse weights by n-gram, an intercept for each class, and a temperature. Class 0 is the unknown one."""

    def __init__(self, ordinary: list[str], seed: int = 7) -> None:
        self.classes = [UNKNOWN, *sorted(TEMPLATES)]
        seen: dict[str, int] = {}
        for line in ordinary:
            for w in grams(line, (1,)):
                seen[w] = seen.get(w, 0) + 1
        self.common = {w for w, n in seen.items() if n > COMMON * len(ordinary)}
        rows = self._rows(ordinary, random.Random(seed))
        logits, truth, weight = [], [], []
        for turn in range(TURNS):
            part = Classifier.__new__(Classifier)
            part.classes, part.common = self.classes, self.common
            part._fit([r for r in rows if r[2] % TURNS != turn])
            held = self._merged([r for r in rows if r[2] % TURNS == turn])
            logits.append(part._matrix([f for f, _, _ in held]) @ part.weights + part.bias)
            truth += [k for _, k, _ in held]
            weight += [n for _, _, n in held]
        logits, truth, weight = np.concatenate(logits), np.array(truth), np.array(weight)
        self.temperature = min((self._loss(logits / t, truth, weight), t) for t in np.geomspace(0.25, 8, 41))[1]
        self._fit(rows)
        self.gate = self._gate(seen)

    def _rows(self, ordinary: list[str], rng: random.Random) -> list[tuple[frozenset, int, int]]:
        """(features, class, turn): each template and sentence also with words left out and ordinary text around."""
        words = [line.split(" ") for line in ordinary] or [[]]
        around = lambda most: rng.choice(words)[: rng.randrange(most)]
        rows = [(line, 0, i) for i, line in enumerate(ordinary)]
        for i, line in enumerate(OTHERS):
            rows += [(line, 0, i)] * 4
            rows += [(" ".join([*around(12), *(w for w in line.split(" ") if rng.random() > 0.1)]), 0, i) for _ in range(20)]
        for k, family in enumerate(self.classes[1:], 1):
            for i, line in enumerate(TEMPLATES[family]):
                rows += [(line, k, i)] * 4
                rows += [(" ".join([*around(9), *(w for w in line.split(" ") if rng.random() > 0.08), *around(9)]), k, i) for _ in range(20)]
        return [(frozenset(g for g in features(t) if not self.common.issuperset(g.split(" "))), k, i) for t, k, i in rows]

    @staticmethod
    def _merged(rows: list[tuple]) -> list[tuple]:
        """Different (features, class) with how often they are there."""
        count: dict[tuple, int] = {}
        for f, k, _ in rows:
            count[f, k] = count.get((f, k), 0) + 1
        return [(f, k, n) for (f, k), n in count.items()]

    def _matrix(self, rows: list[frozenset]) -> np.ndarray:
        index = {g: i for i, g in enumerate(self.names)}
        out = np.zeros((len(rows), len(index)))
        for i, held in enumerate(rows):
            out[i, [index[g] for g in held if g in index]] = 1
        return out

    @staticmethod
    def _loss(logits: np.ndarray, truth: np.ndarray, weight: np.ndarray) -> float:
        logits = logits - logits.max(axis=1, keepdims=True)
        return float(np.average(np.log(np.exp(logits).sum(axis=1)) - logits[np.arange(len(truth)), truth], weights=weight))

    def _fit(self, rows: list[tuple], l1: float = 4e-4, steps: int = 300) -> None:
        """Accelerated proximal gradient steps on the mean log loss plus l1 times the weights' sizes."""
        merged = self._merged(rows)
        count: dict[str, int] = {}
        for held, _, n in merged:
            for g in held:
                count[g] = count.get(g, 0) + n
        self.names = sorted(g for g, n in count.items() if n >= 5)
        x, n = self._matrix([f for f, _, _ in merged]), np.array([n for _, _, n in merged], dtype=float)
        n /= n.sum()
        classes, target = len(self.classes), np.eye(len(self.classes))[[k for _, k, _ in merged]]
        w, b = np.zeros((x.shape[1], classes)), np.zeros(classes)
        vw, vb, t = w, b, 1.0
        rate = 2.0 / (np.linalg.norm(np.column_stack((x, np.ones(len(n)))) * np.sqrt(n)[:, None], 2) ** 2 + 1e-9)
        for _ in range(steps):
            z = x @ vw + vb
            p = np.exp(z - z.max(axis=1, keepdims=True))
            error = (p / p.sum(axis=1, keepdims=True) - target) * n[:, None]
            step = vw - rate * (x.T @ error)
            new_w = np.sign(step) * np.maximum(np.abs(step) - rate * l1, 0)
            new_b = vb - rate * error.sum(axis=0)
            s = (1 + (1 + 4 * t * t) ** 0.5) / 2
            vw, vb, t = new_w + (t - 1) / s * (new_w - w), new_b + (t - 1) / s * (new_b - b), s
            w, b = new_w, new_b
        kept = np.abs(w).max(axis=1) > 0
        self.names, self.weights, self.bias = [g for g, k in zip(self.names, kept) if k], w[kept], b

    def _gate(self, common: dict[str, int]) -> list[str]:
        """Words such that the features without them can't lift any family above the unknown class; rare ones first. An empty one is in every text."""
        gain, need = np.maximum(self.weights[:, 1:] - self.weights[:, :1], 0), self.bias[0] - self.bias[1:]
        if (need <= 1e-6).any():
            return [""]
        held, left, out = [set(n.split(" ")) for n in self.names], np.ones(len(self.names), dtype=bool), []
        while ((total := gain[left].sum(axis=0)) > need - 1e-6).any():
            worst = int((total - need).argmax())
            by: dict[str, float] = {}
            for i in np.flatnonzero(left):
                for w in held[i]:
                    by[w] = by.get(w, 0.0) + gain[i, worst]
            word = max(sorted(by), key=lambda w: by[w] / (1 + common.get(w, 0)))
            out.append(word)
            left &= np.array([word not in h for h in held])
        return out

    def probabilities(self, text: str) -> np.ndarray:
        index = {g: i for i, g in enumerate(self.names)}
        z = (self.bias + sum((self.weights[index[g]] for g in features(text) if g in index), np.zeros(len(self.classes)))) / self.temperature
        p = np.exp(z - z.max())
        return p / p.sum()


def fitted(docs: DataFrame, text: str = "text", sample: int = SAMPLE, chars: int = SAMPLE_CHARS) -> Classifier:
    """Fits on a sample by a hash of the texts; lines that hold a template count as no ordinary ones."""
    rows = some(docs.where(F.col(f"`{text}`").isNotNull()).select(F.substring(F.col(f"`{text}`"), 1, chars).alias("t")), ["t"], sample)
    lines = [line for r in rows.orderBy("_rank").collect() for line in r.t.split("\n") if line.strip()]
    known = [grams(t, (2,)) for lines_ in TEMPLATES.values() for t in lines_]
    return Classifier([line for line in lines if not any(len(k & grams(line, (2,))) >= COVER * len(k) for k in known)])


def scanned(docs: DataFrame, model: Classifier, *, text: str = "text", name: str = "licences", least: float = LEAST, cover: float = COVER) -> DataFrame:
    """docs with an array of the lines predicted to be licences: paragraph (from 0), family, probability, confirmed.

    It is the last column; if its name is taken, it gets an underscore before it.
    """
    (name,) = fresh(docs, name)
    (low,) = fresh(docs, "lower")
    gate = "(?<![a-z0-9])(?:%s)(?![a-z0-9])" % "|".join(map(re.escape, model.gate)) if all(model.gate) else ""
    may = lambda c: c.rlike(gate)
    # literals are folded once, from_json() would be run again for every n-gram
    array = lambda xs: "array(%s)" % ", ".join(xs)
    quoted = lambda xs: array(f"'{x}'" for x in xs)
    weights = F.expr("map(%s)" % ", ".join(f"'{g}', {array(f'{round(float(v), 12)!r}D' for v in w)}" for g, w in zip(model.names, model.weights)))
    templates = F.expr(array(f"named_struct('f', '{f}', 'g', {quoted(sorted(grams(t, (2,))))})" for f, lines in TEMPLATES.items() for t in lines))
    names = F.expr(quoted(model.names))
    classes = F.array(*[F.lit(c) for c in model.classes])
    bias = F.array(*[F.lit(float(b)) for b in model.bias])

    def words(line: Column) -> Column:
        return F.regexp_extract_all(line, F.lit("[a-z0-9]+"), F.lit(0))

    def joined(w: Column, n: int) -> Column:
        """The n-grams, and nulls at the end. slice() copies all words each time, get() doesn't."""
        return F.transform(w, lambda x, i: F.concat(x, *[v for k in range(1, n) for v in (F.lit(" "), F.get(w, i + k))]))

    def logits(w: Column) -> Column:
        held = F.array_intersect(F.concat(w, joined(w, 2), joined(w, 3)), names)
        known = F.transform(held, lambda g: F.element_at(weights, g))
        return F.aggregate(known, bias, lambda a, x: F.zip_with(a, x, lambda p, q: p + q))

    def softmax(z: Column) -> Column:
        raised = let(F.array_max(z), lambda top: F.transform(z, lambda v: F.exp((v - top) / model.temperature)))
        return let(raised, lambda e: let(F.aggregate(e, F.lit(0.0), lambda a, v: a + v), lambda total: F.transform(e, lambda v: v / total)))

    def covered(w: Column, family: Column) -> Column:
        return let(joined(w, 2), lambda two: F.exists(F.filter(templates, lambda t: t["f"] == family), lambda t: F.size(F.array_intersect(two, t["g"])) >= cover * F.size(t["g"])))

    def named(w: Column, p: Column, best: Column, place: Column) -> Column:
        sure = (best >= least) & (F.get(p, F.lit(0)) < best)
        return let(F.element_at(classes, F.array_position(p, best).cast("int")), lambda family: F.when(sure, F.struct(place.alias("paragraph"), family.alias("family"), F.round(best, 6).alias("probability"), covered(w, family).alias("confirmed"))))

    def judged(line: Column, place: Column) -> Column:
        """A struct for a line that is predicted to be of a family, else null."""
        return let(words(line), lambda w: let(let(logits(w), softmax), lambda p: let(F.array_max(p), lambda best: named(w, p, best, place))))

    def newlines(c: Column) -> Column:
        return F.size(F.split(c, "\n")) - 1

    def alone(lines: Column) -> Column:
        """Each line with its number and what it is by itself, or null."""
        return F.transform(lines, lambda s, i: F.struct(s.alias("s"), F.when(may(s), judged(s, i)).alias("x")))

    def together(rest: Column, place: Column) -> Column:
        """What lines are when they are joined, or null."""
        return F.when(F.size(rest) > 1, let(F.array_join(rest, " "), lambda s: F.when(may(s), judged(s, place))))

    def either(lines: Column, whole: Column) -> Column:
        own = F.filter(F.transform(lines, lambda p: p["x"]), lambda x: x.isNotNull())
        others = F.filter(own, lambda x: x["confirmed"] | (x["family"] != whole["family"]))
        counts = whole.isNotNull() & ((F.size(own) == 0) | F.coalesce(whole["confirmed"], F.lit(False)))
        return F.when(counts, F.concat(F.array(whole), others)).otherwise(own)

    def found_in(block: Column) -> Column:
        def whole(lines: Column) -> Column:
            rest = F.filter(lines, lambda p: (F.trim(p["s"]) != "") & ~F.coalesce(p["x"]["confirmed"], F.lit(False)))
            first = (F.trim(F.get(lines, F.lit(0))["s"]) == "").cast("int")  # a text may begin with a line break
            return let(together(F.transform(rest, lambda p: p["s"]), first), lambda w: either(lines, w))

        return F.when(may(block), let(alone(F.split(block, "\n")), whole))

    column = F.col(f"`{low}`")
    between = r"\n\s*\n"

    def near(flags: Column, i: Column) -> Column:
        return F.get(flags, i) | F.coalesce(F.get(flags, i - 1), F.lit(False)) | F.coalesce(F.get(flags, i + 1), F.lit(False))

    def narrowed(lines: Column) -> Column:
        """The text with empty lines in the place of those that are far from any word of the gate."""
        return let(F.transform(lines, lambda s: may(s)), lambda flags: F.array_join(F.transform(lines, lambda s, i: F.when(near(flags, i), s).otherwise("")), "\n"))

    def placed(p: Column, sizes: Column) -> Column:
        before = F.aggregate(F.slice(sizes, F.lit(1), p["j"]), F.lit(0), lambda a, n: a + n)
        return let(before, lambda n: F.transform(p["x"], lambda x: x.withField("paragraph", x["paragraph"] + n)))

    def searched(narrow: Column) -> Column:
        gaps, blocks = F.regexp_extract_all(narrow, F.lit(between), F.lit(0)), F.split(narrow, between)
        parts = F.filter(F.transform(blocks, lambda b, j: F.struct(found_in(b).alias("x"), j.alias("j"))), lambda p: F.size(p["x"]) > 0)
        sizes = F.zip_with(blocks, gaps, lambda b, g: newlines(b) + F.coalesce(newlines(g), F.lit(0)))
        return let(parts, lambda ps: F.when(F.size(ps) > 0, let(sizes, lambda n: F.flatten(F.transform(ps, lambda p: placed(p, n))))))

    found = let(let(F.split(F.regexp_replace(column, MARKS, ""), "\n"), narrowed), searched)
    none = F.array().cast("array<struct<paragraph:int,family:string,probability:double,confirmed:boolean>>")
    out = docs.withColumn(low, F.lower(F.col(f"`{text}`"))).withColumn(name, F.coalesce(F.when(may(column), found), none))
    return out.drop(low)

