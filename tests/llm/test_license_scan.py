import random
import re

import numpy as np
import pytest

from docugauge.llm import license_scan as L

ORDINARY = ["the quick brown fox jumps over the lazy dog", "and all of them went to the public house", "version three of the story was longer", "general remarks on the art of writing", "it is licensed to thrill"] * 4


@pytest.fixture(scope="module")
def model():
    return L.Classifier(ORDINARY)


def test_held_out_variants(model):
    right = 0
    tried = [(t, f) for f, lines in L.TEMPLATES.items() for t in lines]
    for text, family in tried:
        p = model.probabilities(f"Note: {text} Thanks")
        right += model.classes[int(np.argmax(p))] == family
    assert right / len(tried) > 0.9
    wrong = sum(model.probabilities(t).argmax() != 0 for t in L.OTHERS)
    assert wrong <= 2 and (model.weights == 0).mean() > 0.3


def test_frame_like_the_model_and_defined_cases(spark, model):
    texts = ["x\nReleased under the MIT License.\n\nAll rights reserved.", "You need a license to drive.", None, "", "Licensed under CC BY-NC 4.0.", "LICENSED UNDER THE APACHE LICENSE, VERSION 2.0.", "w " * 5000, "Licensed under CC BY-NC 4.0."]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id int, text string, lower string").coalesce(1)
    rows = L.scanned(df, model).collect()
    found = [[(x.paragraph, x.family, x.confirmed) for x in r.licences] for r in rows]
    assert found[0] == [(1, "MIT", True), (3, "proprietary", True)] and found[1] == found[2] == found[3] == found[6] == []
    assert found[4] == found[7] == [(0, "CC-BY-NC-4.0", True)] and found[5] == [(0, "Apache-2.0", True)] and rows[0].lower == "clash"
    for r, t in ((rows[0].licences[0], "Released under the MIT License."), (rows[4].licences[0], texts[4])):
        assert r.probability == pytest.approx(model.probabilities(t).max(), abs=1e-6)
    assert L.scanned(df.limit(0), model).count() == 0
    plan = L.scanned(df, model)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "Exchange"))


def test_a_prediction_without_its_template_is_not_confirmed(spark, model):
    df = spark.createDataFrame([("mit license released mit license under mit",)], "text string")
    assert all(not x.confirmed for x in L.scanned(df, model, least=0.1).first().licences)


def test_fitting_leaves_licences_out(spark):
    docs = spark.createDataFrame([(i, f"plain line {i}\nReleased under the MIT License.") for i in range(20)] + [(99, None)], "doc_id int, text string")
    model = L.fitted(docs, sample=10)
    assert model.classes[int(model.probabilities("Released under the MIT License.").argmax())] == "MIT"


WRAPPED = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software\ndistributed under the License is distributed on an \"AS IS\" BASIS,\nWITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "LGPL-3.0": "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 3 of the License, or (at your option) any later version.",
}


@pytest.mark.parametrize("mark", ["", "# ", "// ", " * ", "-- ", "; "])
def test_wrapped_headers_are_confirmed(spark, model, mark):
    marked = lambda t: "\n".join((mark + x).rstrip() for x in t.split("\n"))
    texts = [f"first line\n \n\n{marked(t)}\n\nlast line\nReleased under the MIT License." for t in WRAPPED.values()]
    rows = L.scanned(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string").coalesce(1), model).orderBy("doc_id").collect()
    for r, (family, t) in zip(rows, WRAPPED.items()):
        got = [(x.paragraph, x.family) for x in r.licences if x.confirmed]
        assert got[0] == (3, family) and got[-1] == (3 + t.count("\n") + 3, "MIT") and {f for _, f in got[:-1]} == {family}, (family, r.licences)


#: Wordings that no template has.
UNSEEN = [
    ("Apache-2.0", "This project is made available under the Apache 2.0 license, see the LICENSE file."), ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"), ("Apache-2.0", "The code is distributed under the terms of the Apache License version 2."),
    ("MIT", "This package is distributed under the terms of the MIT license."), ("MIT", "The MIT License applies to this software."), ("MIT", "MIT licensed, free to use and copy."),
    ("BSD-3-Clause", "Distributed under the three clause BSD license."), ("BSD-3-Clause", "This code is covered by the BSD 3-Clause license text below."), ("GPL-3.0", "You may use this program under the GNU General Public License version 3 or later."), ("GPL-3.0", "Released under the GPLv3."),
    ("LGPL-3.0", "This library is covered by the GNU Lesser General Public License."), ("MPL-2.0", "This file is under the Mozilla Public License, version 2.0."), ("MPL-2.0", "Available under the terms of the Mozilla Public License."),
    ("CC-BY-4.0", "The text is available under CC BY 4.0"), ("CC-BY-4.0", "Published under a Creative Commons Attribution 4.0 license."), ("CC-BY-SA-4.0", "Content is shared under CC BY-SA 4.0 terms."), ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 applies."), ("CC-BY-NC-4.0", "Images: Creative Commons Attribution-NonCommercial 4.0"),
    ("proprietary", "Copyright (c) 2021 Example Corp. All rights reserved."), ("proprietary", "Unauthorized copying of this document is prohibited."),
    *[("unknown", t) for t in ("He got his driving license in public.", "The public library lent a copy of the file.", "All the conditions were met without notice.", "She reserved a table for four.", "The program was written above the source of the river.", "You may copy the following list of names.", "A general of the free army spoke.", "They released a version of the song in May.", "Her permission was not needed at all.", "The names of contributors are listed below.", "A library is free to all persons.", "Apache helicopters flew over the desert.", "The MIT professor gave a lecture.", "He bought 4 copies and sold 2 of them.", "Nothing in particular was agreed to in writing.")],
]


def test_unseen_wordings(model):
    found = [(f, model.classes[int(np.argmax(p))] if (p := model.probabilities(t)).max() >= L.LEAST else "unknown") for f, t in UNSEEN]
    predicted = [(f, g) for f, g in found if g != "unknown"]
    precision = sum(f == g for f, g in predicted) / len(predicted)
    recall = sum(f == g for f, g in found if f != "unknown") / sum(f != "unknown" for f, _ in found)
    print(f"precision {precision:.2f}, recall {recall:.2f}")
    assert precision >= 0.8 and recall >= 0.75, [(x, t) for x, (_, t) in zip(found, UNSEEN) if x[0] != x[1]]


def brute(text, model):
    """What the docstring says, in plain Python."""
    words = lambda t: re.findall("[a-z0-9]+", t)

    def judged(line, place):
        p = model.probabilities(line)
        k = int(p.argmax())
        if not k or p[k] < L.LEAST:
            return None
        family, two = model.classes[k], L.grams(line, (2,))
        sure = any(len(g & two) >= L.COVER * len(g) for g in (L.grams(t, (2,)) for t in L.TEMPLATES[family]))
        return (place, family, round(float(p[k]), 5), sure)

    if text is None:
        return []
    lines = re.sub(L.MARKS, "", text.lower()).split("\n")
    gated = [any(w in words(x) for w in model.gate) for x in lines]
    kept = [x if any(gated[max(0, i - 1) : i + 2]) else "" for i, x in enumerate(lines)]
    out, i = [], 0
    while i < len(kept):
        j = i
        while j < len(kept) and kept[j].strip():
            j += 1
        run = [(n, judged(kept[n], n) if gated[n] else None) for n in range(i, j)]
        own = [x for _, x in run if x]
        rest = [kept[n] for n, x in run if not (x and x[3])]
        whole = judged(" ".join(rest), i) if len(rest) > 1 and any(any(w in words(r) for w in model.gate) for r in rest) else None
        if whole and (not own or whole[3]):
            own = [whole, *(x for x in own if x[3] or x[1] != whole[1])]
        out += own
        i = j + 1
    return out


def test_like_brute_force(spark, model):
    rng = random.Random(9)
    pool = [x for t in WRAPPED.values() for x in t.split("\n")] + [t for _, t in UNSEEN] + [t for ts in L.TEMPLATES.values() for t in ts] + ORDINARY[:5] + ["", " ", "", "// ", "#"]
    texts = []
    for _ in range(250):
        lines = [rng.choice(pool) for _ in range(rng.randrange(1, 12))]
        if rng.random() < 0.4:
            lines[1:1] = rng.choice(list(WRAPPED.values())).split("\n")
        texts.append("\n".join(rng.choice(["", "", "# ", "  * ", "//"]) + x for x in lines))
    texts += [None, "", "\n\n", "\n" + WRAPPED["MIT"], "Released under the MIT License." * 3, "é\nALL RIGHTS RESERVED.\n\n\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").coalesce(2)
    got = {r.doc_id: [(x.paragraph, x.family, round(x.probability, 5), x.confirmed) for x in r.licences] for r in L.scanned(df, model).collect()}
    found = 0
    for i, t in enumerate(texts):
        want = brute(t, model)
        found += len(want)
        assert [x[:2] + x[3:] for x in got[i]] == [x[:2] + x[3:] for x in want] and all(abs(a[2] - b[2]) < 1e-4 for a, b in zip(got[i], want)), (t, got[i], want)
    assert found > 200


def test_the_gate_hides_nothing(spark, model):
    lines = ["Available under CC BY 4.0", "distributed under the terms of the GNU GPL version 3", "the software is provided as is", "Creative Commons Attribution 4.0 International", "Mozilla Public, v. 2.0", *ORDINARY[:5], *L.OTHERS]
    want = {t: p for t in lines if (p := model.probabilities(t)).argmax() and p.max() >= L.LEAST}
    got = {r.text: r.licences for r in L.scanned(spark.createDataFrame([(t,) for t in lines], "text string").coalesce(1), model).collect()}
    assert {t for t, x in got.items() if x} == set(want) and "Available under CC BY 4.0" in want
