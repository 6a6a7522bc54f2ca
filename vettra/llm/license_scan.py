"""Operator 9, licence scans: a trained paragraph classifier in built-in functions.

Paragraphs end at a line without letters or digits and at a line that closes a sentence;
other line breaks are wraps, so that a notice wrapped at any column is one paragraph and
comment marks before its lines do not matter. A paragraph's features are the distinct
words and word pairs that the model knows. The model is a softmax regression over licence
families and an ``unknown`` class, trained in numpy on the notices below, with words
dropped and filled in, against sentences that use the same words otherwise. A family counts
if its probability reaches a threshold, and if the paragraph agrees with one of the
family's notices: AGREEMENT of the shorter one's words and pairs are in the other. The
threshold is the least, from 0.5 on, that no sentence of HELD_OTHERS reaches; neither these
nor HELD_NOTICES are trained on.

Weights are whole numbers (WEIGHT_UNIT parts of one), so that sums do not depend on their
order. They come as literals of at most MAX_FEATURES rows, and a document is scored within
its row: nothing is shuffled or joined. A paragraph without any known word has no features
and is ``unknown`` to the model; an array overlap tells such paragraphs apart first.

Defined results: null or empty text has no paragraph and no licence; repeated rows repeat
their result; null ids are kept; of equal probabilities the family first in order wins; an
empty table gives an empty result; texts of any length are scanned whole; other columns are
ignored (op9) or kept (scan).
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vettra.llm.common import LOWER, UPPER, table

#: Customary notices of each family.
NOTICES = {
    "agpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "Licensed under the GNU Affero General Public License, version 3.",
        "Released under the AGPL.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
        "Released under the Apache License 2.0.",
        "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Released under the BSD 3-Clause License.",
        "Licensed under the BSD License.",
        "Use of this source code is governed by a BSD-style license.",
    ],
    "cc0": [
        "This work is dedicated to the public domain under CC0 1.0.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0.",
        "CC0 1.0 Universal Public Domain Dedication.",
    ],
    "cc-by": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "This article is distributed under the terms of the Creative Commons Attribution License, which permits unrestricted use and distribution.",
    ],
    "cc-by-nc": [
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
        "Licensed under CC BY-NC-SA 4.0.",
        "Creative Commons Attribution-NonCommercial-ShareAlike License.",
    ],
    "cc-by-sa": [
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
        "Text is available under the Creative Commons Attribution-ShareAlike License.",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "Released under the GPL version 2 or later.",
        "Licensed under GPLv3.",
        "Licensed under the GPL.",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "Licensed under the GNU Lesser General Public License, version 3.",
        "Released under the LGPL.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
    ],
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License 2.0.",
        "If a copy of the MPL was not distributed with this file, you can obtain one at http://mozilla.org/MPL/2.0/.",
        "Released under the MPL.",
    ],
    "proprietary": [
        "All rights reserved.",
        "All rights reserved. Unauthorized copying of this file, via any medium, is strictly prohibited.",
        "This software is proprietary and confidential; no part of it may be reproduced or distributed without prior written permission.",
    ],
}
#: Notices that are never trained on, for measuring recall.
HELD_NOTICES = {
    "agpl": ["This server is licensed under the GNU Affero General Public License version 3 or later."],
    "apache": ["This project is licensed under the terms of the Apache License 2.0.", "Code in this folder is released under the Apache License, Version 2.0, see the file LICENSE."],
    "bsd": ["This project is licensed under the BSD 3-Clause License, see LICENSE.", "Source code here is governed by a BSD-style license found in the LICENSE file."],
    "cc0": ["The author has waived all copyright and related rights to this data under CC0 1.0."],
    "cc-by": ["Photos are licensed under a Creative Commons Attribution 4.0 License.", "Figures: licensed under CC BY 4.0."],
    "cc-by-nc": ["These slides are licensed under CC BY-NC 4.0.", "The book is licensed under a Creative Commons Attribution-NonCommercial License."],
    "cc-by-sa": ["All articles are available under the Creative Commons Attribution-ShareAlike 4.0 License.", "Documentation is licensed under CC BY-SA 4.0."],
    "gpl": ["This tool is released under the GNU General Public License, version 2.", "The module is licensed under the GPL version 3 or later."],
    "lgpl": ["This package is licensed under the GNU Lesser General Public License, version 2.1."],
    "mit": ["This project is licensed under the terms of the MIT license.", "Code released under the MIT License, see LICENSE."],
    "mpl": ["This project is licensed under the Mozilla Public License, version 2.0."],
    "proprietary": ["Copyright 2021 by the publisher, all rights reserved.", "This document is proprietary and confidential and may not be distributed without prior written permission."],
}
#: Sentences that are no licence.
OTHERS = [
    "The driver had no valid license and was fined by the police.", "He was released under the condition that he report weekly.",
    "Students at the institute study software and general relativity.", "The public library is free and open to any person.",
    "The board granted permission to build a new school in the city.", "This version of the story was published by the foundation later.",
    "They use the source of the river without restriction.", "The terms of the agreement were modified in writing.",
    "A copy of the letter was distributed to all members.", "All kinds of conditions apply to the use of public land.",
    "You may obtain tickets at the door.", "The work is under way and the following people may help.",
    "Commons members spoke about attribution of the painting.", "The apache helicopter landed near the village.",
    "The license plate of the car was new.", "Any later date is subject to change.", "The software company reserved a room for the meeting.",
    "Creative people share their work at international fairs.", "The binary star and its source of light.",
    "MIT is a university in Massachusetts.", "He studied at MIT and released a paper on binary stars.",
    "The bishop holds all rights over the land.", "Civil rights were reserved to the states by law.",
    "A fishing license is required by law, and you may obtain one at the office.", "The public domain of Rome grew after the war.",
    "The Mozilla company published a new version of its browser.", "The GNU project began in 1983.",
]
#: Sentences that are no licence and are never trained on; they set the threshold.
HELD_OTHERS = [
    "Her driving license was issued under the old rules.", "The prisoners were released under a general pardon.",
    "The hotel reserved all rooms for the conference.", "Public servants may not copy confidential files.",
    "A professor of MIT spoke about free software at the public library.", "The Apache people lived in the south west.",
    "The commission granted the station a license to broadcast.", "Permission to land was granted without conditions.",
    "Creative work in the commons of the village.", "The foundation published the terms of the prize.",
    "He sold copies of the book to any person who asked.", "The general asked for a later version of the map.",
    "The source of the river is in the public forest.", "The lesser known works of the author are in the archive.",
]
STOP = frozenset("a an and any are as at be by can for from have in is it its no not of on or so that the their they this to under was were will with you your".split())
UNKNOWN = "unknown"
MAX_FEATURES = 4000
COPIES = 24
AGREEMENT = 0.6
WEIGHT_UNIT = 100_000
SPLIT = "[^a-z0-9]+"
#: A line that closes a sentence ends its paragraph, as if a blank line came after it.
CLOSING = r"([.!?。！？][\"')\]]*)[ \t\r]*\n"
BREAK = r"\n[^\p{L}\p{N}]*\n"


def words_of(text: str) -> list[str]:
    return [w for w in re.split(SPLIT, text.translate(str.maketrans(UPPER, LOWER))) if w]


def grams_of(words: list[str]) -> set[str]:
    """Words and pairs with at least one word that isn't a stop word."""
    pairs = {f"{a} {b}" for a, b in zip(words, words[1:], strict=False) if a not in STOP or b not in STOP}
    return {w for w in words if w not in STOP} | pairs


class LicenceModel:
    """weights (features x families) and bias are whole numbers of 1 / WEIGHT_UNIT."""

    def __init__(self, families: list[str], features: list[str], weights: np.ndarray, bias: np.ndarray, threshold: float):
        self.families, self.features, self.weights, self.bias, self.threshold = families, features, weights, bias, threshold
        self.templates = [(f, sorted(grams_of(words_of(t)))) for f in sorted(NOTICES) for t in NOTICES[f]]

    def probabilities(self, grams: set[str]) -> np.ndarray:
        at = [i for i, g in enumerate(self.features) if g in grams]
        z = (self.bias + self.weights[at].sum(axis=0)) / WEIGHT_UNIT
        e = np.exp(z - z.max())
        return e / e.sum()


@lru_cache(maxsize=1)
def trained(seed: int = 11) -> LicenceModel:
    """Full-batch gradient steps on varied notices; deterministic, and small enough for the driver."""
    rng = np.random.default_rng(seed)
    families = [*sorted(NOTICES), UNKNOWN]
    vocabulary = sorted({w for texts in NOTICES.values() for t in texts for w in words_of(t)})

    def vary(words: list[str]) -> list[str]:
        kept = [w for w in words if rng.random() > 0.1] or words
        for _ in range(rng.integers(0, 4)):
            kept.insert(int(rng.integers(0, len(kept) + 1)), str(rng.choice(["copyright", "2024", "c", "project", "authors", "file", "data"])))
        return kept

    train = [(grams_of(vary(words_of(t))), families.index(f)) for f in NOTICES for t in NOTICES[f] for _ in range(COPIES)]
    train += [(grams_of(vary(words_of(t))), len(families) - 1) for t in OTHERS for _ in range(COPIES)]
    # loose words of notices are no notice
    train += [(grams_of([str(w) for w in rng.choice(vocabulary, rng.integers(1, 6))]), len(families) - 1) for _ in range(20 * COPIES)]
    features = sorted({g for texts in [*NOTICES.values(), OTHERS] for t in texts for g in grams_of(words_of(t))})
    if len(features) > MAX_FEATURES:
        raise ValueError("too many features for literals")
    place = {x: i for i, x in enumerate(features)}
    x, y = np.zeros((len(train), len(place)), np.float32), np.eye(len(families), dtype=np.float32)[[c for _, c in train]]
    for row, (g, _) in zip(x, train, strict=True):
        row[[place[w] for w in g if w in place]] = 1
    w, b = np.zeros((len(place), len(families)), np.float32), np.zeros(len(families), np.float32)
    for _ in range(150):
        z = x @ w + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        g = (p - y) / len(x)
        w -= 8.0 * (x.T @ g + 1e-5 * w)
        b -= 8.0 * g.sum(axis=0)
    whole = lambda v: np.round(v.astype(float) * WEIGHT_UNIT).astype(np.int64)
    model = LicenceModel(families, features, whole(w), whole(b), 0.5)
    wrong = [float(model.probabilities(grams_of(words_of(t)))[:-1].max()) for t in HELD_OTHERS]
    model.threshold = round(min(0.9, max(0.5, max(wrong) + 0.01)), 3)
    return model


def strings(values: list[str]) -> Column:
    """A literal array, folded from one string: quicker to plan than a literal for each value."""
    return F.split(F.lit("\n".join(values)), "\n")


def folded(value: object, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(value)), kind)


def grams(words: Column) -> Column:
    """Distinct words and pairs of a paragraph, without those of stop words alone."""
    stop = strings(sorted(STOP))
    size = F.greatest(F.size(words) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(words, 1, size), F.slice(words, 2, size), lambda a, b: F.when(~F.array_contains(stop, a) | ~F.array_contains(stop, b), F.concat_ws(" ", a, b)))
    return F.array_compact(F.array_distinct(F.concat(F.filter(words, lambda w: ~F.array_contains(stop, w)), pairs)))


def paragraphs(text: Column) -> Column:
    """The paragraphs that hold a letter or a digit."""
    parts = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), CLOSING, "$1\n\n"), BREAK, -1)
    return F.filter(parts, lambda p: p.rlike(r"[\p{L}\p{N}]"))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """(row, n_paragraphs, licences): each row as a struct with its confirmed paragraphs, (paragraph, family, probability, agreement) each; paragraphs count from 0."""
    model = trained()
    known, n = strings(model.features), len(model.families)
    cues = strings(sorted({w for f in model.features for w in f.split()} - STOP))
    weights, bias = folded(model.weights.tolist(), "array<array<bigint>>"), folded(model.bias.tolist(), "array<bigint>")
    templates = folded([{"family": f, "grams": g} for f, g in model.templates], "array<struct<family: string, grams: array<string>>>")

    # each step reads the column before it once, so that no step is evaluated twice
    out = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"), paragraphs(docs[f"`{text}`"]).alias("parts"))
    # words are ASCII once they are cut out, so that lower() is exact
    worded = F.transform("parts", lambda p, i: F.struct(i.alias("paragraph"), F.transform(F.regexp_extract_all(p, F.lit("([A-Za-z0-9]+)")), F.lower).alias("words")))
    out = out.select("row", F.size("parts").cast("long").alias("n_paragraphs"), F.filter(worded, lambda s: F.arrays_overlap(s["words"], cues)).alias("asked"))
    out = out.select("row", "n_paragraphs", F.transform("asked", lambda s: F.struct(s["paragraph"].alias("paragraph"), grams(s["words"]).alias("grams"))).alias("asked"))
    out = out.select("row", "n_paragraphs", F.transform("asked", lambda s: F.struct(s["paragraph"].alias("paragraph"), F.size(s["grams"]).alias("n"), F.array_intersect(s["grams"], known).alias("grams"))).alias("asked"))

    def logits(found: Column) -> Column:
        plus = lambda z, g: F.zip_with(z, F.element_at(weights, F.array_position(known, g).cast("int")), lambda a, b: a + b)
        return F.aggregate(found, bias, plus)

    out = out.select("row", "n_paragraphs", F.transform("asked", lambda s: F.struct(s["paragraph"].alias("paragraph"), s["n"].alias("n"), s["grams"].alias("grams"), logits(s["grams"]).alias("z"))).alias("asked"))
    likely = lambda z: 1 / F.aggregate(z, F.lit(0.0), lambda a, v: a + F.exp((v - F.array_max(z)) / WEIGHT_UNIT))
    family = lambda z: F.element_at(strings(model.families), F.array_position(z, F.array_max(z)).cast("int"))
    # most paragraphs are unknown: they go before any probability is asked for
    out = out.select("row", "n_paragraphs", F.filter("asked", lambda s: F.element_at(s["z"], n) < F.array_max(s["z"])).alias("asked"))
    named = F.transform("asked", lambda s: F.struct(s["paragraph"].alias("paragraph"), s["n"].alias("n"), s["grams"].alias("grams"), family(s["z"]).alias("family"), likely(s["z"]).alias("probability")))
    out = out.select("row", "n_paragraphs", F.filter(named, lambda s: s["probability"] >= model.threshold).alias("asked"))

    def agreement(s: Column) -> Column:
        mine = F.filter(templates, lambda t: t["family"] == s["family"])
        return F.array_max(F.transform(mine, lambda t: F.size(F.array_intersect(t["grams"], s["grams"])) / F.least(s["n"], F.size(t["grams"]))))

    compared = F.transform("asked", lambda s: F.struct(s["paragraph"].alias("paragraph"), s["family"].alias("family"), s["probability"].alias("probability"), agreement(s).alias("agreement")))
    return out.select("row", "n_paragraphs", F.filter(compared, lambda s: s["agreement"] >= AGREEMENT).alias("licences"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_paragraphs, n_licences, families) of every document; families are sorted and comma-joined."""
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    families = F.array_join(F.array_sort(F.array_distinct(F.col("licences.family"))), ",")
    return found.select("row.doc_id", "n_paragraphs", F.size("licences").cast("long").alias("n_licences"), families.alias("families"))


def oracle_sql() -> str:
    model = trained()
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    n = len(model.families)
    weights = ", ".join(f"({quote(f)}, [{', '.join(map(str, row))}]::BIGINT[])" for f, row in zip(model.features, model.weights.tolist(), strict=True))
    notices = ", ".join(f"({quote(f)}, [{', '.join(map(quote, g))}])" for f, g in model.templates)
    stop = f"[{', '.join(map(quote, sorted(STOP)))}]"
    closing, split = (quote(x.replace("\\n", "\n")) for x in (CLOSING, BREAK))
    return f"""
WITH weights(gram, w) AS (VALUES {weights}), notices(family, notice) AS (VALUES {notices}),
docs AS (SELECT row_number() OVER () AS rn, doc_id,
    list_filter(regexp_split_to_array(regexp_replace(coalesce(text, ''), {closing}, '\\1' || chr(10) || chr(10), 'g'), {split}), lambda p: regexp_matches(p, '[\\p{{L}}\\p{{N}}]')) AS ps FROM documents),
parts AS (SELECT rn, unnest(ps) AS paragraph, unnest(range(len(ps))) AS i FROM docs),
worded AS (SELECT rn, i, list_filter(regexp_split_to_array(translate(paragraph, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{SPLIT}'), lambda w: w <> '') AS ws FROM parts),
grams AS (SELECT rn, i, list_distinct(list_concat(list_filter(ws, lambda w: NOT list_contains({stop}, w)),
    list_transform(list_filter(range(1, len(ws)), lambda i: NOT (list_contains({stop}, ws[i]) AND list_contains({stop}, ws[i + 1]))), lambda i: ws[i] || ' ' || ws[i + 1]))) AS gs FROM worded),
scored AS (SELECT rn, i, {', '.join(f'sum(w[{k + 1}]) + ({int(model.bias[k])}) AS z{k}' for k in range(n))}
    FROM (SELECT rn, i, unnest(gs) AS gram FROM grams) JOIN weights USING (gram) GROUP BY rn, i),
arrays AS (SELECT rn, i, [{', '.join(f'z{k}' for k in range(n))}] AS z FROM scored),
top AS (SELECT rn, i, [{', '.join(map(quote, model.families))}][list_position(z, list_max(z))] AS family,
    1 / list_sum(list_transform(z, lambda v: exp((v - list_max(z))::DOUBLE / {WEIGHT_UNIT}))) AS p FROM arrays),
best AS (SELECT rn, i, family, max(len(list_intersect(gs, notice))::DOUBLE / least(len(gs), len(notice))) AS agreement
    FROM top JOIN grams USING (rn, i) JOIN notices USING (family)
    WHERE family <> '{UNKNOWN}' AND p >= {model.threshold!r} GROUP BY rn, i, family),
found AS (SELECT rn, count(*) AS n, string_agg(DISTINCT family, ',' ORDER BY family) AS families FROM best WHERE agreement >= {AGREEMENT} GROUP BY rn)
SELECT doc_id, len(ps)::BIGINT AS n_paragraphs, coalesce(n, 0)::BIGINT AS n_licences, coalesce(families, '') AS families FROM docs LEFT JOIN found USING (rn)
"""
