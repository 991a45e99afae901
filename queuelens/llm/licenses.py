"""Licence scan: a trained paragraph classifier in SQL, confirmed by comparison with templates.

A multinomial logistic regression over sparse word n-grams is fitted in the driver to
templates of licence notices, varied, and to ordinary paragraphs of the corpus. Its
weights are a small table; scanning is joins and aggregates of DataFrames only. Every
paragraph is looked at; joined are those that by a bound on their scores can state a licence.
A paragraph is a line of the text.
"""

import json
import re
import zlib
from collections import Counter
from dataclasses import dataclass
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from queuelens.llm.common import least_places, whole_text

#: Ordinary paragraphs of the corpus the model is fitted to at most, and variants of each template.
FIT_PARAGRAPHS, VARIANTS = 600, 12
#: Share of n-grams that a paragraph and a template of its family must have in common.
CONFIRMED = 0.5
NONE, UNKNOWN = "none", "unknown"
#: A word, in lower case; the same in Java and Python.
WORD = "[a-z0-9]+(?:[.+-][a-z0-9]+)*"

# Usual notices of common licences.
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS',
        "SPDX-License-Identifier: Apache-2.0",
        "Apache-2.0 license",
    ],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "Released under the GNU GPL v3.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "gpl-2.0": [
        "Licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License",
        "SPDX-License-Identifier: GPL-2.0-only",
    ],
    "lgpl": [
        "Licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "agpl-3.0": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "mit": [
        "Released under the MIT License.",
        "MIT licence",
        "This project is licensed under the terms of the MIT license.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
        "Permission is hereby granted, free of charge, to any person obtaining a copy",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
    ],
    "bsd": [
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Released under the 2-clause BSD license.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC-SA 4.0.",
    ],
    "cc-by-nd": [
        "Licensed under CC BY-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
        "CC Attribution-NoDerivatives 4.0",
    ],
    "cc0": [
        "To the extent possible under law, the author has waived all copyright and related rights to this work.",
        "Released under CC0 1.0 Universal, public domain dedication.",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        "Released under the ISC License.",
    ],
    "proprietary": [
        "All rights reserved. Unauthorized copying of this file, via any medium, is strictly prohibited.",
        "Proprietary and confidential. No part of this document may be reproduced without prior written permission.",
        "Copyright 2020 Example Company. All rights reserved.",
        "Copyright Example. All rights reserved.",
        "All rights reserved.",
    ],
    UNKNOWN: [
        "Licensed under the Sample Community License, version 7.",
        "This work is released under the terms of a custom licence agreement.",
        "Distributed under the License described in the accompanying file.",
        "Licensed under the Example License 2.1.",
        "Released under the Sample Public Licence, version 1.2",
        "See the license terms before use.",
        "The software is provided as is, without warranty of any kind.",
    ],
}

#: Sentences that speak of licences, rights and copies and state none.
ORDINARY = [
    "A driver needs a license to drive.",
    "She renewed her fishing license last spring.",
    "The court upheld the copyright claim.",
    "Free software is used by many public offices.",
    "All of the rooms were reserved for the guests.",
    "Permission to land was granted by the tower.",
    "The author has written three books on public law.",
    "He copied the files to another machine without a word.",
]

#: Words that may state a licence by themselves.
STATING = {"license", "licensed", "licence", "copyright", "copying", "reserved", "spdx-license-identifier"}


def words_of(text: str) -> list[str]:
    return re.findall(WORD, text.lower())


def grams_of(words: list[str]) -> set[str]:
    """Distinct words and pairs of neighbouring words."""
    return {*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))}


@dataclass
class Model:
    families: list[str]
    weights: dict[str, list[float]]  # by n-gram, one per family
    bias: list[float]
    foreign: list[float]  # weight of the share of n-grams that are not in the model
    least: float  # probability from which a family is named

    def probabilities(self, text: str) -> np.ndarray:
        """The plain version of ``scan``'s scores, for one paragraph."""
        grams = grams_of(words_of(text))
        known = [self.weights[g] for g in grams if g in self.weights]
        z = np.array(self.bias) + np.sum(known, axis=0) / np.sqrt(max(1, len(grams))) if known else np.array(self.bias)
        z = z + np.array(self.foreign) * (len(grams) - len(known)) / max(1, len(grams))
        e = np.exp(z - z.max())
        return e / e.sum()


def _varied(text: str, r: np.random.Generator, filler: list[str]) -> str:
    """A template with words left out, cut short, or with other words around it."""
    words = text.split()
    if len(words) > 6 and r.random() < 0.4:
        words = words[: int(r.integers(len(words) // 2, len(words)))]
    words = [w for w in words if r.random() > 0.06] or words
    if filler and r.random() < 0.4:
        extra = [filler[int(i)] for i in r.integers(0, len(filler), int(r.integers(1, 8)))]
        words = [*extra, *words] if r.random() < 0.5 else [*words, *extra]
    return " ".join(words)


def fit(ordinary: list[str], rounds: int = 200, decay: float = 2e-4, seed: int = 4) -> Model:
    """Weights by gradient descent on the templates' variants and the ordinary paragraphs.

    Temperature and least probability are set on a fifth of the examples that is left out of
    the fit: the temperature by likelihood, the least probability so that what is named
    there by a known family is right at least 99 times in 100. Below it a paragraph is of no known family.
    """
    r = np.random.default_rng(seed)
    families = [NONE, *TEMPLATES]
    filler = [w for p in ordinary[:200] for w in p.split()[:20]]
    # Short ordinary lines; words and pairs that notices of several families share say nothing, nor with an ordinary word.
    users = Counter(g for texts in TEMPLATES.values() for g in {g for t in texts for g in grams_of(words_of(t))})
    common = sorted(g for g, n in users.items() if n > 1 and STATING.isdisjoint(g.split()))
    common += [f"{g} {filler[int(r.integers(len(filler)))]}" for g in common if filler]
    pieces = [" ".join(p.split()[k : k + n]) for p in ordinary for n in (1, 2, 4) for k in [int(r.integers(0, max(1, len(p.split()) - n)))]]
    pieces = [p for p in pieces if not matches(p)]
    examples = [(p, 0) for p in [*ordinary, *pieces, *ORDINARY * 3, *common]] + [("", 0)] * 5
    for k, texts in enumerate(TEMPLATES.values(), 1):
        for text in texts:
            examples += [(text, k)] * 3 + [(_varied(text, r, filler), k) for _ in range(VARIANTS)]
    vocabulary = sorted(set().union(*(grams_of(words_of(t)) for texts in TEMPLATES.values() for t in texts)))
    place = {g: i for i, g in enumerate(vocabulary)}
    x = np.zeros((len(examples), len(vocabulary) + 2))
    for row, (text, _) in enumerate(examples):
        grams = grams_of(words_of(text))
        known = [place[g] for g in grams if g in place]
        x[row, known] = 1 / np.sqrt(max(1, len(grams)))
        x[row, -2:] = (len(grams) - len(known)) / max(1, len(grams)), 1
    y = np.array([k for _, k in examples])
    held = r.random(len(y)) < 0.2
    gold = np.eye(len(families))[y]
    w = np.zeros((x.shape[1], len(families)))
    speed = np.zeros_like(w)
    for _ in range(rounds):
        z = x[~held] @ w
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        speed = 0.9 * speed - (x[~held].T @ (p - gold[~held]) / (~held).sum() + decay * w)
        w += 2.0 * speed

    def chances(t: float) -> np.ndarray:
        z = x[held] @ w / t
        p = np.exp(z - z.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    rows = np.arange(int(held.sum()))
    t = min((0.5, 0.7, 0.85, 1.0, 1.2, 1.5, 2.0), key=lambda t: -np.log(chances(t)[rows, y[held]] + 1e-12).sum())
    p = chances(t)
    best, right = p.max(1), p.argmax(1) == y[held]
    named = (p.argmax(1) > 0) & (p.argmax(1) != families.index(UNKNOWN))
    least = next((c for c in np.arange(0.3, 0.95, 0.05) if right[(best >= c) & named].mean() >= 0.99), 0.95)
    w /= t
    return Model(families, dict(zip(vocabulary, w[:-2].tolist())), w[-1].tolist(), w[-2].tolist(), float(least))


def _paragraphs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(whole_text(text_col), "\n")).alias("paragraph", "line"))


@cache
def _own() -> dict[str, list[str]]:
    """For each family the n-grams of its templates that at most three families use, and none of the unknown ones."""
    grams = {family: set().union(*(grams_of(words_of(t)) for t in texts)) for family, texts in TEMPLATES.items()}
    users: dict[str, int] = {}
    for found in grams.values():
        for g in found:
            users[g] = users.get(g, 0) + 1
    return {f: sorted(g for g in found - grams[UNKNOWN] if users[g] <= 3 and re.search("[a-z]{3}|[a-z]-[a-z]", g)) for f, found in grams.items()}


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model fitted with up to ``FIT_PARAGRAPHS`` ordinary paragraphs: whole, those with the least hash that match no template."""
    lines = _paragraphs(docs, id_col, text_col).filter(F.length(F.trim("line")) > 0)
    some = least_places(lines.select("line", F.xxhash64("line").alias("place")), "place", FIT_PARAGRAPHS, "line").collect()
    return fit([row["line"] for row in some if not matches(row["line"])])


def matches(text: str) -> bool:
    """Whether ``scan`` would confirm a paragraph of that family, or it shares ``CONFIRMED`` of an unknown licence's n-grams."""
    grams, own = grams_of(words_of(text)), _own()
    for family, texts in TEMPLATES.items():
        for template in (grams_of(words_of(t)) for t in texts):
            shorter = len(template) if family == UNKNOWN else min(len(grams), len(template))
            if len(grams & template) >= CONFIRMED * shorter and (family == UNKNOWN or not grams.isdisjoint(own[family])):
                return True
    return False


#: Lists the n-grams of the model are dealt to by crc32, so that one is found at once.
_LISTS = 2048
#: What rounding may take from the bound.
_SLACK = 1e-6


def _may_state(model: Model, grams: Column) -> Column:
    """Whether the score of any family can come up to that of ``none``; if not, the paragraph is of none.

    An n-gram counts with the family it speaks for most, so this is a bound from above for
    every family. A paragraph without a word has nothing to be judged by.
    """
    most = {g: max(max(w[1:]) - w[0], 0.0) for g, w in model.weights.items()}
    lists: list[dict[str, float]] = [{} for _ in range(_LISTS)]
    for g, w in most.items():
        lists[zlib.crc32(g.encode()) % _LISTS][g] = w
    known = F.from_json(F.lit(json.dumps(lists)), "array<map<string,double>>")  # folded into one constant
    foreign = max(f - model.foreign[0] for f in model.foreign[1:])
    start = max(b - model.bias[0] for b in model.bias[1:]) + foreign + _SLACK
    size = F.size(grams)

    def added(total: Column, gram: Column) -> Column:
        own = F.try_element_at(F.get(known, (F.crc32(gram.cast("binary")) % _LISTS).cast("int")), gram)
        return total + F.coalesce(own / F.sqrt(size) - F.lit(foreign) / size, F.lit(0.0))

    return (size > 0) & (F.aggregate(grams, F.lit(start), added) >= 0)


def scan(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, paragraph, family, probability, similarity, confirmed: every paragraph that states a licence.

    ``family`` is ``unknown`` where a licence is stated but no family is sure enough, or
    where no template of the family shares at least ``CONFIRMED`` of the n-grams (of the shorter of
    the two). Nothing is shared as long as there is no n-gram that few families use. Paragraphs count from 0. Null and empty texts state none; rows with null or
    repeated ids are scanned like others, one result each. Other columns are not read.
    """
    spark = docs.sparkSession
    names = model.families
    weights = spark.createDataFrame([(g, w) for g, w in model.weights.items()], "gram string, weights array<double>")
    own = _own()
    templates = spark.createDataFrame(
        [(family, sorted(grams_of(words_of(t))), own[family]) for family, texts in TEMPLATES.items() if family != UNKNOWN for t in texts],
        "family string, template array<string>, own array<string>",
    )
    words = F.regexp_extract_all(F.lower("line"), F.lit(f"({WORD})"), 1)
    lines = (
        _paragraphs(docs, id_col, text_col)
        .select("doc_id", "paragraph", words.alias("words"))
        .withColumn("pairs", F.zip_with("words", F.slice("words", F.lit(2), F.size("words")), lambda a, b: F.concat_ws(" ", a, b)))
        .withColumn("pairs", F.slice("pairs", F.lit(1), F.greatest(F.size("words") - 1, F.lit(0))))
        .select("doc_id", "paragraph", F.array_distinct(F.concat("words", "pairs")).alias("grams"))
        .withColumn("row", F.monotonically_increasing_id())  # tells repeated ids apart within this query
        .filter(_may_state(model, F.col("grams")))
    )
    # The model's few n-grams go to every task. Sums per paragraph are made where its n-grams are.
    sums = [F.coalesce(F.sum(F.col("weights")[k]), F.lit(0.0)).alias(f"s{k}") for k in range(len(names))]
    scored = (
        lines.select("doc_id", "paragraph", "row", "grams", F.explode_outer("grams").alias("gram"))
        .join(F.broadcast(weights), "gram", "left")
        .groupBy("doc_id", "paragraph", "row", "grams")
        .agg(F.count("weights").alias("known"), *sums)
    )
    size = F.greatest(F.size("grams"), F.lit(1))
    logits = F.array(
        *(
            F.lit(model.bias[k]) + F.col(f"s{k}") / F.sqrt(size) + F.lit(model.foreign[k]) * (F.size("grams") - F.col("known")) / size
            for k in range(len(names))
        )
    )
    named = (
        scored.withColumn("logits", logits)
        .withColumn("top", F.array_max("logits"))
        .withColumn("probability", 1 / F.aggregate("logits", F.lit(0.0), lambda s, z: s + F.exp(z - F.col("top"))))
        .withColumn("family", F.element_at(F.array(*map(F.lit, names)), F.array_position("logits", F.col("top")).cast("int")))
        .filter(F.col("family") != NONE)
        .select("doc_id", "paragraph", "row", "grams", "family", "probability")
    )
    shared = F.size(F.array_intersect("grams", "template")) / F.least(F.size("grams"), F.size("template"))
    compared = (
        named.join(F.broadcast(templates), "family", "left")
        .groupBy("doc_id", "paragraph", "row", "family", "probability")
        .agg(F.coalesce(F.max(F.when(F.arrays_overlap("grams", "own"), shared)), F.lit(0.0)).alias("similarity"))
    )
    sure = (F.col("probability") >= model.least) & (F.col("similarity") >= CONFIRMED) & (F.col("family") != UNKNOWN)
    return compared.select(
        "doc_id",
        "paragraph",
        F.when(sure, F.col("family")).otherwise(UNKNOWN).alias("family"),
        "probability",
        "similarity",
        sure.alias("confirmed"),
    )
