"""Licence notices in documents: a trained paragraph classifier whose findings templates confirm.

A paragraph is a line; blocks of lines, with comment marks or none and ended by
a blank line, are judged as a whole too, so that notices wrapped over lines are
found. A paragraph's features are the word n-grams it has of the model's
vocabulary; multinomial logistic regression over licence families and a class
for everything else is fitted, with soft-thresholding to keep it sparse, on
notices put together from templates and on sentences that aren't notices.
Probabilities are calibrated by a temperature chosen on left-out examples; a
paragraph whose best family doesn't reach half stays unknown. A prediction
counts when the paragraph has most of the n-grams of one of the family's
templates.

Every feature holds a word that ordinary sentences lack, so documents and
paragraphs without such a word can be passed over: their features are none and
the class is unknown. A document is scanned within its row, by built-in
functions only; nothing is joined or shuffled.
"""

from __future__ import annotations

import json
import math
import re
from functools import cache
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

UNKNOWN = "unknown"
#: Notices of the families, as usually worded (fixed values).
TEMPLATES: dict[str, tuple[str, ...]] = {
    "apache-2.0": ("Licensed under the Apache License, Version 2.0", "Apache License 2.0", "SPDX-License-Identifier: Apache-2.0"),
    "mit": ("MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "SPDX-License-Identifier: MIT"),
    "gpl-3.0": ("GNU General Public License, version 3", "GNU GPL v3", "SPDX-License-Identifier: GPL-3.0"),
    "gpl-2.0": ("GNU General Public License, version 2", "GNU GPL v2", "SPDX-License-Identifier: GPL-2.0"),
    "lgpl": ("GNU Lesser General Public License", "GNU LGPL", "SPDX-License-Identifier: LGPL-2.1"),
    "agpl-3.0": ("GNU Affero General Public License", "GNU AGPL", "SPDX-License-Identifier: AGPL-3.0"),
    "bsd": ("BSD 3-Clause License", "BSD License", "Redistribution and use in source and binary forms, with or without modification, are permitted", "SPDX-License-Identifier: BSD-3-Clause"),
    "mpl-2.0": ("Mozilla Public License, v. 2.0", "Mozilla Public License Version 2.0", "SPDX-License-Identifier: MPL-2.0"),
    "cc-by": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License", "SPDX-License-Identifier: CC-BY-4.0"),
    "cc-by-sa": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "SPDX-License-Identifier: CC-BY-SA-4.0"),
    "cc-by-nc": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    "cc0": ("CC0 1.0 Universal", "Creative Commons Zero public domain dedication", "SPDX-License-Identifier: CC0-1.0"),
    "unlicense": ("This is free and unencumbered software released into the public domain", "The Unlicense"),
    "proprietary": ("All rights reserved", "Proprietary and confidential"),
}
_FRAMES = ("{}", "Licensed under {}.", "Released under the {}.", "This work is licensed under the {}.", "Distributed under the terms of the {}", "This file is part of a work under {} .", "{} see the file for details")
#: Sentences that are no notices, some with words of notices (fixed values).
_OTHERS = (
    "the driver showed a license at the door", "she was licensed to practice medicine in the state", "a fishing license costs little", "the version of events that he told", "the public library is open in general on days of work",
    "students of the university wrote the software for this project", "we use this in the open and it is free for all", "to the general public this was of no use", "the commons are a place for all of us", "he got a permission to enter the building by the source of the river",
    "the creative work of the artist is for sale", "rights of the people and a bill of rights", "a copy of this letter was sent to any person of note", "the bsd and the others met", "under the terms of the treaty the land was given back",
    "it is hereby noted that forms are to be filled in with or without a name", "see the file for details and the part of it that is in use", "domain of the king", "the apache lived in the plains", "mozilla is a name", "a gnu is an animal of the plains",
    "international flights and zero delays", "the affero was", "attribution of the painting is not clear", "and that is the way of it on the whole", "released into the wild the birds flew off", "reserved seats are at the front", "confidential talks were held", "distributed over the land",
)
GRAMS, ROUNDS, RATE, SPARSE, HALF = 3, 90, 0.5, 2e-4, 0.5
#: Share of a template's n-grams that a paragraph must have.
CONFIRMED = 0.75
WORD = "[a-z0-9]+(?:[.][0-9]+)*"
#: Between blocks: lines of white space and comment marks only. Within a block WORD passes over such marks.
BETWEEN_BLOCKS = "\\n(?:[ \\t\\r/*#;%!<>|-]*\\n)+"


def words_of(text: str) -> list[str]:
    return re.findall(WORD, text.lower())


def grams_of(text: str) -> set[str]:
    w = words_of(text)
    return {" ".join(w[i : i + k]) for k in range(1, GRAMS + 1) for i in range(len(w) - k + 1)}


class Model(NamedTuple):
    families: list[str]
    bias: list[float]
    weights: dict[str, list[float]]
    temperature: float
    anchors: list[str]


def _softmax(z: list[float]) -> list[float]:
    top = max(z)
    e = [math.exp(x - top) for x in z]
    return [x / sum(e) for x in e]


def _logits(bias: list[float], weights: dict[str, list[float]], grams: set[str]) -> list[float]:
    z = list(bias)
    for g in grams & weights.keys():
        for k, w in enumerate(weights[g]):
            z[k] += w
    return z


def _descend(rows: list[tuple[set[str], int]], classes: int, vocabulary: set[str]) -> tuple[list[float], dict[str, list[float]]]:
    bias, weights = [0.0] * classes, {g: [0.0] * classes for g in sorted(vocabulary)}
    share = [0.5 / sum(1 for _, c in rows if (c == classes - 1) == (k == classes - 1)) for _, k in rows]
    for _ in range(ROUNDS):
        step_bias, steps = [0.0] * classes, {}
        for (grams, k), s in zip(rows, share, strict=True):
            p = _softmax(_logits(bias, weights, grams))
            for c in range(classes):
                miss = s * ((c == k) - p[c])
                step_bias[c] += miss
                for g in grams:
                    steps.setdefault(g, [0.0] * classes)[c] += miss
        bias = [b + RATE * d for b, d in zip(bias, step_bias, strict=True)]
        for g, d in steps.items():
            moved = [w + 8 * RATE * x for w, x in zip(weights[g], d, strict=True)]
            weights[g] = [math.copysign(max(0.0, abs(w) - SPARSE), w) for w in moved]
    return bias, {g: w for g, w in weights.items() if any(w)}


@cache
def model() -> Model:
    """Fits the classifier on its fixed examples, a few hundred; the same every time."""
    families = [*TEMPLATES, UNKNOWN]
    usual = {w for s in _OTHERS for w in words_of(s)} | {w for f in _FRAMES for w in words_of(f.replace("{}", ""))}
    usual -= {"license", "licensed", "bsd", "apache", "mozilla", "gnu", "affero", "reserved", "confidential"}
    examples = [(f.replace("{}", t), k) for k, ts in enumerate(TEMPLATES.values()) for t in ts for f in _FRAMES]
    examples += [(s, len(TEMPLATES)) for s in _OTHERS] + [(f"{a} {b}", len(TEMPLATES)) for a, b in zip(_OTHERS, _OTHERS[7:], strict=False)]
    kept = {g for t, _ in examples for g in grams_of(t) if any(w not in usual for w in g.split())}
    rows = [(grams_of(t) & kept, k) for t, k in examples]
    # every fourth example is left out once, to choose the temperature; then all are learned
    bias, weights = _descend([r for i, r in enumerate(rows) if i % 4], len(families), kept)
    left = [r for i, r in enumerate(rows) if i % 4 == 0]

    def loss(t: float) -> float:
        return -sum(math.log(_softmax([z / t for z in _logits(bias, weights, g)])[k]) for g, k in left)

    temperature = min((0.5 * 1.2**i for i in range(16)), key=loss)
    bias, weights = _descend(rows, len(families), kept)
    anchors = sorted({w for g in weights for w in g.split() if w not in usual})
    return Model(families, bias, weights, temperature, anchors)


def classify(text: str) -> tuple[str, float, float]:
    """Family, probability and template similarity of one paragraph, in plain Python; what the columns compute."""
    m, grams = model(), grams_of(text)
    if not grams & set(m.anchors):
        return UNKNOWN, 0.0, 0.0
    p = _softmax([z / m.temperature for z in _logits(m.bias, m.weights, grams)])
    best = max(range(len(TEMPLATES)), key=lambda k: (p[k], -k))
    if p[best] < HALF:
        return UNKNOWN, p[best], 0.0
    family = m.families[best]
    return family, p[best], max(len(grams_of(t) & grams) / len(grams_of(t)) for t in TEMPLATES[family])


# -- columns -----------------------------------------------------------------------------------


def _constant(value: object, kind: str) -> Column:
    """A literal of a nested type, as one expression that the optimizer folds."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def _grams(paragraph: Column) -> Column:
    w = F.regexp_extract_all(paragraph, F.lit(WORD), F.lit(0))

    def runs(words: Column, k: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - k + 1)), lambda i: F.array_join(F.slice(words, i, F.lit(k)), " "))

    def of(words: Column) -> Column:
        return F.array_distinct(F.concat(words, *[runs(words, k) for k in range(2, GRAMS + 1)]))

    return F.transform(F.array(w), of)[0]


def paragraph_finding(paragraph: Column) -> Column:
    """Struct of family, probability and similarity for a lower-cased paragraph that has an anchor."""
    m = model()
    table, bias = _constant(m.weights, "map<string,array<double>>"), _constant(m.bias, "array<double>")

    def judged(grams: Column) -> Column:
        present = F.array_intersect(grams, _constant(list(m.weights), "array<string>"))
        sums = F.aggregate(present, bias, lambda acc, g: F.zip_with(acc, F.element_at(table, g), lambda a, b: a + b))
        odds = F.transform(F.array(sums), lambda z: F.transform(z, lambda v: F.exp((v - F.array_max(z)) / m.temperature)))[0]
        shares = F.transform(F.array(odds), lambda e: F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b)))[0]
        best = F.transform(F.array(F.slice(shares, 1, len(TEMPLATES))), lambda p: F.struct(F.array_max(p).alias("p"), F.array_position(p, F.array_max(p)).cast("int").alias("k")))[0]
        patterns = _constant([[sorted(grams_of(t)) for t in ts] for ts in TEMPLATES.values()], "array<array<array<string>>>")

        def confirmed(b: Column) -> Column:
            likeness = F.array_max(F.transform(F.element_at(patterns, b["k"]), lambda t: F.size(F.array_intersect(t, grams)) / F.size(t)))
            known = b["p"] >= HALF
            return F.struct(F.when(known, F.element_at(_constant(list(TEMPLATES), "array<string>"), b["k"])).otherwise(UNKNOWN).alias("family"), b["p"].alias("probability"), F.when(known, likeness).otherwise(0.0).alias("similarity"))

        return F.transform(F.array(best), confirmed)[0]

    return F.transform(F.array(_grams(paragraph)), judged)[0]


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_paragraphs, findings, wrapped per input row: findings lists paragraph number, family, probability, similarity, confirmed.

    wrapped has family, probability, similarity of the blocks of several lines that are confirmed as a whole. Only paragraphs of a known family are listed. Null and empty texts have no paragraphs, blank lines count as
    none; null ids are kept, repeated rows give repeated results, other columns are ignored.
    """
    anchor = "(?<![a-z0-9])(?:" + "|".join(re.escape(a) for a in model().anchors) + ")(?![a-z0-9])"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda p: F.trim(p) != "")
    numbered = F.filter(F.transform(lines, lambda p, i: F.struct(i.alias("paragraph"), p.alias("p"))), lambda x: x["p"].rlike(anchor))
    judged = F.transform(numbered, lambda x: F.transform(F.array(paragraph_finding(x["p"])), lambda f: F.struct(x["paragraph"].alias("paragraph"), f["family"].alias("family"), f["probability"].alias("probability"), f["similarity"].alias("similarity"), (f["similarity"] >= CONFIRMED).alias("confirmed")))[0])
    empty = F.array().cast("array<struct<paragraph:int,family:string,probability:double,similarity:double,confirmed:boolean>>")
    findings = F.when(F.col("text").rlike(anchor), F.filter(judged, lambda f: f["family"] != UNKNOWN)).otherwise(empty)
    blocks = F.filter(F.split("text", BETWEEN_BLOCKS), lambda b: F.trim(b).contains("\n") & b.rlike(anchor))
    whole = F.filter(F.transform(blocks, paragraph_finding), lambda f: (f["family"] != UNKNOWN) & (f["similarity"] >= CONFIRMED))
    wrapped = F.when(F.col("text").rlike(anchor), whole).otherwise(F.array().cast("array<struct<family:string,probability:double,similarity:double>>"))
    return rows.select("doc_id", F.size(lines).cast("long").alias("n_paragraphs"), findings.alias("findings"), wrapped.alias("wrapped"))
