"""Licence scan: a trained paragraph classifier, its verdicts confirmed against templates.

Paragraphs (lines, and runs of lines over which a notice is wrapped) become sets of word pairs, of which those that occur in licence
templates are features. Sparse multinomial logistic regression (one class for each family and one for unknown) is fitted on variants of
the templates and on a bounded sample of corpus paragraphs; the probability that a family needs is calibrated on paragraphs held out of
the fit, so that unknown ones stay unknown. A predicted family is confirmed where the paragraph holds enough of one of its templates and
all pairs of names and versions that the template tells its licence by; where it holds the one without the other, it is unknown.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from groundloom.llm.common import body, slices

#: Licence notices by family, fixed values. BSD-3-Clause stands for BSD-2-Clause too: both begin with the sentence given here.
TEMPLATES = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "Licensed under the Apache License, Version 2.0."),
    "MIT": ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.", "Released under the MIT License.", "Licensed under the MIT License."),
    "GPL-3.0": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, either version 3 of the License, or any later version.", "This work is licensed under the GNU General Public License, version 3."),
    "GPL-2.0": ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License; either version 2 of the License, or any later version.", "This work is licensed under the GNU General Public License, version 2."),
    "AGPL-3.0": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License, either version 3 of the License, or any later version.", "This work is licensed under the GNU Affero General Public License, version 3."),
    "LGPL-3.0": ("This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License, either version 3 of the License, or any later version.", "This work is licensed under the GNU Lesser General Public License, version 3."),
    "LGPL-2.1": ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License; either version 2.1 of the License, or any later version.", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    "BSD-3-Clause": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.", "Use of this source code is governed by a BSD-style license."),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "Released under the ISC License."),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.",),
    "MPL-1.1": ("The contents of this file are subject to the Mozilla Public License Version 1.1 (the License); you may not use this file except in compliance with the License.",),
    "EPL-2.0": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.", "Licensed under the Eclipse Public License, version 2.0."),
    "CC-BY-4.0": ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."),
    "CC-BY-SA-4.0": ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0."),
    "CC-BY-ND-4.0": ("This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "Licensed under CC BY-ND 4.0."),
    "CC-BY-NC-4.0": ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0."),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related rights to this work.", "Released under CC0 1.0."),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
}
#: Words that licences are told apart by, fixed values; versions are told by their digits.
NAMES = {"apache", "mit", "gnu", "general", "affero", "lesser", "public", "bsd", "isc", "mozilla", "eclipse", "creative", "commons", "attribution", "sharealike", "noderivatives", "noncommercial",
         "cc", "cc0", "by", "sa", "nd", "nc", "license", "version", "unencumbered", "style"}
UNKNOWN = "unknown"
#: Corpus paragraphs in the fit at most.
TRAINING_PARAGRAPHS = 20_000
CONFIRMED = 0.6
_words = re.compile(r"[^\W_]+(?:\.[0-9]+)*").findall
_mark = re.compile(r"\s*(?:rem|dnl)\s", re.IGNORECASE).match  # comment marks that are words


def pairs(paragraph: str) -> set[tuple[str, str]]:
    w = _words(paragraph.lower())
    return set(zip(["", *w], [*w, ""])) - {("", "")}


def told_by(template: set) -> set:
    """The pairs of a template of which both words name a licence or its version."""
    says = lambda w: w in NAMES or w[:1].isdigit()
    return {p for p in template if says(p[0]) and says(p[1])}


def line_words(line: str) -> list[str]:
    """The words of a line in lower case, without a comment mark before them."""
    return _words((line[m.end() :] if (m := _mark(line)) else line).lower())


@dataclass
class Model:
    families: list[str]
    vocabulary: dict[tuple[str, str], int]
    weights: np.ndarray  # [features + 1, classes], the last row is the bias; unknown is the last class
    least: float
    templates: list[list[set]]
    required: list[list[set]]

    def predict(self, found: set) -> tuple[str, float, float]:
        """Family or unknown, its probability, and the best share of one of the family's templates that the paragraph holds."""
        at = [k for p in found if (k := self.vocabulary.get(p)) is not None]
        z = self.weights[at].sum(axis=0) + self.weights[-1]
        p = np.exp(z - z.max())
        p /= p.sum()
        k = int(p[:-1].argmax())
        if p[k] < self.least:
            return UNKNOWN, float(1 - p[k]), 0.0
        held = [(len(found & t) / len(t), own <= found) for t, own in zip(self.templates[k], self.required[k], strict=True)]
        share = max((share for share, told in held if told), default=0.0)
        if share < CONFIRMED <= max(held)[0]:  # all but the name or version: another licence
            return UNKNOWN, float(1 - p[k]), 0.0
        return self.families[k], float(p[k]), share


def _run(model: Model, lines: list[list[str]], single: list[float]) -> tuple[int, int, str, float, float] | None:
    """(first, last, family, probability, template_share) of a notice confirmed over two or more of ``lines`` (their words).

    Of each template that the lines together hold, the shortest run that holds as much of it is judged; it has to hold more of its
    family's than any of its lines that is confirmed by itself (``single``: their shares, else 0).
    """
    words = ["", *[w for x in lines for w in x], ""]
    known = model.vocabulary.keys() & set(zip(words, words[1:]))
    held = sorted(((len(known & t) / len(t), k, n) for k, ts in enumerate(model.templates) for n, t in enumerate(ts)), reverse=True) if len(known) > 2 else []
    at = [k for k, x in enumerate(lines) for _ in x]
    at = [at[0], *at, at[-1]]  # the line of each word
    for share, k, n in held:
        if share < CONFIRMED:
            return None
        places = [(at[i], at[i + 1], p) for i, p in enumerate(zip(words, words[1:])) if p in model.templates[k][n]]
        need, have, best, i = len({p for _, _, p in places}), {}, (len(lines), 0), 0
        for _, last, p in places:
            have[p] = have.get(p, 0) + 1
            while len(have) == need:
                first, _, q = places[i]
                best = min(best, (last - first, first))
                have[q] -= 1
                if not have[q]:
                    del have[q]
                i += 1
        first, last = best[1], best[1] + best[0]
        inside = ["", *[w for x in lines[first : last + 1] for w in x], ""]
        family, p, share = model.predict(set(zip(inside, inside[1:])))
        if first < last and family != UNKNOWN and share >= CONFIRMED and share > max(single[first : last + 1]):
            return first, last, family, p, share
    return None


def wrapped(model: Model, lines: list[list[str]], single: list[float]) -> list[tuple[int, int, str, float, float]]:
    """All notices of ``_run`` without overlap, also those between lines that are confirmed by themselves."""
    out, todo = [], [(0, len(lines))]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        if x := _run(model, lines[a:b], single[a:b]):
            out.append((a + x[0], a + x[1], *x[2:]))
            todo += [(a, a + x[0]), (a + x[1] + 1, b)]
        elif any(single[a:b]):
            ends = [a - 1, *[k for k in range(a, b) if single[k]], b]
            todo += [(p + 1, q) for p, q in zip(ends, ends[1:])]
    return out


def notices(model: Model, text: str) -> list[tuple[int, str, float, float, bool]]:
    """(line number from 0, family, probability, template_share, confirmed): lines by themselves, and what is wrapped over lines between blank ones, in their stead."""
    single: dict[int, tuple] = {}
    out: list[tuple] = []
    block: list[tuple[int, list[str]]] = []

    def close() -> None:
        alone = [single[k][3] if k in single and single[k][4] else 0.0 for k, _ in block]
        for first, last, *x in wrapped(model, [w for _, w in block], alone):
            for k, _ in block[first : last + 1]:
                single.pop(k, None)
            out.append((block[first][0], *x, True))
        block.clear()

    for k, line in enumerate(text.split("\n")):
        words = line_words(line)
        found = set(zip(["", *words], [*words, ""])) if words else set()
        if model.vocabulary.keys() & found:
            family, p, share = model.predict(found)
            if family != UNKNOWN:
                single[k] = (k, family, p, share, share >= CONFIRMED)
        if words:
            block.append((k, words))
        else:
            close()
    close()
    return sorted([*single.values(), *out])


def fit(rows: list[tuple[set, int]], classes: int, size: int, vocabulary: dict, rounds: int = 300, rate: float = 2.0, l1: float = 2e-4) -> np.ndarray:
    """Proximal gradient descent; rows of the same features and class are one row with a weight; classes weigh the same in all."""
    seen = Counter((tuple(sorted(j for p in found if (j := vocabulary.get(p)) is not None)), k) for found, k in rows)
    x = np.zeros((len(seen), size + 1))
    y = np.zeros((len(seen), classes))
    for i, (known, k) in enumerate(seen):
        x[i, list(known)] = 1
        y[i, k] = 1
    x[:, -1] = 1
    many = np.array(list(seen.values()), dtype=float)
    share = many * (y / np.maximum((y * many[:, None]).sum(axis=0), 1)).sum(axis=1) / classes
    w = np.zeros((size + 1, classes))
    for _ in range(rounds):
        z = x @ w
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        w -= rate * x.T @ ((p - y) * share[:, None])
        w[:-1] = np.sign(w[:-1]) * np.maximum(np.abs(w[:-1]) - rate * l1, 0)
    return w


#: Characters of each line around a drawn one that are looked at.
AROUND_CHARS = 600


def train(docs: DataFrame, most: int = TRAINING_PARAGRAPHS, false_share: float = 1e-3) -> Model:
    """Fit on template variants and on at most ``most`` distinct paragraphs of the corpus that, with the lines around, hold little of any template.

    Lines are drawn by a hash of their text, so copies are drawn together and count once. Only features of the drawn lines travel.
    """
    templates = [[pairs(t) for t in ts] for ts in TEMPLATES.values()]
    vocabulary = {p: k for k, p in enumerate(sorted(set().union(*[t for ts in templates for t in ts])))}
    lines = docs.select(F.split(body(docs), "\n").alias("lines"))
    n = lines.agg(F.sum(F.size(F.filter("lines", lambda x: F.trim(x) != "")))).first()[0] or 0
    drawn = math.ceil(1e7 * min(1.0, most / max(1, n)))
    wanted = lambda x: (F.trim(x) != "") & (F.pmod(F.xxhash64(x, F.lit(3)), F.lit(10_000_000)) < drawn)
    # a line beside which more of a notice stands may be a part of it
    near = lambda i: F.array_join(F.transform(F.slice("lines", F.greatest(i - 3, F.lit(1)), F.lit(9)), lambda x: F.substring(x, 1, AROUND_CHARS)), "\n")
    picked = F.filter(F.transform("lines", lambda x, i: F.when(wanted(x), F.struct(x.alias("line"), near(i).alias("near")))), lambda x: x.isNotNull())
    sample = lines.select(F.explode(picked).alias("x")).select("x.line", "x.near")

    def shown(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            out = []
            for line, around in zip(x["line"], x["near"], strict=True):
                found = pairs(line)
                w = [v for t in around.split("\n") for v in line_words(t)]
                whole = (found | set(zip(w, w[1:]))) & vocabulary.keys()
                out.append((xxhash.xxh64_intdigest(line) >> 1, sorted(vocabulary[p] for p in found if p in vocabulary), max(len(whole & t) / len(t) for ts in templates for t in ts)))
            yield pd.DataFrame(out, columns=["key", "known", "held"])

    names = list(vocabulary)
    seen = sample.mapInPandas(shown, "key long, known array<int>, held double").groupBy("key", "known").agg(F.max("held").alias("held"))
    plain = [{names[k] for k in r["known"]} for r in seen.where("held < 0.3").orderBy("key", "known").limit(most).collect()]
    draw_ = np.random.default_rng(11)
    rows: list[tuple[set, int]] = []
    for k, ts in enumerate(templates):
        for t in ts:
            listed = sorted(t)
            rows.append((t, k))
            rows += [({p for p, keep in zip(listed, draw_.random(len(listed)) > 0.25, strict=True) if keep}, k) for _ in range(40)]
    cut = len(plain) // 2
    classes = len(templates) + 1
    fitted = [*rows, *[(p, classes - 1) for p in plain[:cut]], (set(), classes - 1)]
    weights = fit(fitted, classes, len(vocabulary), vocabulary)
    model = Model(list(TEMPLATES), vocabulary, weights, 0.0, templates, [[told_by(t) for t in ts] for ts in templates])
    wrong = sorted(1 - q if family == UNKNOWN else q for family, q, _ in map(model.predict, plain[cut:]))
    top = wrong[min(len(wrong) - 1, math.floor((1 - false_share) * len(wrong)))] if wrong else 0.5
    model.least = max(0.5, min(0.95, top + 1e-6))
    return model


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, paragraph (number of its first line, from 0), family, probability, template_share and confirmed for every paragraph given a family.

    Each line is a paragraph; so is each run of lines, without a blank one, over which a notice is wrapped. Such a run stands for its lines.

    Null and empty texts have none; repeated rows are scanned each and null ids kept; other columns are ignored; an empty table gives
    no rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            texts = x["text"].tolist()
            for a, b in slices(texts):
                out = [(doc, *found) for doc, text in zip(x["doc_id"].iloc[a:b], texts[a:b], strict=True) for found in notices(model, text)]
                yield pd.DataFrame(out, columns=["doc_id", "paragraph", "family", "probability", "template_share", "confirmed"])

    rows = docs.select(docs["doc_id"].cast("string").alias("doc_id"), body(docs).alias("text"))
    done = rows.mapInPandas(run, "doc_id string, paragraph long, family string, probability double, template_share double, confirmed boolean")
    return done.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))
