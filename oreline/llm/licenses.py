"""Licence scans: a trained paragraph classifier on word n-grams, confirmed by templates.

The classifier is a multinomial logistic regression on the words and word pairs of a paragraph (a line), with a class for
each licence family, one for licence-like text of no known family and one for other text. It is trained on the driver
from public notice templates (whole, cut and perturbed), made-up licence-like sentences, and a bounded sample of
the corpus's own paragraphs as other text; its temperature is fitted on examples left out of training, so the
probability of the unknown class is calibrated. A prediction is confirmed if enough word pairs of one of the
family's templates are in the paragraph, or enough of the paragraph's are in the template; one that is not confirmed becomes unknown.

The main path is DataFrame expressions only. Paragraphs that hold no n-gram of the model score as other text
(the bias alone) and go no further; the n-grams of the rest meet their weights in a broadcast join with at most
``MAX_FEATURES`` rows.

Defined results: null or empty texts, and texts without licence-like lines, give no row; repeated rows give their
rows again; a null doc_id stays null; of families with equal probability the first in the list is taken; extra columns,
whatever their names, are ignored; an empty table gives an empty result. A paragraph of any length is read whole.
"""

from __future__ import annotations

import json
import random
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE_LINES = 4_000  #: lines of the corpus used as other text in training, at most
MAX_FEATURES = 4_000
CONFIRM = 0.5  #: share of word pairs that confirms a family
FLOOR = 0.5  #: probability of being other text from which a paragraph is left out
OTHER, UNKNOWN = "other", "unknown"

# Public notice sentences by licence family.
TEMPLATES: dict[str, list[str]] = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT license.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction."],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "Distributed under the terms of the Apache License, version 2.0."],
    "GPL": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.", "Licensed under the GNU General Public License, version 2 or later."],
    "LGPL": ["Licensed under the GNU Lesser General Public License, version 2.1.", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License."],
    "AGPL": ["Licensed under the GNU Affero General Public License, version 3.", "You can modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation."],
    "BSD": ["Licensed under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.", "Use of this source code is governed by a BSD-style license."],
    "MPL": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0."],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "Text is available under the Creative Commons Attribution-ShareAlike License."],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0": ["To the extent possible under law, the author has waived all copyright and related rights to this work (CC0 1.0).", "Dedicated to the public domain under CC0."],
    "ISC": ["Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted (ISC License)."],
    "Proprietary": ["Copyright. All rights reserved.", "Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential."],
}
# Licence-like sentences that name no known family.
UNKNOWN_TEMPLATES = ["Licensed under the terms agreed with the author.", "This text is licensed under our own license, version 1.", "Released under a custom license.", "See the license for the terms of use.", "The license of this work is not stated.", "You may use this work under the house license.", "Use of this data is subject to a separate license agreement.", "Licensed to the reader."]


def words(text: str) -> list[str]:
    return [w for w in re.split(r"[^a-z0-9]+", re.sub(r"[A-Z]", lambda m: m[0].lower(), text)) if w]


def grams(ws: list[str]) -> list[str]:
    return ws + [f"{a} {b}" for a, b in zip(ws, ws[1:], strict=False)]


@dataclass
class Model:
    classes: list[str]
    weights: dict[str, list[float]]  # n-gram -> a weight for each class
    bias: list[float]
    temperature: float


def examples(background: list[str], seed: int = 5) -> list[tuple[list[str], str]]:
    """Templates whole, cut short and with words lost, changed or put around them."""
    rng = random.Random(seed)
    filler = [w for line in background for w in words(line)][:20_000] or ["text"]
    out = []
    for family, texts in [*TEMPLATES.items(), (UNKNOWN, UNKNOWN_TEMPLATES)]:
        for t in texts:
            base = words(t)
            out.append((base, family))
            for _ in range(24 if family == UNKNOWN else 30):
                ws = list(base)
                if rng.random() < 0.4 and len(ws) > 8:
                    ws = ws[: rng.randint(len(ws) * 2 // 3, len(ws))]
                if rng.random() < 0.4:
                    ws[rng.randrange(len(ws))] = rng.choice(filler)
                if rng.random() < 0.4:
                    ws = rng.choices(filler, k=rng.randint(1, 8)) + ws
                if rng.random() < 0.4:
                    ws = ws + rng.choices(filler, k=rng.randint(1, 8))
                out.append((ws, family))
    return out + [(words(line), OTHER) for line in background]


def fit(background: list[str], seed: int = 5) -> Model:
    """Train from templates and lines of other text."""
    own = {g for texts in [*TEMPLATES.values(), UNKNOWN_TEMPLATES] for t in texts for g in grams(words(t))}
    seen: dict[str, int] = {}
    for line in background:
        for g in set(grams(words(line))):
            seen[g] = seen.get(g, 0) + 1
    data = examples(background, seed)
    count: dict[str, int] = {}
    for ws, y in data:
        if y != OTHER:
            for g in set(grams(ws)):
                if g in own and seen.get(g, 0) * 100 <= max(1, len(background)):
                    count[g] = count.get(g, 0) + 1
    feats = sorted(g for g in sorted(count, key=lambda g: (-count[g], g))[:MAX_FEATURES] if count[g] >= 3)
    at = {g: i for i, g in enumerate(feats)}
    rows = [(sorted({at[g] for g in grams(ws) if g in at}), y) for ws, y in data]
    rows = [(r, y) for r, y in rows if r or y == OTHER]
    classes = [*TEMPLATES, UNKNOWN, OTHER]
    y = np.array([classes.index(c) for _, c in rows])
    held = np.arange(len(y)) % 5 == 4
    k = len(classes)
    x, xh = Sparse([r for (r, _), h in zip(rows, held, strict=True) if not h], len(feats)), Sparse([r for (r, _), h in zip(rows, held, strict=True) if h], len(feats))
    w, b = np.zeros((len(feats), k), np.float32), np.zeros(k, np.float32)
    b[-1] = 3.0
    weight = (1.0 / np.bincount(y, minlength=k).clip(1))[y].astype(np.float32)
    weight /= weight[~held].sum()
    yt, wt = np.eye(k, dtype=np.float32)[y[~held]], weight[~held, None]
    mw, mb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(300):
        z = x.times(w) + b
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = (p - yt) * wt
        mw = 0.9 * mw + x.turned_times(g) + 1e-5 * w
        mb = 0.9 * mb + g.sum(0)
        w -= 4.0 * mw
        b -= 4.0 * mb
    z, best = xh.times(w) + b, (np.inf, 1.0)
    for t in np.geomspace(0.3, 5, 40):  # calibration on what was left out
        q = z / t
        loss = float((np.log(np.exp(q - q.max(1, keepdims=True)).sum(1)) + q.max(1) - q[np.arange(len(q)), y[held]]).mean()) if held.any() else 0
        best = min(best, (loss, float(t)))
    return Model(classes, {g: [round(float(v), 5) for v in w[i]] for g, i in at.items()}, [round(float(v), 5) for v in b], best[1])


class Sparse:
    """A matrix of zeros and ones, by the columns of each row's ones."""

    def __init__(self, rows: list[list[int]], width: int):
        self.shape = (len(rows), width)
        self.col = np.array([c for r in rows for c in r], np.int64)
        self.row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.by_col = np.argsort(self.col, kind="stable")

    @staticmethod
    def _sums(values: np.ndarray, key: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros((n, values.shape[1]), np.float32)
        if len(key):
            at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            out[key[at]] = np.add.reduceat(values, at, axis=0)
        return out

    def times(self, w: np.ndarray) -> np.ndarray:
        return self._sums(w[self.col], self.row, self.shape[0])

    def turned_times(self, g: np.ndarray) -> np.ndarray:
        return self._sums(g[self.row[self.by_col]], self.col[self.by_col], self.shape[1])


# ---------------------------------------------------------------- main path
def _table(spark, rows: list[dict], ddl: str) -> DataFrame:
    """A small table from values written into the plan."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{ddl}>>")))


def word_array(line: F.Column) -> F.Column:
    low = F.translate(line, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(low, "[^a-z0-9]+"), lambda w: w != "")


def pair_array(ws: F.Column) -> F.Column:
    return F.zip_with(F.slice(ws, 1, F.greatest(F.size(ws) - 1, F.lit(0))), F.slice(ws, 2, F.greatest(F.size(ws) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))


def _pairs(template: str) -> list[str]:
    """Word pairs of a template."""
    return sorted(set(grams(words(template))[len(words(template)) :]))


def sample_lines(docs: DataFrame) -> list[str]:
    """At most ``SAMPLE_LINES`` different lines of other text, by hash: those that do not speak of licences. Lines are thinned
    by their hash first, so that few of a large corpus are ordered; copies of a line count once."""
    share = min(1.0, 8 * SAMPLE_LINES / max(1, docs.count()))
    some = docs.select(F.explode(F.split(F.col("text").cast("string"), "\n")).alias("line")).where("length(line) > 0")
    some = some.withColumn("k", F.xxhash64("line", F.lit(11))).where(F.pmod("k", F.lit(1_000_000)) < int(1_000_000 * share) + 1)
    some = some.where(~F.lower("line").rlike("licen|copyright|rights reserved|creative commons|public domain")).distinct()
    return [r["line"] for r in some.orderBy("k", "line").limit(SAMPLE_LINES).select("line").collect()]


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """A row for each licence-like paragraph: ``doc_id``, paragraph, family, probability, similarity, confirmed."""
    spark = docs.sparkSession
    lines = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.posexplode(F.split(F.col("text").cast("string"), "\n")).alias("paragraph", "line"))
    single, double = [g for g in model.weights if " " not in g], [g for g in model.weights if " " in g]
    lines = lines.withColumn("ws", word_array(F.col("line")))
    lines = lines.where(F.exists("ws", lambda w: w.isin(single)) | F.exists(pair_array(F.col("ws")), lambda p: p.isin(double)))
    lines = lines.select("doc_id", "row", "paragraph", "ws", F.array_distinct(pair_array(F.col("ws"))).alias("pairs"))
    # of a line's pairs only those of templates go on, and how many there are
    known = sorted({p for texts in TEMPLATES.values() for t in texts for p in _pairs(t)})
    lines = lines.withColumns({"told": F.filter("pairs", lambda p: p.isin(known)), "n_pairs": F.size("pairs")})
    table = F.broadcast(_table(spark, [{"gram": g, "w": v} for g, v in model.weights.items()], "gram: string, w: array<double>"))
    terms = lines.select("doc_id", "row", "paragraph", "told", "n_pairs", F.explode(F.concat(F.array_distinct("ws"), "pairs")).alias("gram")).join(table, "gram")
    k = len(model.classes)
    sums = [F.sum(F.element_at("w", i + 1)).alias(f"z{i}") for i in range(k)]
    got = terms.groupBy("row", "paragraph").agg(F.first("doc_id").alias("doc_id"), F.first("told").alias("told"), F.first("n_pairs").alias("n_pairs"), *sums)
    logits = [F.exp(F.greatest(F.lit(-700.0), F.least(F.lit(700.0), (F.col(f"z{i}") + model.bias[i]) / model.temperature))) for i in range(k)]
    got = got.withColumn("e", F.array(*logits)).withColumn("total", F.aggregate("e", F.lit(0.0), lambda a, x: a + x))
    got = got.withColumn("p", F.transform("e", lambda x: x / F.col("total")))
    got = got.where(F.element_at("p", k) < FLOOR)
    families = model.classes[:-2]
    ranked = F.array_max(F.transform(F.arrays_zip(F.slice("p", 1, k - 1).alias("p"), F.array(*[F.lit(-i) for i in range(k - 1)]).alias("i")), lambda s: F.struct(s["p"].alias("p"), s["i"].alias("i"))))
    got = got.withColumn("best", ranked).withColumn("guess", F.element_at(F.array(*[F.lit(c) for c in model.classes[:-1]]), 1 - F.col("best.i")))
    alike = F.lit(0.0)
    for family in families:
        each = []
        for t in TEMPLATES[family]:
            pairs = _pairs(t)
            if pairs:
                both = F.size(F.array_intersect("told", F.array(*[F.lit(p) for p in pairs])))
                each.append(F.greatest(both / F.lit(float(len(pairs))), F.when(F.col("n_pairs") >= 3, both / F.col("n_pairs")).otherwise(0.0)))
        alike = F.when(F.col("guess") == family, F.greatest(*each) if len(each) > 1 else each[0]).otherwise(alike)
    got = got.withColumn("similarity", alike).withColumn("confirmed", F.col("similarity") >= CONFIRM)
    return got.select("doc_id", F.col("paragraph").cast("int"), F.when(F.col("confirmed"), F.col("guess")).otherwise(UNKNOWN).alias("family"), F.col("best.p").alias("probability"), "similarity", "confirmed")
