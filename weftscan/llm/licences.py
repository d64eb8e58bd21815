"""Licence families of paragraphs: a sparse word n-gram logistic regression, a calibrated unknown class, templates.

Training is small and happens on the driver: windows of the licence texts below, with dropped words, against
paragraphs of the corpus (a bounded sample) as the unknown class. What it gives is a table of weights for at most
``MAX_FEATURES`` one- and two-word grams; so its size is bounded and it is broadcast. Scoring is DataFrame work
alone: paragraphs that hold a weighted word are cut into grams, joined with the weights, and summed by paragraph.
A temperature, fitted on windows kept aside, calibrates the probabilities, and a family is confirmed by the share of
the paragraph's grams that its template has.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import join_sized, table

# Opening or grant paragraphs of public licences, and the usual one-line notices.
TEMPLATES = {
    "apache": [
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Licensed under the Apache License, Version 2.0.",
        "Apache License Version 2.0, January 2004. SPDX-License-Identifier: Apache-2.0",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Released under the BSD 3-Clause License. SPDX-License-Identifier: BSD-3-Clause BSD-2-Clause",
    ],
    "cc-by": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/.",
        "Licensed under CC BY 4.0. Creative Commons Attribution.",
    ],
    "cc-by-nc": [
        "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-nc/4.0/. You may not use the material for commercial purposes.",
        "Licensed under CC BY-NC 4.0.",
        "Licensed under CC BY-NC-SA 4.0, noncommercial use only.",
    ],
    "gpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GPL, version 2 or later. SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "Licensed under the GNU Lesser General Public License, LGPL version 3.",
    ],
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license. SPDX-License-Identifier: MIT",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License, MPL version 2.0.",
    ],
    "proprietary": [
        "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the copyright owner.",
        "Confidential and proprietary. Unauthorized copying of this file, via any medium, is strictly prohibited.",
    ],
}
UNKNOWN = "unknown"
FAMILIES = [UNKNOWN, *TEMPLATES]
MAX_FEATURES = 4000
#: Corpus paragraphs that stand for the unknown class, at most, and characters of each.
SAMPLE_PARAGRAPHS = 3000
SAMPLE_LENGTH = 4000
WINDOWS, EPOCHS, RATE, DECAY = 60, 150, 0.5, 1e-4
#: Share of the paragraph's grams in the family's templates that confirms it, and its least probability.
CONFIRM, LEAST = 0.4, 0.5
#: Corpus paragraphs in which a gram may occur and still be a feature.
COMMON = 0.002


def words_of(text: str) -> list[str]:
    return [w for w in re.split("[^a-z0-9]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w]


def grams_of(text: str) -> list[str]:
    """Distinct one- and two-word grams in order."""
    w = words_of(text)
    return list(dict.fromkeys([*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))]))


def _windows(rng: np.random.Generator) -> list[tuple[str, int]]:
    out = []
    for k, family in enumerate(FAMILIES[1:], 1):
        for template in TEMPLATES[family]:
            words = template.split()
            out.append((template, k))
            for _ in range(WINDOWS):
                n = int(rng.integers(min(5, len(words)), len(words) + 1))
                at = int(rng.integers(0, len(words) - n + 1))
                out.append((" ".join(w for w in words[at : at + n] if rng.random() > 0.1), k))
    return out


class Model:
    """Weights by gram (a row for each family, the unknown first), intercepts, temperature."""

    def __init__(self, grams: list[str], weights: np.ndarray, bias: np.ndarray, temperature: float):
        self.grams, self.weights, self.bias, self.temperature = grams, weights, bias, temperature
        self.place = {g: k for k, g in enumerate(grams)}

    def probabilities(self, text: str) -> np.ndarray:
        """The brute-force form of what the DataFrame computes."""
        at = [self.place[g] for g in grams_of(text) if g in self.place]
        z = (self.bias + self.weights[at].sum(axis=0)) / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()


def train(paragraphs: list[str], seed: int = 3) -> Model:
    """Fit on template windows and, as unknown, ``paragraphs`` that share no rare gram with a template, and made-up prose."""
    rng = np.random.default_rng(seed)
    windows = _windows(rng)
    df = Counter(g for p in paragraphs for g in grams_of(p))
    most = max(3, COMMON * len(paragraphs))
    seen = Counter(g for t, _ in windows for g in grams_of(t))
    notice = re.compile(r"licen[cs]e|copyright|all rights reserved|creative commons|gnu |apache", re.I)
    plain = [p for p in paragraphs if not notice.search(p)]
    plain_df = Counter(g for p in plain for g in grams_of(p))
    single = {g for g in seen if " " not in g and plain_df[g] <= most and len(g) > 1}
    grams = sorted(g for g in seen if g in single or (" " in g and plain_df[g] <= most and any(w in single for w in g.split())))
    grams = sorted(sorted(grams, key=lambda g: (-seen[g], g))[:MAX_FEATURES])
    known = set(grams)
    grams = [g for g in grams if " " not in g or any(w in known for w in g.split())]
    place = {g: k for k, g in enumerate(grams)}
    vocabulary = [w for w in single if w in place]
    made = []  # prose that names a few of the words, but is no licence
    filler = [w for p in plain[:200] for w in words_of(p)] or ["and", "the", "of"]
    for _ in range(len(windows)):
        body = list(rng.choice(filler, 12)) + list(rng.choice(sorted(vocabulary), int(rng.integers(0, 3))))
        rng.shuffle(body)
        made.append(" ".join(body))
    rows = windows + [(p, 0) for p in plain] + [(p, 0) for p in made]
    order = rng.permutation(len(rows))
    held = set(order[: len(order) // 5].tolist())
    x = np.zeros((len(rows), len(grams)), np.float32)
    y = np.array([k for _, k in rows])
    for k, (t, _) in enumerate(rows):
        for g in grams_of(t):
            if g in place:
                x[k, place[g]] = 1
    fit = np.array([k for k in range(len(rows)) if k not in held])
    aside = np.array(sorted(held))
    weights, bias = np.zeros((len(grams), len(FAMILIES)), np.float32), np.zeros(len(FAMILIES), np.float32)
    target = np.eye(len(FAMILIES), dtype=np.float32)[y]
    cost = (1.0 / np.bincount(y, minlength=len(FAMILIES)).clip(1))[y].astype(np.float32)
    cost /= cost[fit].sum()
    sum_w, sum_b = np.full_like(weights, 1e-8), np.full_like(bias, 1e-8)
    for _ in range(EPOCHS):
        z = x[fit] @ weights + bias
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        error = (p - target[fit]) * cost[fit, None]
        gw, gb = x[fit].T @ error + DECAY * weights, error.sum(axis=0)
        sum_w += gw * gw
        sum_b += gb * gb
        weights -= RATE * gw / np.sqrt(sum_w)
        bias -= RATE * gb / np.sqrt(sum_b)
    best = (np.inf, 1.0)
    for temperature in np.geomspace(0.25, 4, 17):
        z = (x[aside] @ weights + bias) / temperature
        z -= z.max(axis=1, keepdims=True)
        loss = -(z[np.arange(len(aside)), y[aside]] - np.log(np.exp(z).sum(axis=1))).mean()
        best = min(best, (float(loss), float(temperature)))
    return Model(grams, weights.astype(float).round(6), bias.astype(float).round(6), best[1])


def _paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, th, n_paragraphs, paragraphs (lines that are not blank) of every row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"\S"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), F.size(lines).cast("long").alias("n_paragraphs"), lines.alias("p"))


def fit(docs: DataFrame, sample: int = SAMPLE_PARAGRAPHS) -> Model:
    """Train against at most ``sample`` distinct paragraphs of the corpus, those with the least hash, so that each run takes the same.

    Paragraphs above SAMPLE_LENGTH characters are no training rows, so that what comes to the driver is bounded in bytes.
    """
    share = min(1.0, 2 * sample / max(1, docs.count()))  # texts hold a paragraph at least, mostly; so no task sends many
    part = docs.where(F.pmod(F.xxhash64(F.col("text").cast("string")), F.lit(1 << 30)) < int(share * (1 << 30)))
    some = _paragraphs(part).select(F.explode("p").alias("p")).where(F.length("p") <= SAMPLE_LENGTH).distinct()
    rows = some.orderBy(F.xxhash64("p"), "p").limit(sample).collect()
    return train([r["p"] for r in rows])


def _words(p: Column) -> Column:
    return F.filter(F.split(F.translate(p, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "[^a-z0-9]+", -1), lambda w: w != "")


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, th, pos, family, probability, overlap, confirmed of every paragraph whose likeliest class is a family.

    ``pos`` counts the lines that are not blank from 0. Repeated rows give one set of results.
    """
    spark = docs.sparkSession
    k = len(FAMILIES)
    in_template = {f: {g for t in TEMPLATES[f] for g in grams_of(t)} for f in FAMILIES[1:]}
    rows = [(g, [float(v) for v in w]) for g, w in zip(model.grams, model.weights, strict=True)]
    weights = F.broadcast(spark.createDataFrame(rows, "gram string, w array<double>"))  # at most MAX_FEATURES rows
    every = sorted({g for grams in in_template.values() for g in grams})
    members = F.broadcast(spark.createDataFrame([(g, [g in in_template[f] for f in FAMILIES[1:]]) for g in every], "gram string, t array<boolean>"))
    gate = F.array(*[F.lit(g) for g in model.grams if " " not in g])

    lines = _paragraphs(docs).select("doc_id", "th", F.posexplode("p").alias("pos", "p")).select("doc_id", "th", "pos", _words(F.col("p")).alias("words"))
    lines = lines.where(F.arrays_overlap("words", gate)).dropDuplicates(["doc_id", "th", "pos"])
    pairs = F.when(F.size("words") > 1, F.zip_with(F.slice("words", 1, F.size("words") - 1), F.slice("words", 2, F.size("words") - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))
    grams = lines.withColumn("grams", F.array_distinct(F.concat("words", pairs)))
    cut = grams.select("doc_id", "th", "pos", F.size("grams").alias("n"), F.explode("grams").alias("gram"))
    joined = cut.join(weights, "gram", "left").join(members, "gram", "left").where("w IS NOT NULL OR t IS NOT NULL")
    sums = [F.sum(F.coalesce(F.get("w", F.lit(i)), F.lit(0.0))).alias(f"z{i}") for i in range(k)]
    shared = [F.sum(F.when(F.get("t", F.lit(i)), 1).otherwise(0)).alias(f"t{i + 1}") for i in range(k - 1)]
    summed = joined.groupBy("doc_id", "th", "pos").agg(F.first("n").alias("n"), *sums, *shared)
    scaled = [(F.col(f"z{i}") + float(model.bias[i])) / float(model.temperature) for i in range(k)]
    top = summed.select("*", F.array(*scaled).alias("z"), F.array(F.lit(0), *[F.col(f"t{i}") for i in range(1, k)]).alias("t"))
    best = top.withColumn("high", F.array_max("z")).withColumn("at", F.array_position("z", F.col("high")).cast("int"))
    total = F.aggregate("z", F.lit(0.0), lambda a, v: a + F.exp(v - F.col("high")))
    names = F.array(*[F.lit(f) for f in FAMILIES])
    out = best.where("at > 1").select("doc_id", "th", "pos", F.element_at(names, F.col("at")).alias("family"), (1 / total).alias("probability"), (F.element_at("t", F.col("at")) / F.col("n")).alias("overlap"))
    return out.withColumn("confirmed", (F.col("probability") >= LEAST) & (F.col("overlap") >= CONFIRM))


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, n_paragraphs, n_licensed, families, top_family, top_probability of every row of ``docs`` (doc_id, text).

    Only confirmed paragraphs count. Null and empty texts have no paragraphs; repeated rows get equal results; of
    families of equal probability the first in the paragraphs' order is the top one.
    """
    model = model or fit(docs)
    good = classify(docs, model).where("confirmed")
    by = good.groupBy("doc_id", "th").agg(
        F.count("*").alias("n_licensed"), F.array_join(F.array_sort(F.collect_set("family")), ",").alias("families"),
        F.max(F.struct(F.round("probability", 6).alias("p"), (-F.col("pos")).alias("pos"), "family")).alias("top"),
    )
    found = table(by.select("doc_id", "th", "n_licensed", "families", F.col("top.family").alias("top_family"), F.col("top.p").alias("top_probability")), "licences")
    rows = join_sized(_paragraphs(docs).select("doc_id", "th", "n_paragraphs"), found, ["doc_id", "th"], "left")
    return rows.select("doc_id", "n_paragraphs", F.coalesce("n_licensed", F.lit(0)).alias("n_licensed"), F.coalesce("families", F.lit("")).alias("families"), "top_family", "top_probability")


def op5_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
