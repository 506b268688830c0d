"""Licence scans: a trained paragraph classifier, confirmed by templates; DataFrame, SQL and pyspark.ml functions only.

A document is cut at blank lines into paragraphs, so that a hard-wrapped notice stays whole, and paragraphs of more than 48
words into overlapping windows, so that no notice drowns in a long one. A multinomial logistic regression over hashed word 1- and 2-grams gives each paragraph the probability of every
licence family and of the class unknown. It is trained on templates (whole, with words left out, and between words of
ordinary text) and on three fourths of all ordinary windows of the corpus, those without a word pair of a template. The rest
calibrate the level. A family counts only if its probability reaches a level calibrated on the ordinary
windows kept out of training: what all but one in a thousand of them stay under. Every family is held against its templates: it stands if the window contains at least 70 %
of the word pairs of one of them; everything else is unknown. Families named side by side do not compete: a family's
probability is taken without the other families that have a contained template with a word pair of their own, found in no
other family's templates, and a family that is not the likeliest needs such a pair itself. As both conditions must hold, only
windows that contain a template are given to the classifier: the result is the same in either order. A notice seen by two windows is one notice, known by the place of its word pair.

Edge cases: null and empty texts have no paragraph and no family; paragraphs without a word are skipped; rows that share an
id share their findings, a null id is an id like any other; without ordinary paragraphs kept aside the level is 0.5; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF, NGram, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import cut

SPAN, STEP = 48, 32
FEATURES, VARIANTS, SAMPLED, ORDINARY, CONTAINED = 1 << 11, 24, 1000, 6000, 0.7
UNKNOWN = "unknown"

#: Usual notices of each family.
TEMPLATES: dict[str, list[str]] = {
    "MIT": [
        "Released under the MIT License.", "This project is licensed under the MIT License", "Licensed under the MIT license.", "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0", "This project is licensed under the Apache License 2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS",
        "See the License for the specific language governing permissions and limitations under the License.",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License version 2", "SPDX-License-Identifier: GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU General Public License along with this program.",
    ],
    "LGPL": ["Licensed under the GNU Lesser General Public License", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "SPDX-License-Identifier: LGPL-3.0-only"],
    "AGPL": ["Licensed under the GNU Affero General Public License", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "SPDX-License-Identifier: AGPL-3.0-only"],
    "BSD": [
        "Licensed under the BSD 3-Clause License", "Released under the BSD license.", "SPDX-License-Identifier: BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "MPL": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0", "If a copy of the MPL was not distributed with this file, You can obtain one at", "SPDX-License-Identifier: MPL-2.0"],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "Licensed under CC BY-NC-SA 4.0."],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "Public-Domain": ["This work is dedicated to the public domain under CC0 1.0", "This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: CC0-1.0"],
    "ISC": ["Licensed under the ISC License", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "provided that the above copyright notice and this permission notice appear in all copies"],
    "Proprietary": ["All rights reserved.", "Copyright. All rights reserved.", "Proprietary and confidential. Unauthorized copying is strictly prohibited.", "No part of this publication may be reproduced without prior written permission"],
}
FAMILIES = [UNKNOWN, *sorted(TEMPLATES)]


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def word_pairs(words: Column) -> Column:
    """Distinct pairs of adjoining words."""
    less = F.greatest(F.size(words) - 1, F.lit(0))
    return F.array_distinct(F.zip_with(F.slice(words, F.lit(1), less), F.slice(words, F.lit(2), less), lambda a, b: F.concat_ws(" ", a, b)))


def paragraphs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, row, paragraph, start and words of every paragraph: lines up to a blank one, longer paragraphs in overlapping windows."""
    rows = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text"))
    blocks = rows.select("id", "row", F.posexplode(F.split("text", r"\n\s*\n")).alias("paragraph", "block"))
    split = blocks.select("id", "row", "paragraph", words_of(F.col("block")).alias("words")).filter(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - SPAN + STEP), F.lit(STEP))
    windows = split.select("id", "row", "paragraph", "words", F.explode(starts).alias("start"))
    return windows.withColumn("words", F.slice("words", F.col("start"), F.lit(SPAN)))


def _features() -> PipelineModel:
    return PipelineModel([
        NGram(n=2, inputCol="words", outputCol="pairs"),
        HashingTF(numFeatures=FEATURES, binary=True, inputCol="words", outputCol="single"),
        HashingTF(numFeatures=FEATURES, binary=True, inputCol="pairs", outputCol="double"),
        VectorAssembler(inputCols=["single", "double"], outputCol="features"),
    ])


def template_pairs(spark: SparkSession) -> list[tuple[str, list[str]]]:
    """Family and word pairs of each template; as many lines as TEMPLATES has, so that plans hold them as one constant."""
    rows = spark.createDataFrame([(f, t) for f, texts in TEMPLATES.items() for t in texts], "family string, text string")
    return [(r.family, r.pairs) for r in rows.select("family", word_pairs(words_of(F.col("text"))).alias("pairs")).collect()]


@dataclass
class Model:
    """A fitted classifier and the level that a family's probability must reach."""

    classifier: LogisticRegressionModel
    level: float


def ordinary_paragraphs(docs: DataFrame, id_col: str, text_col: str, sampled: int | None = None, ordinary: int | None = None) -> DataFrame:
    """Windows (words, order, held) without a word pair of a template; held are their words that templates have.

    All windows of all rows; with the limits, at most ``ordinary`` distinct ones of the ``sampled`` documents with the smallest hashes.
    """
    rows = docs.filter(F.length(text_col) > 0)
    if sampled is not None:
        hashed = rows.withColumn("order__", F.xxhash64(text_col))
        last = hashed.select("order__").orderBy("order__").limit(sampled).agg(F.max("order__")).first()[0]  # one number a row, whatever the texts
        rows = hashed.filter(F.col("order__") <= F.lit(last)).drop("order__")
    known = sorted({p for _, pairs in template_pairs(docs.sparkSession) for p in pairs})
    words = sorted({w for p in known for w in p.split()})
    windows = paragraphs(rows, id_col, text_col).filter(F.size("words") > 1).select("words")
    windows = _once(windows, held=F.array_intersect(F.array(*map(F.lit, words)), F.col("words")))
    less = F.size("words") - 1
    in_order = F.zip_with(F.slice("words", F.lit(1), less), F.slice("words", F.lit(2), less), lambda a, b: F.concat_ws(" ", a, b))
    plain = windows.filter((F.size("held") < 2) | ~F.arrays_overlap(in_order, F.array(*map(F.lit, known)))).select("words", F.xxhash64("words").alias("order"), "held")
    return plain if ordinary is None else cut(plain.dropDuplicates(["order"]).orderBy("order").limit(ordinary))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ordinary: int = ORDINARY) -> Model:
    """Trains on variants of the templates and on three fourths of all ordinary windows of docs; the others calibrate the level.

    Of a window, only words and pairs that templates have are learned from, so that windows with the same ones are one row with a
    weight: one pass over docs counts them all. Together they weigh as much as three fourths of ``ordinary`` rows, or as they are.
    """
    spark: SparkSession = docs.sparkSession
    rows = [(FAMILIES.index(f), t) for f, texts in TEMPLATES.items() for t in texts]
    templates = spark.createDataFrame(rows, "label int, text string").select("label", words_of(F.col("text")).alias("words"))
    aside = F.pmod(F.col("order"), F.lit(4)) == 0
    plain = cut(ordinary_paragraphs(docs, id_col, text_col).groupBy(F.col("held").alias("words"), aside.alias("aside")).agg(F.count(F.lit(1)).alias("n")))
    total = plain.filter("NOT aside").agg(F.sum("n")).first()[0] or 1
    near = plain.select("words").distinct().orderBy(F.xxhash64("words")).limit(64).agg(F.sort_array(F.collect_list("words")).alias("ordinary"))
    variants = templates.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(VARIANTS - 1))))
    drawn = lambda w, i: (F.col("k") < 4) | (F.pmod(F.xxhash64(w, i, F.col("k")), F.lit(10)) > 0)
    around = F.coalesce(F.try_element_at("ordinary", F.pmod(F.xxhash64("k", "words"), F.lit(64)).cast("int") + 1), F.array().cast("array<string>"))
    half = (F.size(around) / 2).cast("int")
    placed = F.when(F.col("k") % 2 == 0, F.filter("words", drawn)).otherwise(F.concat(F.slice(around, F.lit(1), F.least(half, F.lit(16))), F.filter("words", drawn), F.slice(around, half + 1, F.lit(16))))
    known = F.array(*map(F.lit, sorted({p for _, pairs in template_pairs(spark) for p in pairs})))
    made = variants.join(F.broadcast(near)).select("label", placed.alias("words"), F.lit(1.0).alias("weight")).filter(F.size("words") > 0)
    made = made.withColumn("pairs", F.array_intersect(word_pairs(F.col("words")), known))
    single = plain.withColumn("pairs", F.array().cast("array<string>"))  # an ordinary window has no pair of a template
    weight = F.col("n") * F.lit(min(1.0, 0.75 * ordinary / total))
    rows = made.unionByName(single.filter("NOT aside").select(F.lit(0).alias("label"), "words", weight.alias("weight"), "pairs"))
    features = PipelineModel(_features().stages[1:])
    ready = cut(features.transform(rows.repartition(2)).select(F.col("label").cast("double"), "features", "weight"))
    classifier = LogisticRegression(family="multinomial", regParam=2e-4, maxIter=20, standardization=False, weightCol="weight").fit(ready)
    scored = classifier.transform(features.transform(single.filter("aside")))
    best = F.array_max(F.slice(vector_to_array("probability"), F.lit(2), F.lit(len(FAMILIES))))
    level = scored.agg(F.percentile(best, F.lit(0.999), F.col("n"))).first()[0]
    return Model(classifier, 0.5 if level is None else min(0.95, level))


def signals(pairs: list[tuple[str, list[str]]]) -> list[str]:
    """Words of which every window that contains a template has one: of each template, so many pairs that not all can be missing."""
    found = set()
    for _, own in pairs:
        spare = len(own) - math.ceil(CONTAINED * len(own) - 1e-9)
        found |= {max(pair.split(), key=len) for pair in sorted(own, key=lambda p: -max(map(len, p.split())))[: spare + 1]}
    return sorted(found)


def _once(df: DataFrame, **made: Column) -> DataFrame:
    """df with further columns that later filters cannot pull apart and compute again."""
    for name, column in made.items():
        df = df.select("*", F.explode(F.array(column)).alias(name))
    return df


def candidates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Windows that contain a template, with hits: family, the places of the word pair that it is known by, and whether that pair is its own."""
    templates = template_pairs(docs.sparkSession)
    others = lambda f: {p for g, pairs in templates if g != f for p in pairs}
    strings = lambda found: F.array(*map(F.lit, found)).cast("array<string>")
    known = F.array(*(F.struct(F.lit(f).alias("family"), strings(pairs).alias("pairs"), strings([p for p in pairs if p not in others(f)]).alias("own")) for f, pairs in templates))
    windows = paragraphs(docs, id_col, text_col).filter(F.size("words") > 1).filter(F.arrays_overlap("words", strings(signals(templates))))
    less = F.size("words") - 1
    in_order = F.zip_with(F.slice("words", F.lit(1), less), F.slice("words", F.lit(2), less), lambda a, b: F.concat_ws(" ", a, b))
    windows = _once(_once(windows, in_order=in_order), held=F.array_distinct("in_order"))
    contained = lambda t: F.size(F.array_intersect(t["pairs"], F.col("held"))) >= CONTAINED * F.size(t["pairs"])
    key = lambda t: F.coalesce(F.try_element_at(F.array_intersect(t["own"], F.col("held")), F.lit(1)), F.try_element_at(F.array_intersect(t["pairs"], F.col("held")), F.lit(1)))
    keyed = lambda t: F.struct(t["family"].alias("family"), key(t).alias("key"), F.arrays_overlap(t["own"], F.col("held")).alias("own"))
    found = _once(windows, known=F.filter(known, contained)).filter(F.size("known") > 0)
    found = _once(found, keys=F.transform("known", keyed))
    places = lambda k: F.filter(F.transform("in_order", lambda p, i: F.when(p == k["key"], F.col("start") + i)), lambda i: i.isNotNull())
    hits = F.transform("keys", lambda k: F.struct(k["family"].alias("family"), k["own"].alias("own"), places(k).alias("places")))
    return _once(found, hits=hits).select("id", "row", "paragraph", "words", "hits")


def scan(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, family and probability of every notice: each place of a family that its window's probability and a template confirm."""
    scored = model.classifier.setProbabilityCol("probability").transform(_features().transform(candidates(docs, id_col, text_col)))
    scored = _once(scored.select("id", "row", "paragraph", "hits", "probability"), chances=vector_to_array("probability"))
    names = F.array(*map(F.lit, FAMILIES))
    likeliest = F.element_at(names, F.array_position("chances", F.array_max(F.slice("chances", 2, len(FAMILIES)))).cast("int"))
    present = F.transform(F.filter("hits", lambda h: h["own"]), lambda h: h["family"])
    scored = _once(scored, likeliest=likeliest, present=present).select("id", "row", "paragraph", "chances", "likeliest", "present", F.explode("hits").alias("hit"))
    counted = lambda name, p: F.when((name == F.col("hit.family")) | ~F.array_contains("present", name), p).otherwise(0.0)
    whole = F.aggregate(F.zip_with(names, "chances", counted), F.lit(0.0), lambda a, p: a + p)
    own = F.element_at("chances", F.array_position(names, F.col("hit.family")).cast("int"))
    scored = _once(scored, chance=F.try_divide(own, whole)).filter(F.col("chance") >= model.level)
    held = scored.filter(F.col("hit.own") | (F.col("hit.family") == F.col("likeliest")))
    places = held.select("id", "row", "paragraph", "hit.family", "chance", F.explode("hit.places").alias("place"))
    notices = places.groupBy("id", "row", "paragraph", "family", "place").agg(F.max("chance").alias("probability"))
    return notices.select(F.col("id").alias(id_col), "family", "probability")


def document_families(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, families (sorted, distinct) and n_notices of every row; only confirmed notices are shuffled."""
    found = scan(docs, model, id_col, text_col).groupBy(F.col(id_col).alias("found_id"))
    found = found.agg(F.array_sort(F.collect_set("family")).alias("families"), F.count(F.lit(1)).alias("n_notices"))
    joined = docs.select(id_col).join(found, F.col(id_col).eqNullSafe(F.col("found_id")), "left")
    return joined.select(id_col, F.coalesce("families", F.array().cast("array<string>")).alias("families"), F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"))
