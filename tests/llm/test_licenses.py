import re
from collections import Counter

import numpy as np
import pytest
from pyspark.ml.feature import HashingTF
from pyspark.sql import functions as F

from brindle.llm import licenses

LINES = {
    "released under the mit license": "MIT",
    "licensed under the apache license version 2 0": "Apache-2.0",
    "this work is licensed under the gnu general public license version 3": "GPL",
    "licensed under cc by nc 4 0": "CC-BY-NC",
    "all rights reserved": "Proprietary",
}


@pytest.fixture(scope="module")
def model(spark, llm_dir):
    return licenses.fit(spark.read.parquet(f"{llm_dir}/documents.parquet"))


def families(spark, model, texts):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, family string")
    return {r.doc_id: (r.families, r.n_notices) for r in licenses.document_families(docs, model).collect()}


def test_query_finds_the_planted_notices(spark, llm_dir):
    from brindle.llm.queries import op7_licenses

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{llm_dir}/documents.parquet").collect()}
    rows = op7_licenses(spark, llm_dir).collect()
    assert len(rows) == len(texts)
    hits = 0
    for r in rows:
        plain = " ".join(w for w in re.split(r"[\W_]+", texts[r.doc_id].lower()) if w)
        want = sorted({f for line, f in LINES.items() if line in plain})
        hits += bool(want)
        assert (r.families.split(",") if r.families else []) == want
    assert hits


def test_every_template_is_its_family(spark, model):
    texts = [(f, t) for f, group in licenses.TEMPLATES.items() for t in group]
    got = families(spark, model, [f"Some words before.\n{t}\nand after it" for _, t in texts])
    missed = [(t, got[i]) for i, (f, t) in enumerate(texts) if f not in got[i][0]]
    assert len(missed) <= 3, missed


def test_ordinary_text_and_odd_rows(spark, model):
    texts = [None, "", "\n\n", "the license to drive a car was renewed", "we reserved all rooms on the right", "word " * 30_000, "under the general public opinion", "RELEASED!! UNDER!! THE!! MIT!! LICENSE.!!"]
    got = families(spark, model, texts)
    assert [got[i] for i in range(7)] == [([], 0)] * 7
    assert got[7] == (["MIT"], 1)
    long = "ordinary words " * 500 + "Released under the MIT License. " + "more words " * 500
    assert families(spark, model, [long])[0][0] == ["MIT"]
    assert families(spark, model, []) == {}


def test_repeated_and_null_ids(spark, model):
    docs = spark.createDataFrame([(1, "All rights reserved."), (1, "plain"), (None, "Released under the MIT License.")], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.families) for r in licenses.document_families(docs, model).collect())
    assert got == [("1", ["Proprietary"]), ("1", ["Proprietary"]), ("None", ["MIT"])]


WRAPPED = {
    "MIT": """Copyright (c) 2020 Some Body

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.""",
    "BSD": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.""",
    "GPL": """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.""",
}


def test_wrapped_notices(spark, model):
    got = families(spark, model, [*WRAPPED.values(), *(t.replace("\n", "\r\n") for t in WRAPPED.values())])
    assert [got[i][0] for i in range(8)] == [[f] for f in WRAPPED] * 2


def test_notices_side_by_side(spark, model):
    texts = {
        "Licensed under the MIT License or the Apache License, Version 2.0.": ["Apache-2.0", "MIT"],
        "Released under the MIT License.\nLicensed under the Apache License, Version 2.0.": ["Apache-2.0", "MIT"],
        "Licensed under the GNU Lesser General Public License version 2": ["LGPL"],
        "Licensed under CC BY-NC 4.0.": ["CC-BY-NC"],
        "Released under the BSD license. All rights reserved.": ["BSD", "Proprietary"],
    }
    got = families(spark, model, list(texts))
    assert [got[i][0] for i in range(len(texts))] == list(texts.values())


def test_a_notice_counts_once_in_overlapping_windows(spark, model):
    around = "plain words of a story about rivers and hills " * 20
    twice = "Released under the MIT License.\nReleased under the MIT License."
    got = families(spark, model, [" ".join(around.split()[:n]) + " Released under the MIT License. " + around for n in range(24, 56, 4)] + [twice])
    assert [got[i] for i in range(8)] == [(["MIT"], 1)] * 8
    assert got[8] == (["MIT"], 2)


def plain_words(text):
    return [w for w in re.sub(r"[\W_]", " ", text.lower()).split() if w]


class Twin:
    """The scan of one text, written plainly; windows without a template are not scored, as they have no notice."""

    def __init__(self, model):
        self.weights = model.classifier.coefficientMatrix.toArray()
        self.shift = model.classifier.interceptVector.toArray()
        self.level = model.level
        self.place = HashingTF(numFeatures=licenses.FEATURES)
        self.known = {}
        self.templates = []
        for f, texts in licenses.TEMPLATES.items():
            for t in texts:
                w = plain_words(t)
                self.templates.append((f, list(dict.fromkeys(f"{a} {b}" for a, b in zip(w, w[1:], strict=False)))))

    def index(self, term):
        if term not in self.known:
            self.known[term] = self.place.indexOf(term)
        return self.known[term]

    def chances(self, words, pairs):
        rows = sorted({self.index(w) for w in words}) + sorted({licenses.FEATURES + self.index(p) for p in pairs})
        z = self.weights[:, rows].sum(axis=1) + self.shift
        e = np.exp(z - z.max())
        return dict(zip(licenses.FAMILIES, e / e.sum(), strict=True))

    def scan(self, text):
        """Family and place of every notice, with the best probability of its windows."""
        notices = {}
        for number, block in enumerate(re.split(r"\n\s*\n", text or "")):
            every = plain_words(block)
            for start in range(0, max(1, len(every) - licenses.SPAN + licenses.STEP), licenses.STEP):
                words = every[start : start + licenses.SPAN]
                pairs = [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]
                if not pairs:
                    continue
                hits = []
                for f, own in self.templates:
                    held = [p for p in own if p in pairs]
                    if len(held) >= licenses.CONTAINED * len(own) - 1e-12:
                        special = [p for p in own if not any(p in q for g, q in self.templates if g != f)]
                        key = next((p for p in special if p in pairs), held[0])
                        hits.append((f, key, any(p in pairs for p in special)))
                if not hits:
                    continue
                chances = self.chances(words, pairs)
                likeliest = max(licenses.FAMILIES[1:], key=lambda f: chances[f])
                present = {f for f, _, special in hits if special}
                for f, key, special in hits:
                    chance = chances[f] / sum(p for g, p in chances.items() if g == f or g not in present)
                    if chance >= self.level and (special or f == likeliest):
                        for i, p in enumerate(pairs):
                            if p == key:
                                notices[number, f, start + i] = max(chance, notices.get((number, f, start + i), 0))
        return notices


def test_every_row_against_a_plain_scan(spark, llm_dir, model):
    docs = spark.read.parquet(f"{llm_dir}/documents.parquet")
    twin = Twin(model)
    want = {r.doc_id: twin.scan(r.text) for r in docs.collect()}
    got = {}
    for r in licenses.scan(docs, model).collect():
        got.setdefault(r.doc_id, []).append((r.family, r.probability))
    assert sum(map(len, got.values())) > 5
    for i, notices in want.items():
        mine = sorted(got.get(i, []))
        assert Counter(f for f, _ in mine) == Counter(f for _, f, _ in notices)
        assert [p for _, p in mine] == pytest.approx([p for _, p in sorted((f, p) for (_, f, _), p in notices.items())], abs=1e-9)


def test_wrapped_and_mixed_notices_against_a_plain_scan(spark, model):
    around = "plain words of a story about rivers and hills " * 9
    texts = [*WRAPPED.values(), around + " Released under the MIT License. Licensed under the Apache License, Version 2.0. " + around, "All rights reserved " * 40]
    twin = Twin(model)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = Counter((r.doc_id, r.family) for r in licenses.scan(docs, model).collect())
    assert got == Counter((i, f) for i, t in enumerate(texts) for _, f, _ in twin.scan(t))


def test_level_is_calibrated_and_an_empty_table_has_a_model(spark, llm_dir, model):
    docs = spark.read.parquet(f"{llm_dir}/documents.parquet")
    plain = licenses.ordinary_paragraphs(docs, "doc_id", "text", licenses.SAMPLED, licenses.ORDINARY)
    assert 0 < model.level < 0.95 and plain.count() > 1000
    empty = licenses.fit(docs.limit(0))
    assert empty.level == 0.5
    assert families(spark, empty, ["Released under the MIT License.", "nothing at all", None])[1] == ([], 0)


def test_the_model_learns_from_every_document(spark):
    """1,000 documents of smaller hashes are plain; words of licences occur in ordinary windows of the others alone."""
    texts = spark.range(2400).select("id", F.concat(F.lit("a story of rivers number "), "id").alias("plain"), F.concat(F.lit("rivers software hills notice number "), "id").alias("other"))
    plain = texts.filter(F.xxhash64("plain") < 0).select("id", F.col("plain").alias("text")).limit(1000).toDF("doc_id", "text").localCheckpoint()
    other = texts.filter(F.xxhash64("other") > 0).select((F.col("id") + 10_000).alias("doc_id"), F.col("other").alias("text"))
    assert plain.count() == 1000
    one, two = licenses.fit(plain), licenses.fit(plain.unionByName(other))
    assert not np.allclose(one.classifier.coefficientMatrix.toArray(), two.classifier.coefficientMatrix.toArray(), atol=1e-6)
