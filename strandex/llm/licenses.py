"""Licence scan: a trained paragraph classifier, a calibrated unknown class, template confirmation.

Paragraphs (lines) become sets of word 1- to 3-grams. A multinomial logistic regression with
an elastic net, which keeps few n-grams, is trained on variants of the licence templates below
and, as the unknown class, on paragraphs of a bounded sample of documents and on sentences
that merely talk about licences. The odds of 'known' are calibrated by a second regression on
held-out variants. A paragraph is identified if the calibrated probability of being known is
at least 0.5 and the template of the predicted family that resembles it most shares at
least `least_overlap` of the shorter one's 2-grams.

Scoring is DataFrame code. Only a paragraph that the template comparison can confirm is scored: one
that shares two different 2-grams with the templates, or its only one. (With `least_overlap` of the
shorter one's 2-grams to share, and three in the shortest template, fewer cannot be enough.) Each 2-gram of a template has
an anchor, the rarer of its words, so paragraphs without an anchor are passed over
before their 2-grams are formed. No line is shuffled to be classified.

Defined results: null and empty texts have no paragraphs; repeated rows are scanned alike; a null
doc_id is scanned and stays null; paragraphs of any length are read whole; an empty table trains on the templates alone
and gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandex.llm._store import persist

#: Notices of each licence family.
TEMPLATES: dict[str, list[str]] = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "SPDX-License-Identifier: MIT",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "Licensed under the GNU General Public License, version 2.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "LGPL": [
        "Licensed under the GNU Lesser General Public License, version 2.1 or later.",
        "This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License.",
    ],
    "AGPL": ["Licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-only"],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Released under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0."],
    "ISC": ["Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted.", "Released under the ISC License."],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC0": ["To the extent possible under law, the author has waived all copyright and related rights to this work.", "Released under CC0 1.0 Universal, public domain dedication."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "Proprietary": ["All rights reserved. No part of this publication may be reproduced without prior written permission.", "Copyright. All rights reserved."],
}
#: Sentences that talk of licences without granting one.
NOT_LICENCES: list[str] = [
    "You need a driving license to rent a car in this country.",
    "Please read the license before you install the program.",
    "The license fee is due at the end of the month.",
    "Version 2.0 of the program was released under pressure of time.",
    "The public library is free for everyone and open to the general public.",
    "He was granted permission to use the source of the river.",
    "The foundation published a free work on software of the world.",
    "Her license was not renewed and all hope was lost.",
    "They work under the terms of the contract and any later change.",
    "The copyright debate went on in parliament for the whole year.",
    "A poetic licence permits the author to bend the rules.",
    "The company sells commercial licenses and support for its product.",
]


def tokens(text: Column) -> Column:
    """Lower-case words of letters and digits."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def grams(words: Column, sizes: tuple[int, ...] = (1, 2, 3)) -> Column:
    """The distinct word n-grams of the given sizes."""

    def of(n: int) -> Column:
        join = lambda i: F.concat_ws(" ", *(F.get(words, i + j) for j in range(n)))
        return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(0), F.size(words) - n), join)).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(*(of(n) for n in sizes)))


def paragraphs(text: Column) -> Column:
    """The lines of a text."""
    return F.split(F.coalesce(text, F.lit("")), "\n")


def shared_part(ours: Column, theirs: Column) -> Column:
    """The share of the shorter one's n-grams that two paragraphs have in common."""
    return F.size(F.array_intersect(ours, theirs)) / F.greatest(F.lit(1), F.least(F.size(ours), F.size(theirs)))


def resembling(lines: DataFrame, least: float = 0.3) -> DataFrame:
    """lines (line_id, words) -> line_id of those that share two 2-grams, and the share `least` of the shorter one's, with a template."""
    pairs = lines.select("line_id", F.explode(grams(F.col("words"), (2,))).alias("pair"))
    given = [(n, pair, len(_pairs(t))) for n, t in enumerate(x for texts in TEMPLATES.values() for x in texts) for pair in _pairs(t)]
    theirs = F.broadcast(lines.sparkSession.createDataFrame(given, "template int, pair string, theirs int"))
    sizes = pairs.groupBy("line_id").agg(F.count("*").alias("ours"))
    shared = pairs.join(theirs, "pair").groupBy("line_id", "template").agg(F.count("*").alias("n"), F.max("theirs").alias("theirs")).filter("n >= 2")
    return shared.join(sizes, "line_id").filter(F.col("n") >= least * F.least("ours", "theirs")).select("line_id").distinct()


def _pairs(text: str) -> list[str]:
    w = [x for x in re.split("[^a-z0-9]+", text.lower()) if x]
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(w, w[1:])))


@dataclass
class LicenceModel:
    """Families, the n-gram counter and regression over it, the calibration and the anchor words."""

    families: list[str]
    counter: CountVectorizerModel
    regression: LogisticRegressionModel
    slope: float
    shift: float
    anchors: list[str]


def train_licences(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = 300, variants: int = 32, vocabulary: int = 4096) -> LicenceModel:
    """Fit on the templates and on the paragraphs of at most sample_docs documents (lowest id hashes).

    Features are the n-grams of the templates and the `vocabulary` most frequent ones.
    """
    spark = docs.sparkSession
    families = ["unknown", *TEMPLATES]
    given = [(families.index(f), t) for f, texts in TEMPLATES.items() for t in texts] + [(0, t) for t in NOT_LICENCES]
    templates = spark.createDataFrame(given, "label int, text string").select("label", tokens(F.col("text")).alias("words"))
    # Variants lose up to a fifth of their words; the first of each template loses none.
    each = templates.withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(variants - 1))))
    lost = lambda w, i: F.pmod(F.xxhash64(F.col("variant"), i, w), F.lit(100)) >= F.when(F.col("variant") == 0, 0).otherwise(F.col("variant") % 4 * 6)
    varied = each.select("label", "variant", F.filter("words", lost).alias("words"))
    ids = docs.select(F.col(id_col).alias("id")).filter("id is not null").distinct().orderBy(F.xxhash64("id"), "id").limit(sample_docs)
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(ids), "id").dropDuplicates(["id"])
    lines = sample.select(F.posexplode(paragraphs(F.col("text"))).alias("n", "line"))
    # Lines of the sample that may be licences themselves are no examples of the unknown.
    talk = F.arrays_overlap("words", F.array(*map(F.lit, ("license", "licence", "licensed", "licensing", "copyright", "spdx"))))
    worded = lines.select((F.col("n") % variants).alias("variant"), tokens(F.col("line")).alias("words"), F.monotonically_increasing_id().alias("line_id")).filter(F.size("words") > 0)
    worded = persist(worded, "licence-lines")
    quiet = worded.filter(~talk)
    plain = quiet.join(resembling(quiet), "line_id", "left_anti").select(F.lit(0).alias("label"), "variant", "words")
    # The words are written before n-grams are formed, so that they are cut once.
    given_rows = persist(varied.withColumn("sampled", F.lit(False)).unionByName(plain.withColumn("sampled", F.lit(True))), "licence-words")
    rows = persist(given_rows.select("label", "variant", grams(F.col("words")).alias("grams"), "words", "sampled"), "licence-train")
    held = F.col("variant") % 4 == 3
    counted = CountVectorizer(inputCol="grams", outputCol="features", binary=True, minDF=2.0, vocabSize=vocabulary).fit(rows.filter(~held))
    theirs = templates.filter("label > 0").select(F.explode(grams(F.col("words"))).alias("g")).distinct().collect()  # bounded by TEMPLATES
    features = sorted({*counted.vocabulary, *(r["g"] for r in theirs)})
    lines_of = rows.filter("sampled").select(F.explode(F.array_distinct("words")).alias("w"))
    known = sorted({p for texts in TEMPLATES.values() for t in texts for p in _pairs(t)})
    listed = F.broadcast(spark.createDataFrame([(w,) for w in sorted({w for p in known for w in p.split()})], "w string"))
    frequency = {r["w"]: r["count"] for r in lines_of.join(listed, "w").groupBy("w").count().collect()}  # at most the templates' words
    anchors = sorted({min(p.split(), key=lambda w: (frequency.get(w, 0), w)) for p in known})
    counted = CountVectorizerModel.from_vocabulary(features, "grams", "features", binary=True)
    table = counted.transform(rows).select("features", "label", held.alias("held"))
    table = persist(table.coalesce(4), "licence-table")
    model = LogisticRegression(family="multinomial", regParam=0.002, elasticNetParam=0.5, maxIter=60, standardization=False).fit(table.filter("not held"))
    unknown = vector_to_array("probability")[0]
    margin = F.log((1 - unknown + 1e-9) / (unknown + 1e-9))
    scored = model.transform(table.filter("held")).select(margin.alias("margin"), (F.col("label") > 0).cast("double").alias("label"))
    scored = VectorAssembler(inputCols=["margin"], outputCol="features").transform(scored)
    calibration = LogisticRegression(regParam=1e-4, maxIter=50).fit(scored)
    return LicenceModel(families, counted, model, float(calibration.coefficients[0]), float(calibration.intercept), anchors)


def scan_paragraphs(docs: DataFrame, model: LicenceModel, *, id_col: str = "doc_id", text_col: str = "text", least_overlap: float = 0.6) -> DataFrame:
    """doc_id, text_hash, paragraph, line, family, probability, template_overlap, confirmed: the paragraphs that resemble some template and are not unknown."""
    if not 0.6 <= least_overlap <= 1:
        raise ValueError("least_overlap must be in 0.6..1")
    spark: SparkSession = docs.sparkSession
    lines = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.posexplode(paragraphs(F.col(text_col))).alias("paragraph", "line"))
    # A generator keeps the words a column: inside the n-grams they would be cut anew for every word.
    worded = lines.withColumn("words", F.explode(F.array(tokens(F.col("line"))))).filter(F.arrays_overlap("words", F.array(*map(F.lit, model.anchors or [""]))))
    every = F.array(*(F.lit(p) for p in sorted({p for texts in TEMPLATES.values() for t in texts for p in _pairs(t)})))
    paired = worded.withColumn("pairs", grams(F.col("words"), (2,)))
    able = paired.filter(F.size(F.array_intersect("pairs", every)) >= F.greatest(F.lit(1), F.least(F.size("pairs"), F.lit(2))))
    scored = model.regression.transform(model.counter.transform(able.withColumn("grams", grams(F.col("words")))))
    e = scored.select("doc_id", "text_hash", "paragraph", "line", "words", vector_to_array("probability").alias("e"))
    unknown = F.col("e")[0]
    margin = F.log((1 - unknown + 1e-9) / (unknown + 1e-9))
    known = F.slice("e", 2, len(model.families) - 1)
    family = F.get(F.array(*map(F.lit, model.families[1:])), (F.array_position(known, F.array_max(known)) - 1).cast("int"))
    probability = 1 / (1 + F.exp(-(margin * model.slope + model.shift)))
    judged = e.select("doc_id", "text_hash", "paragraph", "line", "words", family.alias("family"), probability.alias("probability")).filter("probability >= 0.5")
    listed = spark.createDataFrame(list(TEMPLATES.items()), "family string, templates array<string>")
    theirs = F.broadcast(listed.select("family", F.transform("templates", lambda t: grams(tokens(t), (2,))).alias("theirs")))
    compared = judged.join(theirs, "family").withColumn("pairs", grams(F.col("words"), (2,)))
    overlap = F.array_max(F.transform("theirs", lambda t: shared_part(F.col("pairs"), t)))
    found = compared.withColumn("template_overlap", overlap).withColumn("confirmed", F.col("template_overlap") >= least_overlap)
    return found.select("doc_id", "text_hash", "paragraph", "line", "family", "probability", "template_overlap", "confirmed")


def scan_documents(docs: DataFrame, model: LicenceModel, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, n_paragraphs, n_licences, licences: one row a document, with its confirmed families in order."""
    found = scan_paragraphs(docs, model, id_col=id_col, text_col=text_col, **options).filter("confirmed").dropDuplicates(["doc_id", "text_hash", "paragraph"])
    per = found.groupBy(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash")).agg(F.count("*").alias("n_licences"), F.array_sort(F.collect_set("family")).alias("licences"))
    filled = F.size(F.filter(paragraphs(F.col(text_col)), lambda x: F.length(F.trim(x)) > 0)).cast("long")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("hash"), filled.alias("n_paragraphs"))
    joined = rows.join(per, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("hash") == F.col("_hash")), "left")
    return joined.select("doc_id", "n_paragraphs", F.coalesce("n_licences", F.lit(0)).cast("long").alias("n_licences"), F.coalesce("licences", F.array().cast("array<string>")).alias("licences"))
