"""License scans by a trained paragraph classifier, in DataFrame functions and Spark ML only.

Features are the word pairs and triples of licence texts.  A sparse multinomial logistic
regression learns the families and an unknown class from pieces of those texts and from all of the
corpus's own paragraphs.  Paragraphs with the same known features are one example that weighs as many, so
that training reads few rows.  The probability needed to accept a family is calibrated on all
paragraphs of unknown kind, each judged by a model of the other half, and a prediction stands only if
enough of the paragraph's features occur in the texts of that family.
"""

from __future__ import annotations

import re
import uuid

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer, Normalizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import Scratch

UNKNOWN = "unknown"
#: More features than this are an error: they bound the table sent to every task.
FEATURES = 6_000
#: Least share of a paragraph's features found in the family's texts.
LEAST_OVERLAP = 0.5
#: Share of unknown paragraphs that may pass the probability threshold before comparison, and
#: the bound of that threshold: beyond it the comparison with the texts decides alone.
FALSE_RATE, MOST_THRESHOLD = 0.001, 0.8

# Notices and opening paragraphs of public licences, and lines of no licence.
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT License."),
    ("mit", "This project is licensed under the terms of the MIT license."),
    ("mit", "The MIT License (MIT)"),
    ("mit", "SPDX-License-Identifier: MIT"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "Released under the Apache License 2.0."),
    ("apache", "SPDX-License-Identifier: Apache-2.0"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("gpl", "You should have received a copy of the GNU General Public License along with this program. If not, see http://www.gnu.org/licenses/"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This software is licensed under the GNU General Public License, version 2."),
    ("gpl", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("lgpl", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("lgpl", "SPDX-License-Identifier: LGPL-3.0-only"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("bsd", "Licensed under the BSD 3-Clause License."),
    ("bsd", "SPDX-License-Identifier: BSD-3-Clause"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("mpl", "SPDX-License-Identifier: MPL-2.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-nc", "To view a copy of this license, visit http://creativecommons.org/licenses/by-nc/4.0/"),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by", "To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/"),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    (UNKNOWN, "All rights reserved."),
    (UNKNOWN, "Copyright by the author. All rights reserved. No part may be reproduced without permission of the publisher."),
    (UNKNOWN, "The license of the restaurant was renewed by the city council under the new rules."),
    (UNKNOWN, "You need a driving license to rent a car, and the warranty of the dealer does not cover tires."),
    (UNKNOWN, "The software is sold with a warranty of two years and a free copy of the manual."),
]


def words_of(text: Column) -> Column:
    """Letters and digits of a text in lower case, as an array of words."""
    return F.array_remove(F.split(F.lower(text), "[^a-z0-9]+"), "")


def pairs_of(words: Column) -> Column:
    """Hashes of the word pairs."""
    n = F.size(words)
    second = F.slice(words, 2, F.greatest(n, F.lit(1)))
    return F.slice(F.zip_with(words, second, lambda a, b: F.xxhash64(a, b)), 1, F.greatest(n - 1, F.lit(0)))


def triples_of(words: Column) -> Column:
    """Hashes of the word triples."""
    n = F.size(words)
    second = F.slice(words, 2, F.greatest(n, F.lit(1)))
    third = F.slice(words, 3, F.greatest(n, F.lit(1)))
    triples = F.zip_with(F.zip_with(words, second, lambda a, b: F.struct(a.alias("a"), b.alias("b"))), third,
                         lambda x, c: F.xxhash64(x["a"], x["b"], c))
    return F.slice(triples, 1, F.greatest(n - 2, F.lit(0)))


def grams_of(words: Column) -> Column:
    """Hashes of the word pairs and triples."""
    return F.concat(pairs_of(words), triples_of(words))


def paragraphs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, row, paragraph, line): the lines of each text that have two words; ``row`` tells repeated rows apart."""
    lines = docs.where(F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"),
        F.posexplode(F.split(text_col, r"[\r\n]+")).alias("paragraph", "line"))
    return lines.where(F.col("line").rlike("[A-Za-z0-9][^A-Za-z0-9]+[A-Za-z0-9]"))


def possible(lines: DataFrame, features: list[int]) -> DataFrame:
    """Those lines, with ``words``, of which half of the features may be known.

    Found inside the row, before anything is copied per feature.  Of w words, half of the w - 1 pairs and w - 2
    triples are known only if w / 2 pairs are (each known triple holds two of them), hence more
    than w / 2 of the words.
    """
    vocabulary = sorted({w for _, text in TEMPLATES for w in re.split("[^a-z0-9]+", text.lower()) if w})
    n = F.size("words")
    few = lines.withColumn("words", words_of(F.col("line"))).drop("line").where(
        F.size(F.filter("words", lambda w: w.isin(vocabulary))) * 2 > n)
    return few.where(F.size(F.filter(pairs_of(F.col("words")), lambda g: g.isin(features))) * 2 >= n)


def unknown_paragraphs(lines: DataFrame, features: list[int]) -> DataFrame:
    """(fold, grams, lines): the number of lines of unknown kind that have those known features, sorted, repeats kept.

    A line is of unknown kind unless half of its features are in licence texts.  ``fold`` is one of two halves of the lines.
    """
    words = lines.select(F.pmod(F.xxhash64(F.lit("sample"), "id", "paragraph", "line"), F.lit(2)).alias("fold"),
                         words_of(F.col("line")).alias("words"))
    pairs = words.withColumn("pairs", F.filter(pairs_of(F.col("words")), lambda g: g.isin(features)))
    # a known triple holds two known pairs
    triples = F.filter(triples_of(F.col("words")), lambda g: g.isin(features))
    known = pairs.select("fold", F.size("words").alias("n"), F.array_sort(
        F.when(F.size("pairs") < 2, F.col("pairs")).otherwise(F.concat("pairs", triples))).alias("grams"))
    # n words have 2 n - 3 features
    unknown = (F.size("grams") == 0) | (F.size("grams") * 2 < F.col("n") * 2 - 3)
    return known.groupBy("fold", "grams").agg(F.count_if(unknown).alias("lines")).where("lines > 0")


def _pieces(spark: SparkSession) -> DataFrame:
    """(family, words): every licence text whole, and its pieces of 6, 12 and 24 words from every third word."""
    whole = spark.createDataFrame(TEMPLATES, "family string, text string").select("family", words_of(F.col("text")).alias("words"))
    cut = whole.select("family", "words", F.explode(F.array(*[F.lit(x) for x in (6, 12, 24)])).alias("size")).where(
        F.size("words") > F.col("size")).select("family", "words", "size", F.explode(
            F.sequence(F.lit(1), F.size("words") - F.col("size") + 1, F.lit(3))).alias("start"))
    return whole.union(cut.select("family", F.slice("words", F.col("start"), F.col("size"))))


class Classifier:
    """Weights per feature and family, as a bounded table, with the calibrated threshold."""

    def __init__(self, families: list[str], weights: DataFrame, intercepts: list[float]):
        self.families, self.weights, self.intercepts, self.threshold = families, weights, intercepts, 0.5
        self.features = [r["gram"] for r in weights.select("gram").collect()]  # FEATURES at most

    def scored(self, rows: DataFrame, keys: list[str]) -> DataFrame:
        """``keys`` with family, probability and overlap of each paragraph that has a known feature."""
        return self.scored_grams(rows.withColumn("grams", grams_of(F.col("words"))), keys)

    def scored_grams(self, rows: DataFrame, keys: list[str]) -> DataFrame:
        """The same from the features of paragraphs; the overlap is the share of those given."""
        k = range(len(self.families))
        grams = rows.select(*keys, F.size("grams").alias("n"), F.explode("grams").alias("gram"))
        # the table has FEATURES rows at most
        met = grams.join(F.broadcast(self.weights), "gram").groupBy(*keys, "n").agg(
            *[F.sum(F.col("w")[i]).alias(f"w{i}") for i in k], *[F.sum(F.col("has")[i]).alias(f"h{i}") for i in k],
            F.count(F.lit(1)).alias("met"))
        # unit length of the counts is taken as in training: one of each feature
        z = F.array(*[F.col(f"w{i}") / F.sqrt("met") + F.lit(self.intercepts[i]) for i in k])
        met = met.withColumn("z", z).withColumn("z", F.transform("z", lambda x: F.exp(x - F.array_max("z"))))
        p = F.transform("z", lambda x: x / F.aggregate("z", F.lit(0.0), lambda a, b: a + b))
        met = met.withColumn("p", p).withColumn("best", F.array_position("p", F.array_max("p")).cast("int"))
        return met.select(*keys, F.element_at(F.array(*[F.lit(f) for f in self.families]), F.col("best")).alias("family"),
                          F.array_max("p").alias("probability"),
                          (F.element_at(F.array(*[F.col(f"h{i}") for i in k]), F.col("best")) / F.col("n")).alias("overlap"))


def least_threshold(scores: DataFrame, most: int) -> float | None:
    """The least multiple of 2**-30 that the probabilities of at most ``most`` lines reach; None if there are no more lines.

    ``scores`` has probability and lines.  Found in two counts by 15 bits each, 32,769 rows at most.
    """
    whole = scores.select(F.floor(F.col("probability") * float(1 << 30)).alias("at"), "lines")
    above, high = 0, None
    for bits in (whole.select(F.shiftright("at", 15).alias("bin"), "at", "lines"), whole.select(F.col("at").alias("bin"), "at", "lines")):
        within = bits if high is None else bits.where(F.shiftright("at", 15) == high)
        for r in sorted(within.groupBy("bin").agg(F.sum("lines").alias("lines")).collect(), key=lambda r: -r["bin"]):
            if above + r["lines"] > most:
                high = r["bin"]
                break
            above += r["lines"]
        else:
            return None
    return (high + 1) / (1 << 30)


def fit(lines: DataFrame, scratch: Scratch) -> Classifier:
    """Trains on licence pieces and all corpus paragraphs of unknown kind, and calibrates on all of these.

    Paragraphs of the corpus count as unknown unless half of their features are in licence texts.  For the
    calibration each half of them is judged by a model trained on the pieces and the other half.
    """
    spark = lines.sparkSession
    pieces = _pieces(spark).withColumn("grams", grams_of(F.col("words")))
    known = pieces.where(F.col("family") != UNKNOWN)
    has = known.select("family", F.explode("grams").alias("gram")).distinct()
    features = scratch.keep(has.groupBy("gram").agg(F.collect_set("family").alias("families")), "features")
    if features.count() > FEATURES:
        raise ValueError(f"the licence texts have more than {FEATURES} word pairs and triples")
    grams = [r["gram"] for r in features.select("gram").collect()]  # FEATURES at most
    groups = scratch.keep(unknown_paragraphs(lines, grams).withColumn("group", F.monotonically_increasing_id()), "unknown")
    words = CountVectorizer(inputCol="names", outputCol="counts", binary=True).fit(
        features.select(F.array(F.col("gram").cast("string")).alias("names")))
    families = [UNKNOWN, *sorted({f for f, _ in TEMPLATES if f != UNKNOWN})]
    member = F.array(*[F.array_contains("families", f).cast("int") for f in families])

    def trained(corpus: DataFrame) -> Classifier:
        examples = pieces.select("family", "grams", F.lit(1).cast("long").alias("lines")).union(
            corpus.select(F.lit(UNKNOWN), "grams", "lines"))
        label = F.array_position(F.array(*[F.lit(f) for f in families]), F.col("family")) - 1
        examples = scratch.keep(examples.select("family", label.cast("double").alias("label"), "lines", F.transform(
            "grams", lambda g: g.cast("string")).alias("names")), "examples")
        # families weigh the same, however many pieces their texts give; a dozen numbers
        size = {r["family"]: r["n"] for r in examples.groupBy("family").agg(F.sum("lines").alias("n")).collect()}
        share = F.create_map(*[x for f, n in size.items() for x in (F.lit(f), F.lit(1000.0 / n))])
        rows = Normalizer(p=2.0, inputCol="counts", outputCol="features").transform(words.transform(
            examples.withColumn("weight", share[F.col("family")] * F.col("lines"))))
        model = LogisticRegression(family="multinomial", regParam=1e-4, maxIter=60, standardization=False,
                                   weightCol="weight").fit(rows)
        matrix = model.coefficientMatrix.toArray()
        table = spark.createDataFrame(
            [(int(g), [float(x) for x in matrix[:, k]]) for k, g in enumerate(words.vocabulary)], "gram long, w array<double>")
        weights = scratch.result(table.join(features, "gram").select("gram", "w", member.alias("has")), f"weights-{uuid.uuid4().hex[:12]}")
        return Classifier(families, weights, [float(x) for x in model.interceptVector])

    fitted = trained(groups)
    halves = [(groups.where(F.col("fold") == k), groups.where(F.col("fold") != k)) for k in (0, 1)]
    judged = [trained(rest).scored_grams(half, ["group", "lines"]) for half, rest in halves]
    scores = scratch.keep(judged[0].union(judged[1]).where(F.col("family") != UNKNOWN).select("probability", "lines"), "scores")
    total = groups.agg(F.coalesce(F.sum("lines"), F.lit(0))).first()[0]
    least = least_threshold(scores, int(FALSE_RATE * total))
    if least is not None:
        fitted.threshold = min(max(fitted.threshold, least), MOST_THRESHOLD)
    return fitted


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
                 classifier: Classifier | None = None) -> DataFrame:
    """One row per paragraph of a known licence: the document's id, paragraph, family, probability, overlap.

    Paragraphs are the lines of a text, numbered from 0.  A paragraph is reported when its family is
    not unknown, its probability reaches the calibrated threshold and its overlap with the family's
    texts LEAST_OVERLAP.  Null, empty and one-word texts report nothing.  Null ids are carried
    along and repeated rows report repeatedly; other columns are not read.
    """
    with Scratch(docs.sparkSession) as scratch:
        lines = paragraphs(docs, id_col, text_col)
        model = classifier or fit(lines, scratch)
        found = model.scored(possible(lines, model.features), ["id", "row", "paragraph"])
        return found.where((F.col("family") != UNKNOWN) & (F.col("probability") >= model.threshold)
                           & (F.col("overlap") >= LEAST_OVERLAP)).select(
            F.col("id").alias(id_col), "paragraph", "family", "probability", "overlap")
