import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from llm import license_scan as scans
from llm.common import Scratch
from llm.license_scan import LEAST_OVERLAP, TEMPLATES, UNKNOWN, fit, license_scan, paragraphs, possible, words_of
from tests.llm.brute import docs_frame, prose

NOTICES = {
    "apache": "Licensed under the Apache License, Version 2.0.", "mit": "Released under the MIT License.",
    "gpl": "This work is licensed under the GNU General Public License, version 3.", "cc-by-nc": "Licensed under CC BY-NC 4.0.",
    "bsd": "Redistributions of source code must retain the above copyright notice, this list of conditions.",
}


def test_notices_are_found_and_nothing_else(spark):
    rng = random.Random(14)
    rows, want = [], set()
    for k in range(120):
        lines = [prose(rng, rng.randint(3, 40)) for _ in range(4)]
        if k % 4 == 0:
            family = rng.choice(list(NOTICES))
            lines.insert(2, NOTICES[family].upper() if k % 8 else NOTICES[family])
            want.add((k, 2, family))
        rows.append((k, "\n".join(lines)))
    rows += [(200, None), (201, ""), (202, "word"), (203, "All rights reserved."), (204, "the license of the city " * 5_000),
             (None, NOTICES["mit"]), (205, NOTICES["mit"]), (205, NOTICES["mit"])]
    frame = docs_frame(spark, rows).withColumnRenamed("lang", "family")
    out = license_scan(frame)
    assert "Python" not in out._jdf.queryExecution().toString() and "Arrow" not in out._jdf.queryExecution().toString()
    got = [(r.doc_id, r.paragraph, r.family) for r in out.collect()]
    assert sorted(got, key=str) == sorted([*want, (None, 0, "mit"), (205, 0, "mit"), (205, 0, "mit")], key=str)


def test_empty_table(spark):
    assert license_scan(docs_frame(spark, [(1, "a")]).limit(0)).count() == 0


def test_lines_left_out_early_could_not_be_reported(spark):
    rng = random.Random(3)
    rows = []
    for k in range(600):
        words = rng.choice(TEMPLATES)[1].split()
        start, size = rng.randrange(len(words)), rng.randint(1, 30)
        around = [prose(rng, rng.randint(0, size)) for _ in range(2)]
        rows.append((k, " ".join([around[0], *words[start:start + size], around[1]])))
    rows += [(700, "x the"), (701, "of the"), (702, "MIT License"), (703, "the MIT License"), (704, "a b c the software")]
    frame = docs_frame(spark, rows)
    with Scratch(spark) as scratch:
        lines = paragraphs(frame, "doc_id", "text")
        model = fit(lines, scratch)
        words = lines.withColumn("words", words_of(F.col("line")))
        enough = (F.col("family") != UNKNOWN) & (F.col("overlap") >= LEAST_OVERLAP)
        every = {tuple(r) for r in model.scored(words, ["id"]).where(enough).collect()}
        kept = {tuple(r) for r in model.scored(possible(lines, model.features), ["id"]).where(enough).collect()}
    assert every == kept and len(every) > 50


def test_too_many_features_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(scans, "FEATURES", 10)
    with pytest.raises(ValueError, match="more than 10"):
        license_scan(docs_frame(spark, [(1, "a b c")]))


def test_all_paragraphs_train_and_calibrate(spark, monkeypatch):
    trained, judged = [], []

    def fitting(self, rows, whole=scans.LogisticRegression.fit):
        least = rows.where("label = 0").agg(F.min("weight")).first()[0]  # that of an example that is there once
        trained.append(round(1000 / least))
        return whole(self, rows)

    def limit(scores, most):
        judged.append(most)

    monkeypatch.setattr(scans.LogisticRegression, "fit", fitting)
    monkeypatch.setattr(scans, "least_threshold", limit, raising=False)
    rng = random.Random(5)
    frame = docs_frame(spark, [(k, "\n".join(prose(rng, 5) for _ in range(40))) for k in range(200)])
    with Scratch(spark) as scratch:
        fit(paragraphs(frame, "doc_id", "text"), scratch)
    pieces = scans._pieces(spark).where(F.col("family") == UNKNOWN).count()
    assert trained[0] == 8_000 + pieces
    assert trained[1] + trained[2] == 8_000 + 2 * pieces and min(trained) > 3_500
    assert judged == [int(scans.FALSE_RATE * 8_000)]


def test_equal_paragraphs_are_counted_together(spark):
    def grams(text):
        w = [x for x in re.split("[^a-z0-9]+", text.lower()) if x]
        return [*zip(w, w[1:]), *zip(w, w[1:], w[2:])]

    features = {g for f, text in TEMPLATES if f != UNKNOWN for g in grams(text)}
    rng = random.Random(8)
    lines = ["a b", "the software", "a\u212ab", "a\u212ab is", *["of the software is " * 3 + prose(rng, 20)] * 3]
    for _ in range(400):
        words = rng.choice(TEMPLATES)[1].split()
        start = rng.randrange(len(words))
        lines.append(" ".join([prose(rng, rng.randint(1, 6)), *words[start:start + rng.randint(1, 6)], prose(rng, 2)]))
    want = Counter()
    for line in lines:
        known = [g for g in grams(line.replace("\u212a", "k")) if g in features]
        if not known or 2 * len(known) < len(grams(line.replace("\u212a", "k"))):
            want[tuple(sorted(known))] += 1
    pairs = spark.createDataFrame([(list(g),) for g in sorted(features)], "g array<string>")
    number = {tuple(r.g): r.h for r in pairs.select("g", F.when(F.size("g") == 2, F.xxhash64(F.col("g")[0], F.col("g")[1])).otherwise(
        F.xxhash64(F.col("g")[0], F.col("g")[1], F.col("g")[2])).alias("h")).collect()}
    got = Counter()
    frame = docs_frame(spark, [(k, line) for k, line in enumerate(lines)])
    folds = scans.unknown_paragraphs(paragraphs(frame, "doc_id", "text"), list(number.values())).collect()
    for r in folds:
        got[tuple(r.grams)] += r.lines
    assert got == Counter({tuple(sorted(number[g] for g in known)): n for known, n in want.items()})
    assert len(want) > 50 and {r.fold for r in folds} == {0, 1}


def test_least_threshold_against_sorting(spark):
    rng = random.Random(2)
    rows = [(rng.choice([0.1, 0.7, rng.random(), 0.7 + rng.random() / 10**6, 1.0]), rng.randint(1, 4)) for _ in range(500)]
    frame = spark.createDataFrame(rows, "probability double, lines long").cache()
    every = sorted((p for p, n in rows for _ in range(n)), reverse=True)
    for most in (0, 1, 300, 500, 700, len(every) - 1):
        least = scans.least_threshold(frame, most)
        assert sum(p >= least for p in every) <= most < sum(p >= least - 2**-30 for p in every)
    assert scans.least_threshold(frame, len(every)) is None
    assert scans.least_threshold(frame.limit(0), 0) is None
