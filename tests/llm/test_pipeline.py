"""Stages of the pipeline on tables that repeat ids, lack ids, or are empty."""

import os
import random
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline  # noqa: E402
from tests.llm.brute import docs_frame, edited, prose  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


def test_each_text_of_a_repeated_id_is_judged_for_itself(spark):
    rng = random.Random(71)
    one, two, three, four = (prose(rng, 200) for _ in range(4))
    rows = [(3, one), (5, edited(rng, one, 1)), (5, two), (5, two), (7, two), (2, three), (2, four), (9, four),
            (None, one), (None, None), (11, None), (11, None), (11, "")]
    docs = docs_frame(spark, rows).withColumn("_row", F.lit("clash"))
    kept = corpus_pipeline.near_duplicates(spark, docs, FOLDER)
    assert kept.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert got == sorted([(3, one), (5, two), (2, three), (2, four), (None, one), (None, None), (11, None), (11, "")], key=str)


def test_ids_that_are_not_repeated(spark):
    rng = random.Random(72)
    one, two = prose(rng, 200), prose(rng, 200)
    docs = docs_frame(spark, [(3, two), (5, one), (4, edited(rng, one, 1)), (None, one), (8, None), (9, None)])
    got = {(r.doc_id, r.text is None) for r in corpus_pipeline.near_duplicates(spark, docs, FOLDER).collect()}
    assert got == {(3, False), (4, False), (None, False), (8, True), (9, True)}


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_of_an_empty_table(spark, name, stage):
    assert stage(spark, docs_frame(spark, [(1, "a")]).limit(0), FOLDER).collect() == []
