import random

import pytest

from llm.ngram_jaccard import links_between, ngram_jaccard_join
from llm.words import shingle_hashes, words_of
from tests.llm.brute import docs_frame, edited, jaccard_components, prose


def sample():
    rng = random.Random(7)
    hot, passage = prose(rng, 90), prose(rng, 25)
    rows = [(k, edited(rng, hot, rng.randint(0, 2))) for k in range(60)]  # one large group of near copies
    rows += [(100 + k, prose(rng, rng.randint(10, 120)) + " " + passage) for k in range(40)]  # one frequent passage
    for k in range(40):
        text = prose(rng, rng.randint(1, 150))
        rows += [(200 + 3 * k + j, edited(rng, text, rng.randint(0, 3)) if j else text) for j in range(3)]
    rows += [(500, None), (501, ""), (502, " \n"), (503, "one"), (504, "One"), (505, "one two"), (506, "ONE\ttwo"), (507, "a b c"),
             (508, "é É"), (509, "é é"), (510, "again and again " * 5_000), (511, "again and again " * 4_000)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("n", "percent", "group_rows"), [(3, 90, 128), (3, 90, 4), (5, 80, 16), (1, 50, 8)])
def test_components_equal_brute_force(spark, n, percent, group_rows):
    rows = sample()
    out = ngram_jaccard_join(docs_frame(spark, rows).withColumnRenamed("lang", "component_id"), words=n, percent=percent,
                             group_rows=group_rows, frequent_from=8)
    assert out.columns == ["doc_id", "n_shingles", "class_id", "component_id"]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out.collect()} == jaccard_components(rows, n, percent)


@pytest.mark.parametrize("full", [1, 2, 5])
def test_counts_that_stop_lose_no_link(spark, full):
    rows = sample()
    out = ngram_jaccard_join(docs_frame(spark, rows), words=3, percent=90, group_rows=8, frequent_from=8, full=full)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out.collect()} == jaccard_components(rows, 3, 90)


def test_repeated_rows_null_ids_and_empty_tables(spark):
    rows = [(3, "a b c d"), (3, "a b c d"), (3, "x y z"), (1, "X y z"), (None, "a B c d"), (None, None)]
    frame = docs_frame(spark, rows)
    got = sorted(((r.doc_id, r.n_shingles, r.class_id, r.component_id) for r in ngram_jaccard_join(frame).collect()), key=str)
    assert got == sorted([(3, 2, 3, 3), (3, 2, 3, 3), (3, 1, 1, 1), (1, 1, 1, 1), (None, 2, 3, 3), (None, 0, None, None)], key=str)
    assert ngram_jaccard_join(frame.limit(0)).count() == 0


def test_threshold_is_exact_at_the_border():
    a = list(range(19))  # 18 common of 20: exactly 90 percent
    sets = [shingle_hashes([str(k).encode() for k in a], 1), shingle_hashes([str(k).encode() for k in [*a[:18], 99]], 1)]
    assert links_between(sets, None, 90) == [(0, 1)] and links_between(sets[:1], sets[1:], 91) == []
    assert words_of("A\x0bb C".encode()) == [b"a", "b c".encode()]
