import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from llm.token_count import MARK, Automaton, read_vocabulary, token_counts
from tests.llm.brute import docs_frame


def greedy(word: bytes, entries: set) -> int:
    n, at, longest = 0, 0, max(map(len, entries))
    while at < len(word):
        for size in range(min(longest, len(word) - at), 0, -1):
            if size == 1 or word[at:at + size] in entries:
                break
        at, n = at + size, n + 1
    return n


@settings(max_examples=300, deadline=None)
@given(st.sets(st.text("abc", min_size=1, max_size=6), max_size=12), st.text("abcd", max_size=30))
def test_count_equals_greedy_matching(vocabulary, word):
    entries = {v.encode() for v in vocabulary} or {b"a"}
    assert Automaton.of(list(entries)).count(word.encode()) == greedy(word.encode(), entries)


@pytest.fixture(scope="module")
def entries():
    return set(read_vocabulary())


def test_query_equals_brute_force(spark, entries):
    rng = random.Random(2)
    rows = [(k, " ".join("".join(rng.choice("aeionrst.é’😀") for _ in range(rng.randint(1, 12))) for _ in range(rng.randint(0, 40))))
            for k in range(40)]
    rows += [(100, None), (101, ""), (102, " \t\n"), (None, "a b"), (103, "x" * 30_000), (0, rows[0][1]), (0, rows[0][1])]
    frame = docs_frame(spark, rows)
    got = sorted(((r.doc_id, r.n_words, r.n_bytes, r.n_tokens) for r in token_counts(frame).collect()), key=str)
    want = sorted(((i, len((t or "").encode().split()), len((t or "").encode()),
                    sum(greedy(MARK + w, entries) for w in (t or "").encode().split())) for i, t in rows), key=str)
    assert got == want
    assert token_counts(frame.limit(0)).count() == 0
    assert token_counts(frame.withColumnRenamed("lang", "n_tokens")).columns == ["doc_id", "n_words", "n_bytes", "n_tokens"]
