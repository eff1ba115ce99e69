import random

import numpy as np

from llm.toxicity import BlockMaxIndex, toxicity
from tests.llm.brute import docs_frame, prose

LABELS = "doc_id long, toxic int, text string"


def test_index_gives_the_exact_nearest_with_ties():
    rng = np.random.default_rng(12)
    vectors = []
    for _ in range(500):
        t = np.sort(rng.choice(30, rng.integers(1, 5), replace=False))
        w = rng.integers(1, 4, len(t)).astype(float)
        vectors.append((t, w / np.linalg.norm(w)))
    index = BlockMaxIndex(vectors, 30)
    dense = np.zeros((500, 30))
    for k, (t, w) in enumerate(vectors):
        dense[k, t] = w
    for k in range(60):
        t, w = vectors[rng.integers(500)] if k % 2 else (np.array([k % 30]), np.ones(1))
        q = np.zeros(30)
        q[t] = w
        exact = dense @ q
        least = np.sort(exact)[-10]
        docs, cosine = index.nearest(t, w, 10)
        assert set(docs.tolist()) == set(np.flatnonzero(exact >= least - 1e-9).tolist())
        assert np.allclose(cosine, exact[docs])


def test_held_out_scores_and_edges(spark):
    rng = random.Random(13)
    bad, rows, labels = ["vile", "nastyword", "nastything"], [], []
    for k in range(900):
        y = int(rng.random() < 0.2)
        words = prose(rng, rng.randint(5, 80)).split()
        for _ in range(1 + len(words) // 15 if y else 0):
            words.insert(rng.randrange(len(words)), rng.choice(bad).upper() if rng.random() < 0.3 else rng.choice(bad) + ",")
        rows.append((k, " ".join(words)))
        labels.append((k, y, "clash"))
    rows += [(2000, None), (2001, ""), (None, "vile vile"), (2002, "calm " * 40_000), (5, rows[5][1])]
    labels += [(3000, 1, "no document"), (None, 1, "x"), (7, None, "x"), (5, labels[5][1], "twice")]
    docs, known = docs_frame(spark, rows), spark.createDataFrame(labels, LABELS)
    got = toxicity(docs, known).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    truth = {i: y for i, y, _ in labels}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 100 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    by_id = {r.doc_id: r for r in got}
    assert by_id[None].predicted == 1 and by_id[2002].predicted == 0 and by_id[2001].score == by_id[2000].score
    assert all(truth[e] in (0, 1) for r in got for e in r.evidence)
    assert toxicity(docs.limit(0), known).count() == 0
    assert {r.score for r in toxicity(docs.limit(5), known.limit(0)).collect()} == {0.0}
