import numpy as np

from llm import embedding_neardup as e
from tests.llm.brute import roots

VECTORS = "vec_id long, embedding array<double>, label int, n_links long"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, y, 5) for i, v, y in rows], VECTORS)


def brute(rows, least=0.93):
    good = [(i, np.array(v) / np.abs(v).max(), y) for i, v, y in rows if y is not None and v and None not in v
            and np.isfinite(v).all() and np.any(v)]
    links, pairs = {i: 0 for i, _, _ in rows}, []
    for k, (i, v, y) in enumerate(good):
        for j, w, z in good[k + 1:]:
            if y == z and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= least:
                links[i] += 1
                links[j] += 1
                pairs.append((i, j))
    found = roots([i for i, _, _ in rows], pairs)
    return {i: (links[i], found[i], found[i] == i) for i in links}


def test_links_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(e, "BLOCK", 16)  # hot buckets are cut into many blocks
    rng = np.random.default_rng(6)
    rows, n = [], 0
    for c in range(30):
        base = rng.normal(size=20)
        for _ in range(60 if c == 0 else rng.integers(1, 6)):
            rows.append((n, (base + rng.normal(size=20) * rng.choice([0.02, 0.2, 0.4])).tolist(), int(c % 3)))
            n += 1
    rows += [(n + k, v, y) for k, (v, y) in enumerate([
        (None, 1), ([], 1), ([0.0] * 20, 1), ([None, *[1.0] * 19], 1), ([float("nan"), *[1.0] * 19], 1),
        ([float("inf"), *[1.0] * 19], 1), (rows[0][1], None), (rows[0][1], 0), (rows[0][1], 0), ([1.0] * 7, 0), ([2.0] * 7, 0),
        ([1e300] * 20, 2), ([1e-300] * 20, 2), ([1.0], 2), ([3.0], 2)])]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in e.embedding_neardup(frame(spark, rows)).collect()}
    want = brute(rows)
    missed = sum(v[0] for v in want.values()) - sum(v[0] for v in got.values())
    assert all(got[i][0] <= want[i][0] for i in want)
    assert missed <= 0.02 * sum(v[0] for v in want.values())
    if not missed:
        assert got == want


def test_many_equal_vectors_and_repeated_ids(spark):
    rows = [(1, [1.0, 2.0], 0)] * 3 + [(2, [1.0, 2.0], 0), (3, [2.0, 4.0], 0), (4, [-1.0, -2.0], 0)]
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in e.embedding_neardup(frame(spark, rows)).collect())
    assert got == [(1, 4, 1)] * 3 + [(2, 4, 1), (3, 4, 1), (4, 0, 4)]


def test_empty_table(spark):
    out = e.embedding_neardup(frame(spark, []))
    assert out.columns == ["vec_id", "n_links", "component_id", "kept"] and out.count() == 0
