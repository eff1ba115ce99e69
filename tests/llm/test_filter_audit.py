import re
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from llm.filter_audit import audit, filter_audit, packed_outcomes, unpacked

LONG = " ".join(f"word{i}" for i in range(250))
DOCS = [
    (1, LONG, "a"), (2, LONG, "b"), (3, None, "a"), (4, "", None), (5, "SHOUT " * 300, ""), (6, LONG + " #", "a"),
    (None, LONG, "a"), (7, "a b\tc\x0bd", "a"), (8, "x " * 50_000, "b"), (8, "x " * 50_000, "b"), (9, "É" + LONG, "c|d"),
    (10, "A" * 2 + "b" * 98, "a"), (11, "A" * 3 + "b" * 97, "a"), (12, LONG + " &", "a"),
]
LABELS = [(1, 1, 0), (2, 1, 1), (3, 0, 1), (3, 0, 0), (5, None, 1), (8, 1, None), (None, 1, 1), (77, 1, 1)]


def fails(docs):
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    out = []
    for i, t, part in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        out.append((i, part or "", {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t),
            "D": any(c in "#$%&*|" for c in t), "E": i is not None and first[t] < i}))
    return out


def plain(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    rows = {}
    for part in {p for _, p, _ in fails(docs)}:
        removed_by = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = [(i, f) for i, p, f in fails(docs) if p == part]
            everyone = list(left)
            for step, letter in enumerate(order, start=1):
                here = [x for x in left if x[1][letter]]
                left = [x for x in left if not x[1][letter]]
                removed_by[letter] += len(here)
                rows[part, "".join(order), step] = [
                    len(left), len(here), sum(f[letter] for _, f in everyone) - len(here),
                    sum(f[letter] and sum(f.values()) == 1 for _, f in everyone),
                    sum(i in good for i, _ in here), sum(i in toxic for i, _ in here)]
        for (p, order, step), row in rows.items():
            if p == part:
                row.append(removed_by[order[step - 1]])
    return rows


def test_against_running_every_order(spark):
    docs = spark.createDataFrame([(*d, 5, True) for d in DOCS], "doc_id long, text string, source string, mask int, good boolean")
    labels = spark.createDataFrame([(*x, "k") for x in LABELS], "doc_id long, quality int, toxic int, key string")
    got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley]
           for r in filter_audit(docs, labels).collect()}
    assert got == plain(DOCS, LABELS)
    assert filter_audit(docs.where("false"), labels).count() == 0
    none = filter_audit(docs, labels.where("false")).agg(F.sum("good_lost"), F.sum("toxic_lost")).first()
    assert tuple(none) == (0, 0)


def test_fields_do_not_run_into_each_other(spark):
    huge = 2**62
    total = unpacked(huge * packed_outcomes("AB")[1] + (huge - 1) * packed_outcomes("AB")[3], 4)
    assert total.tolist() == [[0, 2 * huge - 1, 0, huge], [0, 0, huge - 1, 0], [huge, huge - 1, 0, 0], [0, huge, huge - 1, huge]]
    counts = spark.createDataFrame([("p", 1, True, huge), ("p", 0, False, 3)], "part string, mask int, m boolean, n long")
    rows = {(r.filter_order, r.step): (r.kept, r.removed, r.m_lost) for r in audit(counts, "AB", ["m"]).collect()}
    assert rows["AB", 1] == (3, huge, huge) and rows["BA", 1] == (huge + 3, 0, 0)
    with pytest.raises(ValueError):
        audit(counts, "ABCDEFGH", [])
