import hashlib
import math
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from llm.importance_resampling import importance_resample, ngrams, resampling_table

GAP = re.compile("[\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, low, high):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in GAP.split(lower) if w]
    return words, [" ".join(words[i:i + n]) for n in range(low, high + 1) for i in range(len(words) - n + 1)]


def plain(docs, target, low=1, high=1, buckets=50, least=3, percent=40, seed=2024):
    def tally(texts):
        return Counter(zlib.crc32(f.encode()) % buckets for t in texts for f in features(t, low, high)[1])

    s, t = tally(x for _, x in docs), tally(target)
    s_all, t_all = sum(s.values()), sum(t.values())
    rows = []
    for key, text in docs:
        words, found = features(text, low, high)
        gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets))))
                for b in (zlib.crc32(f.encode()) % buckets for f in found)]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        rows.append([key, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(words)])
    able = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {id(r): i + 1 for i, r in enumerate(able[:len(able) * percent // 100])}
    return sorted(((*r[:4], rank.get(id(r))) for r in rows), key=repr)


DOCS = [
    (1, "The cat sat. The CAT sat on the mat!"), (2, None), (3, ""), (4, " ...  "), (5, "straße Ünïcode 日本語 word-word"),
    (6, "a\x00b\tc\nd"), (7, "the cat sat on the mat " * 2000), (8, "zebra lion zebra lion"), (9, "The cat sat. The CAT sat on the mat!"),
    (10, "one"), (None, "the mat is flat and fat"), (11, "x y z x y z"), (12, "7 8 9 mat"),
]
TARGET = ["the cat sat on a mat", None, "mat mat mat", ""]


@pytest.mark.parametrize("low,high", [(1, 1), (1, 2), (2, 3)])
def test_against_plain_python(spark, low, high):
    docs = spark.createDataFrame([(*d, 1, "x") for d in DOCS], "doc_id long, text string, rank int, score string").repartition(3)
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    out = resampling_table(docs, target, words=(low, high), buckets=50, least_words=3, percent=40)
    got = out.select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert sorted(map(tuple, got), key=repr) == plain(DOCS, TARGET, low, high)


def test_ngrams_stay_within_their_text():
    texts = pa.array(["a b", None, "", "c", "a b c"])
    got = {n: list(zip(r.tolist(), c[g].tolist())) for n, (r, g, c) in enumerate(ngrams(texts, 1, 3), start=1)}
    crc = lambda t: zlib.crc32(t.encode())
    assert got[1] == [(0, crc("a")), (0, crc("b")), (3, crc("c")), (4, crc("a")), (4, crc("b")), (4, crc("c"))]
    assert got[2] == [(0, crc("a b")), (4, crc("a b")), (4, crc("b c"))]
    assert got[3] == [(4, crc("a b c"))]


def test_draw_keeps_whole_rows_and_reruns_agree(spark):
    docs = spark.createDataFrame([(i, f"word{i % 7} other{i % 5} third{i}", i) for i in range(100)], "doc_id long, text string, id int")
    docs = docs.union(docs.where("doc_id = 3"))
    target = spark.createDataFrame([("word1 other1",)], "text string")
    first = importance_resample(docs, target, least_words=1, percent=20)
    assert first.columns == docs.columns
    again = importance_resample(docs.repartition(7), target, least_words=1, percent=20)
    assert sorted(first.collect()) == sorted(again.collect())
    ranks = [r[0] for r in resampling_table(docs, target, least_words=1, percent=20).where("rank is not null").select("rank").collect()]
    assert sorted(ranks) == list(range(1, 21))  # 20% of 101 rows


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    target = spark.createDataFrame([("a",)], "text string")
    assert resampling_table(docs, target).count() == 0
    some = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    out = resampling_table(some, target.where("false"), least_words=1, percent=100).collect()
    assert [r["rank"] for r in out] == [1]
    assert resampling_table(some, target, least_words=1, percent=50).where("rank is not null").count() == 0
    assert "text_key" in resampling_table(some.withColumn("n", F.lit(1)), target).columns
