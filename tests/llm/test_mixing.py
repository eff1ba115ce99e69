import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from llm import mixing as m
from llm.common import Scratch
from tests.llm.brute import WS, docs_frame, prose


def brute_targets(sizes, share=1.5, most=2.0):
    """Reshares the excess again and again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    total, fixed = share * sum(sizes.values()), {}
    while len(fixed) < len(order):
        left = total - sum(fixed.values())
        free = [s for s in order if s not in fixed]
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * level >= most * sizes[s]]
        if not over:
            return fixed | {s: weight[s] * level for s in free}
        fixed |= {s: most * sizes[s] for s in over}
    return fixed


def sample():
    rng = random.Random(10)
    rows = [(k, prose(rng, rng.randint(0, 60)), "en", rng.choice(["a", "b", "b", "é", "z", None] + ["hot"] * 5)) for k in range(300)]
    rows += [(400, None, "en", "a"), (401, "", "en", "blank"), (402, " \t", "en", "blank"), (403, "w " * 30_000, "en", "b"),
             (None, "x y z", "en", "a"), (404, "same words", "en", "z"), (404, "same words", "en", "z")]
    return rows


@pytest.mark.parametrize("block_words", [7, 64, 1024])
def test_targets_are_met_to_the_word(spark, block_words):
    rows = sample()
    sizes = defaultdict(int)
    for _, t, _, s in rows:
        sizes[s] += len(WS.findall(t)) if t else 0
    want = brute_targets(dict(sizes))
    got = m.mix(docs_frame(spark, rows).withColumnRenamed("lang", "taken"), block_words=block_words).collect()
    assert len(got) == len(rows)
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, r.target)
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    again = m.mix(docs_frame(spark, rows[::-1]).repartition(5), block_words=block_words).collect()
    assert sorted(map(str, got)) == sorted(map(str, (r for r in again))) or \
        sorted((str(r.doc_id), r.size, r.taken) for r in got) == sorted((str(r.doc_id), r.size, r.taken) for r in again)


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000])
def test_permutation_and_its_inverse(spark, n):
    x = spark.range(n).select("id", m.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(42)).alias("p"))
    rows = x.withColumn("back", m.permuted(F.col("p"), F.lit(n).cast("long"), F.lit(42), back=True)).collect()
    assert sorted(r.p for r in rows) == list(range(n)) and all(r.back == r.id for r in rows)


def test_slots_are_whole_passes_and_shards_are_drawn(spark):
    targets = spark.createDataFrame([("a", 1, 1000, 5, 1500.0), ("b", 2, 130, 5, 65.0)], "source string, place int, words long, rows long, target double")
    rows = m.slots(targets, block_words=16, shard_words=200).collect()
    assert sum(r.take for r in rows if r.place == 1) == 1500 and sum(r.take for r in rows if r.place == 2) == 65
    assert len({(r.place, r.epoch, r.block) for r in rows}) == len(rows)
    assert sum(r.take for r in rows if r.place == 1 and r.epoch == 0) == 1000
    counts = m.shard_counts(spark.createDataFrame(rows)).collect()
    assert len({r.shard for r in counts}) > 3 and sum(r.words for r in counts) == 1565


def test_counts_are_drawn_per_shard_in_many_tasks(spark):
    numbers = spark.createDataFrame([(1, 9000), (2, 3000), (3, 5)], "place int, slots long")
    drawn = m.draw(numbers, 100, 16)
    rows = drawn.collect()
    shards, sources = defaultdict(int), defaultdict(list)
    for r in rows:
        shards[r.shard] += r.n
        sources[r.place].append((r["first"], r.n))
    assert sorted(shards) == list(range(121)) and all(shards[k] == 100 for k in range(120)) and shards[120] == 5
    for place, total in [(1, 9000), (2, 3000), (3, 5)]:
        at = 0
        for first, n in sorted(sources[place]):  # a source's slots, one after another
            assert first == at
            at += n
        assert at == total
    # without replacement: mean 75 and variance 100 * 0.75 * 0.25 or so
    counts = [n for _, n in sources[1]][:]
    assert 73 < sum(counts) / 120 < 77 and 10 < sum((n - 75) ** 2 for n in counts if n > 10) / 120 < 30
    assert sorted(map(str, m.draw(numbers, 100, 3).collect())) == sorted(map(str, rows))
    targets = spark.createDataFrame([("a", 1, 10**6, 5, 1.5e6)], "source string, place int, words long, rows long, target double")
    sizes = m.slots(targets, block_words=16, shard_words=1600).groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) > 3 and max(r["count"] for r in sizes) < 60_000  # of 93750


def test_pieces_cover_what_is_taken(spark):
    with Scratch(spark) as scratch:
        _, placed, chosen = m.layout(docs_frame(spark, sample()), scratch, block_words=8)
        rows = m.pieces(placed, chosen, 8).where("words > 0").collect()
    assert all(r["first"] + r.words <= r.size and r.words <= 8 for r in rows)


def test_native_plan_and_empty_table(spark):
    frame = docs_frame(spark, sample())
    for df in (m.mix(frame), frame.select(m.word_count(F.col("text")))):
        assert "Python" not in df._jdf.queryExecution().toString() and "Arrow" not in df._jdf.queryExecution().toString()
    assert m.mix(frame.limit(0)).count() == 0
    assert [r.taken for r in m.mix(docs_frame(spark, [(1, None), (2, "")])).collect()] == [0, 0]
