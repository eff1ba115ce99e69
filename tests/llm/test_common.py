import random

import pyarrow as pa
import pytest

from llm.common import Scratch, bounded_sample, by_group, connected_components
from tests.llm.brute import roots


def test_components_equal_brute_force(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(k, k + 1) for k in range(1000, 1060)] + [(5, 5), (7, None)][:1]
    with Scratch(spark) as scratch:
        got = {r.id: r.component for r in connected_components(scratch, spark.createDataFrame(pairs, "a long, b long")).collect()}
        empty = connected_components(scratch, spark.createDataFrame([], "a long, b long")).collect()
    linked = {i for p in pairs if p[0] != p[1] for i in p}
    want = roots(sorted({i for p in pairs for i in p}), pairs)
    assert got == {i: want[i] for i in linked}
    assert empty == []


@pytest.mark.parametrize("size", [1, 3, 7, 100])
def test_groups_survive_any_batching(size):
    keys = [1, 1, 2, 3, 3, 3, 3, 4, 9, 9]
    table = pa.table({"k": keys, "v": range(10)})
    groups = list(by_group(iter(table.to_batches(max_chunksize=size)), ["k"]))
    assert [(g.column("k")[0].as_py(), g.num_rows) for g in groups] == [(1, 2), (2, 1), (3, 4), (4, 1), (9, 2)]
    assert [v for g in groups for v in g.column("v").to_pylist()] == list(range(10))


def test_scratch_deletes_its_inner_tables(spark):
    with Scratch(spark) as scratch:
        kept = scratch.keep(spark.range(5))
        assert kept.count() == 5
        out = scratch.result(kept)
    assert out.count() == 5
    path, fs = scratch._at(f"{scratch.folder}/inner")
    assert not fs.exists(path)


def test_bounded_sample_keeps_all_of_small_values(spark):
    rows = spark.range(5000).selectExpr("id", "case when id < 20 then 'rare' else 'hot' end as k")
    with Scratch(spark) as scratch:
        got = [r.k for r in bounded_sample(scratch, rows, "k", "id", 100).collect()]
    assert got.count("rare") == 20 and got.count("hot") == 100
