"""Ordered operators against brute force, with one key holding a third of the rows."""

import random

import pytest
from pyspark.sql import functions as F

from latelens.operators.ordered import number_rows, rolling_means, rows_at_positions, running_totals
from latelens.operators.staging import stage


def skewed_rows(n=3000, seed=7):
    rng = random.Random(seed)
    keys = ["hot"] * (n // 3) + [f"k{rng.randrange(200)}" for _ in range(n - n // 3 - 20)] + [None] * 20
    # Few distinct times: plenty of ties to be broken by id.
    return [(k, rng.randrange(50), i, rng.randrange(2)) for i, k in enumerate(rng.sample(keys, len(keys)))]


@pytest.fixture(scope="module")
def skewed(spark):
    rows = skewed_rows()
    return rows, stage(spark.createDataFrame(rows, "k string, t int, id int, y int").repartition(5), "skewed")


def brute_totals(rows, keyed=True):
    seen, out = {}, {}
    for k, t, i, y in sorted(rows, key=lambda r: (r[1], r[2])):
        key = k if keyed else 0
        out[i] = seen.get(key, (0, 0))
        seen[key] = (out[i][0] + 1, out[i][1] + y)
    return out


def totals(df, keys):
    out = running_totals(df, keys, ["t", "id"], {"n": F.lit(1), "late": "y"})
    return {r["id"]: (r["n"], r["late"]) for r in out.collect()}


def test_running_totals_in_ranges(skewed):
    rows, df = skewed
    assert totals(df, ["k"]) == brute_totals(rows)


def test_global_running_totals_in_ranges(skewed):
    rows, df = skewed
    assert totals(df, []) == brute_totals(rows, keyed=False)


def test_range_plan_has_no_single_task_exchange_of_rows(skewed):
    """Only the table of range totals may meet in one task; the rows may not."""
    _, df = skewed
    plan = running_totals(df, [], ["t", "id"], {"n": F.lit(1)})._jdf.queryExecution().executedPlan().toString()
    before_carried = plan.split("BroadcastExchange")[0]
    assert "SinglePartition" not in before_carried


def test_descending_order_in_ranges(skewed):
    rows, df = skewed
    points = stage(df.groupBy("t").agg(F.count("*").alias("c")), "points")
    got = {r["t"]: r["above"] for r in running_totals(points, [], [F.desc("t")], {"above": "c"}).collect()}
    assert got == {t: sum(r[1] > t for r in rows) for t in got}


def test_rows_at_positions(skewed):
    rows, df = skewed
    order = sorted(rows, key=lambda r: (r[1], r[2]))
    wanted = [0, 1, 999, 1500, len(rows) - 1, len(rows)]
    got = {r["position"]: r["id"] for r in rows_at_positions(df, ["t", "id"], wanted).collect()}
    assert got == {p: order[p][2] for p in wanted if p < len(rows)}


@pytest.mark.parametrize("chunk", [25, 100_000])
def test_rolling_means(skewed, chunk):
    rows, df = skewed
    counted = running_totals(df, ["k"], ["t", "id"], {"pos": F.lit(1)})
    out = rolling_means(counted, ["k"], "pos", "y", {"m3": 3, "m20": 20}, chunk_rows=chunk)
    got = {r["id"]: (r["m3"], r["m20"]) for r in out.collect()}
    assert len(got) == len(rows)
    history = {}
    for k, t, i, y in sorted(rows, key=lambda r: (r[1], r[2])):
        past = history.setdefault(k, [])
        want = tuple(sum(past[-n:]) / n if len(past) >= n else None for n in (3, 20))
        assert got[i] == pytest.approx(want) if None not in want else got[i][1] == want[1]
        past.append(y)


@pytest.mark.parametrize("hot", [10_000, 100])
def test_number_rows(skewed, hot):
    """With a low limit the hot key is numbered range by range."""
    rows, df = skewed
    keyed = [r for r in rows if r[0] is not None]
    out = number_rows(df.where("k is not null"), "k", ["t", "id"], "no", {"first_id": "id"}, hot_rows=hot)
    got = {r["id"]: (r["no"], r["first_id"]) for r in out.collect()}
    groups = {}
    for r in sorted(keyed, key=lambda r: (r[1], r[2])):
        groups.setdefault(r[0], []).append(r[2])
    want = {i: (n + 1, ids[0]) for ids in groups.values() for n, i in enumerate(ids)}
    assert got == want
