import random

import numpy as np
import pytest

from fluoroframe.plans.cut import cut, shared_folder
from fluoroframe.plans.graph import connected
from fluoroframe.plans.ranks import exact_percentiles, number_rows, weighted_median
from fluoroframe.plans import skew


def union_find(pairs):
    up = {}

    def top(v):
        up.setdefault(v, v)
        while up[v] != v:
            v = up[v]
        return v

    for a, b in pairs:
        a, b = top(a), top(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {v: top(v) for v in list(up)}


def test_components_match_union_find(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(200)]
    pairs += [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2001 + i) for i in range(300)]  # chain and hub
    pairs = [(a, b) for a, b in pairs if a != b]
    df = spark.createDataFrame([("k", a, b) for a, b in pairs], "k string, src long, dst long")
    got = {r.node: r.root for r in connected(df, ["k"]).collect()}
    assert got == union_find(pairs)


def test_components_of_nothing(spark):
    df = spark.createDataFrame([], "k string, src long, dst long")
    assert connected(df, ["k"]).count() == 0


@pytest.mark.parametrize("limit", [10**6, 30])
def test_percentiles_equal_numpy(spark, limit):
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=1200).round(2), rng.integers(0, 5, 300).astype(float)
    rows = [("a", float(v)) for v in a] + [("b", float(v)) for v in b] + [("b", None), ("a", float("nan"))]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: r for r in exact_percentiles(df, ["k"], "v", {"lo": 0.01, "mid": 0.5, "hi": 0.995}, limit=limit).collect()}
    for k, v in (("a", a), ("b", b)):
        assert np.allclose([got[k].lo, got[k].mid, got[k].hi], np.percentile(v, [1, 50, 99.5]))


def test_numbering_follows_the_levels(spark):
    rows = [("a", z, y, x) for z in range(2) for y in range(4) for x in range(z, 7, 2)]
    df = spark.createDataFrame(rows[::-1], "k string, z int, y int, x int")
    got = number_rows(df, ["k"], ["z", "y", "x"], "id").orderBy("z", "y", "x").collect()
    assert [r.id for r in got] == list(range(len(rows)))


def test_weighted_median(spark):
    df = spark.createDataFrame([(1, 0, 3), (1, 5, 4), (1, 7, 1)], "k int, v int, n int")
    assert weighted_median(df, ["k"], "v", "n", "m").first().m == 5


def test_join_of_renamed_keys_equals_plain_join(spark):
    big = cut(spark.createDataFrame([(1 if i % 3 else i, i) for i in range(3000)], "k long, i long"))
    small = spark.createDataFrame([(k, k * 10) for k in range(0, 3000, 2)] + [(1, 10)], "k long, w long")
    got = skew.join_renamed(big, small, ["k"], ["k"])
    want = big.join(small, "k").select("k", "i", "w")
    assert sorted(map(tuple, got.select("k", "i", "w").collect())) == sorted(map(tuple, want.collect()))


def test_salted_join_keeps_every_row_once(spark):
    big = spark.createDataFrame([("a" if i < 90 else "b", i) for i in range(100)], "k string, i long")
    small = spark.createDataFrame([("a", 1), ("c", 2)], "k string, w int")
    assert skew.salted_join(big, small, ["k"], ["i"]).count() == 90
    assert skew.salted_join(big, small, ["k"], ["i"], "left").count() == 100


def test_cut_uses_the_folder_of_the_session(spark):
    cut(spark.range(1))
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    assert shared_folder(spark) == named.rstrip("/") == shared_folder(spark)
    path = cut(spark.range(5)).inputFiles()[0]
    assert shared_folder(spark).replace("file:", "") in path
