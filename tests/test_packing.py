"""Packing and valley cuts by ranges against the folds."""

import random

import pytest
from pyspark.sql import functions as F

from folioscope.operators import chunking, packing


@pytest.fixture(autouse=True)
def many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def rows(spark, seed, groups, n, most=40):
    rng = random.Random(seed)
    data = [(rng.choice(groups), i, rng.choice([0, 0, 1, 5, rng.randint(0, most), 3 * most]), rng.choice([0.0, 0.5, rng.random(), None])) for i in range(n)]
    rng.shuffle(data)
    return data, spark.createDataFrame(data, "g string, at bigint, size bigint, sim double").repartition(3)


@pytest.mark.parametrize("groups, items", [(["one"], 1 << 30), (["one"], 3), (["a", "b", None, "c"], 7)])
def test_packing_equals_the_fold(spark, groups, items):
    data, df = rows(spark, len(groups) + items % 5, groups, 400)
    got = {r["at"]: r["bucket"] for r in packing.packed(df, ["g"], [F.col("at")], F.col("size"), 60, items).collect()}
    assert len(got) == 400
    for g in set(groups):
        mine = sorted(r for r in data if r[0] == g) if g else sorted(((0, *r[1:]) for r in data if r[0] is None))
        assert [got[r[1]] for r in mine] == chunking.buckets_of([r[2] for r in mine], 60, items), g


def test_valleys_equal_the_fold(spark):
    for seed, groups in enumerate((["one"], ["a", "b"])):
        data, df = rows(spark, seed, groups, 300, 30)
        got = {r["at"]: r["chunk"] for r in packing.valleys(df, ["g"], [F.col("at")], F.col("size"), F.col("sim"), 50, 200).collect()}
        for g in groups:
            mine = sorted(r[1:] for r in data if r[0] == g)
            cuts = set(chunking.cuts_of([r[1] for r in mine], [float("inf") if r[2] is None else r[2] for r in mine], 50, 200))
            want, now = [], 0
            for i in range(len(mine)):
                now += i in cuts
                want.append(now)
            assert [got[r[0]] for r in mine] == want, (seed, g)


def test_least_between_in_and_across_ranges(spark):
    rng = random.Random(3)
    values = [rng.randint(0, 9) / 2 for _ in range(200)]
    asked = [(i, lo, rng.randint(lo, 199)) for i, lo in enumerate(rng.randrange(200) for _ in range(150))]
    v = spark.createDataFrame([("g", i, x) for i, x in enumerate(values)], "_g string, _at bigint, v double")
    q = spark.createDataFrame([("g", *a) for a in asked], "_g string, _at bigint, low bigint, high bigint")
    got = {r["_at"]: r["place"] for r in packing.least_between(v, q).collect()}
    assert got == {i: min(range(lo, hi + 1), key=lambda p: (values[p], p)) for i, lo, hi in asked}


def test_no_task_holds_a_group(spark):
    """One group of many items: every range's task has a share of them."""
    df = spark.range(20_000).select(F.col("id").alias("at"), F.lit("g").alias("g"), (F.col("id") % 9).alias("size"))
    parts = packing.dealt(df, ["g"], [F.col("at")]).groupBy("_part").count().collect()
    assert len(parts) >= 4 and max(p["count"] for p in parts) < 10_000
    got = packing.packed(df, ["g"], [F.col("at")], F.col("size"), 100).groupBy("bucket").agg(F.sum("size").alias("s"), F.min("at").alias("first")).orderBy("bucket").collect()
    want = chunking.buckets_of([i % 9 for i in range(20_000)], 100)
    assert [r["first"] for r in got] == [i for i in range(20_000) if i == 0 or want[i] != want[i - 1]]


def test_empty(spark):
    none = spark.createDataFrame([], "g string, at bigint, size bigint, sim double")
    assert packing.packed(none, ["g"], [F.col("at")], F.col("size"), 10).collect() == []
    assert packing.valleys(none, ["g"], [F.col("at")], F.col("size"), F.col("sim"), 1, 9).collect() == []
