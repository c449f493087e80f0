"""Running aggregates by ranges against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from folioscope import scans


@pytest.fixture(autouse=True)
def many_ranges(spark):
    """Small tables have as many ranges as large ones."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def rows(spark, n, seed, groups):
    rng = random.Random(seed)
    data = [(rng.choice(groups), i, rng.choice([None, rng.randint(-9, 9)])) for i in range(n)]
    rng.shuffle(data)
    return data, spark.createDataFrame(data, "g string, at bigint, v bigint").repartition(5)


def fold(data, kind):
    out, now = {}, {}
    for g, at, v in sorted(data, key=lambda r: r[1]):
        if v is not None:
            now[g] = v if now.get(g) is None else {"sum": now[g] + v, "xor": now[g] ^ v, "max": max(now[g], v), "min": min(now[g], v)}[kind]
        out[at] = now.get(g)
    return out


def test_running_equals_the_loop(spark):
    for seed, groups in enumerate([["a"], ["a", "b", None], list("abcdefghij"), ["hot"] * 9 + ["x", "y"]]):
        data, df = rows(spark, 300, seed, groups)
        got = scans.running(df, ["g"], [F.col("at")], {k: (k, F.col("v")) for k in scans.KINDS}).collect()
        assert len(got) == 300
        for kind in scans.KINDS:
            assert {r["at"]: r[kind] for r in got} == fold(data, kind), (seed, kind)


def test_one_group_is_spread_over_ranges(spark):
    _, df = rows(spark, 2000, 1, ["only"])
    parts = scans.dealt(df, ["g"], [F.col("at")]).groupBy("_part").count().collect()
    assert len(parts) > 1 and max(r["count"] for r in parts) < 1500


def test_numbers_start_at_one_and_descending_orders_work(spark):
    data, df = rows(spark, 100, 3, ["a", "b"])
    got = scans.numbered(df, ["g"], [F.desc("at")], "n").collect()
    for g in "ab":
        assert [r["n"] for r in sorted((r for r in got if r["g"] == g), key=lambda r: -r["at"])] == list(range(1, sum(d[0] == g for d in data) + 1))


def test_an_empty_table(spark):
    assert scans.numbered(spark.createDataFrame([], "g string, at bigint"), ["g"], [F.col("at")], "n").collect() == []
