"""Many small groups at a time against a loop, and the queries that use them."""

import random

import pytest

from folioscope.operators import evaluation, graph
from folioscope.operators.grouped import in_groups
from folioscope.operators.models import RoutedCompleter


@pytest.mark.parametrize("size", ["1", "7", "1000"])
def test_groups_do_not_depend_on_batches(spark, size):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", "c", None, *map(str, range(40))]), rng.choice([1, 2, None]), i) for i in range(400)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    try:
        run = lambda d: {"k": [d["k"].iloc[0]], "seen": [d["i"].tolist()]}
        got = in_groups(spark.createDataFrame(rows, "k string, j int, i bigint"), ["k", "j"], ["i"], run, "k string, seen array<bigint>").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for k, j, i in rows:
        want.setdefault((k, j), []).append(i)
    assert sorted(((r["k"] or "", r["seen"]) for r in got)) == sorted(((k or "", v) for (k, _), v in want.items()))


def test_small_groups_are_compared_many_at_a_time(spark):
    rng = random.Random(2)
    rows = [(f"g{i % 90}", i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(400)] + [("alone", 1000, [1.0, 0.0, 0.0, 0.0]), ("none", 1, [0.0] * 4), ("none", 2, [0.0] * 4)]
    frame = spark.createDataFrame(rows, "g string, p bigint, v array<double>")
    small, blocks = graph.similar_pairs(frame, ["g"], "p", "v", 0.3), graph.similar_pairs(frame, ["g"], "p", "v", 0.3, 2)
    assert small.count() > 50 and sorted(map(tuple, small.collect())) == sorted(map(tuple, blocks.collect()))
    assert "FlatMapGroupsInPandas" not in small._jdf.queryExecution().executedPlan().toString()


def test_scores_are_not_joined_by_broadcast(spark):
    docs = spark.createDataFrame([(1, "a", 1, "text")], "doc_id bigint, doc_name string, pos bigint, text string")
    told = spark.createDataFrame([(1, "said", None)], "doc_id bigint, summary string, error string")
    sections = spark.createDataFrame([(1, 1, "t", "text")], "doc_id bigint, section_index int, title string, text string")
    scored = evaluation.score_documents(docs, told, sections, RoutedCompleter())
    assert scored.count() == 1
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and plan.count("SortMergeJoin") >= 8


def test_small_groups_are_dealt_to_all_partitions_of_the_session(spark):
    """Merged by their bytes they were one task, however long their work takes."""

    def run(found):
        from pyspark import TaskContext

        return {"k": [found["k"].iloc[0]], "task": [TaskContext.get().partitionId()]}

    got = in_groups(spark.createDataFrame([(str(k), 0) for k in range(60)], "k string, i bigint"), ["k"], ["i"], run, "k string, task int").collect()
    assert len(got) == 60 and len({r["task"] for r in got}) == int(spark.conf.get("spark.sql.shuffle.partitions"))
