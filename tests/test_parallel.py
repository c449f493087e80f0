"""Calls side by side, in order, and the index of vectors."""

import time
from dataclasses import dataclass

import pytest
from pyspark.sql import functions as F

from folioscope.operators import models, parallel


def test_results_come_in_order_and_side_by_side():
    began = time.monotonic()
    got = list(parallel.in_order(range(40), lambda i: (time.sleep(0.05 * (i % 3)), i)[1], 8))
    assert got == list(range(40)) and time.monotonic() - began < 0.05 * 39 / 2


def test_few_calls_are_under_way():
    import threading

    now, most, lock = [0], [0], threading.Lock()

    def call(i):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        time.sleep(0.005)
        with lock:
            now[0] -= 1
        return i

    assert list(parallel.in_order(range(60), call, 3)) == list(range(60)) and most[0] <= 3
    with pytest.raises(ValueError, match="positive"):
        list(parallel.in_order([1], call, 0))


def test_the_first_failure_in_order_is_told():
    def call(i):
        time.sleep(0.08 if i == 2 else 0)
        if i in (2, 3):
            raise OSError(f"call {i}")
        return i

    got = []
    with pytest.raises(OSError, match="call 2"):
        for x in parallel.in_order(range(9), call, 4):
            got.append(x)
    assert got == [0, 1]


def test_late_calls_give_up_their_place():
    ask = lambda i: (time.sleep(5 if i % 4 == 1 else 0), (i, None))[1]
    began = time.monotonic()
    got = list(parallel.answers(range(12), ask, 2, deadline=0.2))
    assert [g[0] for g in got] == [None if i % 4 == 1 else i for i in range(12)] and time.monotonic() - began < 2
    assert got[1][1] == "TimeoutError: no answer within 0.2 s"


def test_the_pace_is_shared():
    pace = parallel.Pace(50)
    began = time.monotonic()
    list(parallel.in_order(range(16), lambda i: i, 8, pace=pace))
    assert time.monotonic() - began >= 15 / 50


@dataclass(frozen=True)
class Slow:
    def complete(self, prompt, model, max_tokens):
        if prompt.endswith("3"):
            raise OSError("three")
        time.sleep(0.05)
        return prompt.upper()


def test_completions_with_workers_are_the_same_and_faster(spark):
    rows = spark.range(80).select(F.col("id"), F.concat(F.lit("p"), F.col("id").cast("string")).alias("p")).coalesce(1)
    took, got = {}, {}
    for workers in (1, 8):
        began = time.monotonic()
        got[workers] = [(r["id"], r["result"], r["error"]) for r in models.complete(rows, F.col("p"), Slow(), retries=1, workers=workers).collect()]
        took[workers] = time.monotonic() - began
    assert got[1] == got[8] and [i for i, *_ in got[8]] == list(range(80)) and took[8] < took[1] - 2
    first = models.first_failure(spark.createDataFrame(got[8], "id bigint, result string, error string"), ["id"]).collect()
    assert [(r["id"], r["error"]) for r in first] == [(3, "OSError: three")]


@dataclass(frozen=True)
class Counted:
    """Fails beyond a batch's limits, and where a text says so."""

    def embed(self, texts, model):
        if len(texts) > 3 or any("bad" in t for t in texts) or (len(texts) > 1 and sum(len(t) // 4 for t in texts) > 20):
            raise OSError("too much")
        return [[float(len(t)), 1.0] for t in texts]


def test_an_index_of_texts(spark):
    rows = spark.createDataFrame([(d, t) for d in range(5) for t in ["a", "bb", "ccc" * 30, "  ", None, "d" * 50, f"own {d}"]], "doc int, text string").repartition(3)
    index = models.vector_index(rows, "text", Counted(), items=3, tokens=20)
    got = {r["key"]: r for r in index.collect()}
    assert len(got) == 9 and all(r["error"] is None for r in got.values())
    again = models.vector_index(rows.unionByName(spark.createDataFrame([(9, "bad one")], "doc int, text string")), "text", Counted(), known=index, items=3, tokens=20).collect()
    assert len(again) == 10 and [r["vector"] for r in again if r["error"]] == [None]
    pairs = spark.createDataFrame([("a", "bb"), ("a", "unknown"), ("a", "a")], "l string, r string")
    near = {(r["l"], r["r"]): r["similarity"] for r in models.indexed_similarity(pairs, "l", "r", index).collect()}
    assert near["a", "unknown"] == 0.0 and near["a", "a"] == pytest.approx(1) and near["a", "bb"] == pytest.approx(3 / (2**0.5 * 5**0.5))


def test_one_call_at_a_time_without_deadline_stays_in_its_thread():
    import threading

    seen = []
    assert list(parallel.in_order(range(5), lambda x: seen.append(threading.get_ident()) or x, 1)) == [0, 1, 2, 3, 4]
    assert set(seen) == {threading.get_ident()}
