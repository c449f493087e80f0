"""The store of results: hits, misses, broken rows, writers at once and compaction."""

import threading
from dataclasses import dataclass

import pytest
from pyspark.sql import functions as F

from folioscope.operators import models
from folioscope.sources.store import ContentStore, through


@pytest.fixture()
def store(spark, tmp_path):
    return ContentStore(spark, f"file://{tmp_path}/store", 4, lambda v: ~v.startswith("unreadable"))


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), "key string, value string")


def found(store, spark, *keys):
    return {r["key"]: r["value"] for r in store.lookup(spark.createDataFrame([(k,) for k in keys], "key string")).collect()}


def test_hits_and_misses_before_and_after_compaction(spark, store):
    assert found(store, spark, "a") == {} and store.generation() == 0
    store.put(rows(spark, ("a", "1"), ("b", "2"), ("n", None)))
    store.put(rows(spark, ("a", "later"), ("c", "3")))
    want = {"a": "1", "b": "2", "c": "3"}
    assert found(store, spark, "a", "a", "b", "c", "n", "x") == want
    assert store.compact() == 1 and store.segments() == [] and found(store, spark, "a", "b", "c", "x") == want
    store.put(rows(spark, ("b", "too late"), ("d", "4")))
    assert found(store, spark, "b", "d") == {"b": "2", "d": "4"}
    assert store.compact() == 2
    store.clean()
    assert found(store, spark, "a", "b", "c", "d") == want | {"d": "4"} and ContentStore(spark, store.path, 4).generation() == 2


def test_broken_rows_do_not_count_and_are_replaced(spark, store):
    store.put(rows(spark, ("a", "unreadable"), ("b", "fine")))
    forged = rows(spark, ("c", "text")).select("key", "value", F.lit("no digest").alias("digest"), F.current_timestamp().alias("at"), F.lit("w").alias("writer"))
    forged.write.parquet(f"{store.path}/segments/forged")
    assert found(store, spark, "a", "b", "c") == {"b": "fine"}
    store.put(rows(spark, ("a", "good"), ("c", "good")))
    assert found(store, spark, "a", "c") == {"a": "good", "c": "good"}
    store.compact()
    assert found(store, spark, "a", "b", "c") == {"a": "good", "b": "fine", "c": "good"}


def test_a_segment_whose_job_died_is_not_read(spark, store, tmp_path):
    store.put(rows(spark, ("a", "1")))
    rows(spark, ("b", "half")).write.parquet(f"{store.path}/segments/dead")
    (tmp_path / "store/segments/dead/_SUCCESS").unlink()
    assert found(store, spark, "a", "b") == {"a": "1"}


def test_writers_and_compaction_at_once(spark, store):
    store.put(rows(spark, ("first", "0")))
    jobs = [threading.Thread(target=store.put, args=(rows(spark, (f"k{i}", str(i)), ("same", str(i))),)) for i in range(4)] + [threading.Thread(target=store.compact) for _ in range(2)]
    [j.start() for j in jobs]
    [j.join() for j in jobs]
    got = found(store, spark, "first", "same", *[f"k{i}" for i in range(4)])
    assert {k: v for k, v in got.items() if k != "same"} == {"first": "0"} | {f"k{i}": str(i) for i in range(4)}
    store.compact()
    assert found(store, spark, "first", "same", *[f"k{i}" for i in range(4)]) == got


def test_lookups_do_not_shuffle_the_store(spark, store):
    store.put(spark.range(1000).select(F.concat(F.lit("k"), "id").alias("key"), F.col("id").cast("string").alias("value")))
    store.compact()
    plan = store._generation_rows(1).join(spark.range(500).select(F.concat(F.lit("k"), "id").alias("key")).hint("merge"), "key")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan


@dataclass(frozen=True)
class Never:
    def complete(self, prompt, model, max_tokens):
        raise OSError("asked")


def test_known_answers_are_not_asked_for(spark, store):
    docs = spark.createDataFrame([("k1", "one"), ("k2", "two"), ("k1", "one"), ("k3", "unreadable")], "key string, text string")

    def make(completer):
        return lambda todo: models.complete(todo, F.col("text"), completer, retries=1).withColumnRenamed("result", "value")

    first = sorted((r["key"], r["value"], r["error"]) for r in through(store, docs, make(models.RoutedCompleter())).collect())
    assert first == [("k1", "one", None), ("k1", "one", None), ("k2", "two", None), ("k3", "unreadable", None)]
    second = sorted((r["key"], r["value"], r["error"]) for r in through(store, docs, make(Never())).collect())
    assert second[:3] == first[:3] and second[3] == ("k3", None, "OSError: asked")
