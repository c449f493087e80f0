import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from folioscope.llm import exact_dedup as D


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    return sorted((i, max(groups[t or ""]), len(groups[t or ""]), i == max(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)


def test_against_brute_force(docs, texts):
    found = D.exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted(map(tuple, found)) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_collisions_are_chained_and_buckets_split(docs):
    full = sorted(map(tuple, D.exact_dedup(docs).drop("bucket", "chain", "row").collect()))
    few = D.exact_dedup(docs, key_bits=2, capacity=1)
    assert sorted(map(tuple, few.drop("bucket", "chain", "row").collect())) == full
    assert few.agg({"chain": "max"}).first()[0] > 1
    assert few.select("bucket").distinct().count() > 1


def test_directory_doubles_without_a_limit(spark):
    """Half of the keys share their first 35 bits, so their bucket is split far beyond the others."""
    rng = random.Random(5)
    keys = sorted({rng.getrandbits(64) for _ in range(300)} | {(0x12345 << 44) | i << 20 for i in range(300)})
    table = spark.createDataFrame([(k - (1 << 64) if k >> 63 else k,) for k in keys], "key bigint")
    found, depths = D.build_directory(table, 20)
    buckets = found.collect()
    assert depths[-1] > 35 and sum(b["keys"] for b in buckets) == len(keys)
    for b in buckets:
        held = [k for k in keys if k >> (64 - b["depth"]) == b["slot"] & (1 << b["depth"]) - 1] if b["depth"] else keys
        assert len(held) == b["keys"] <= 20
        assert b["bucket"] % (1 << 64) == (b["slot"] << (64 - b["depth"])) % (1 << 64)
    routed = D.looked_up(table, found, depths)
    assert routed.count() == len(keys) and routed.select("bucket").distinct().count() == len(buckets)
    assert D.build_directory(table.limit(0), 20)[1] == [0]


@pytest.mark.parametrize("listed", [0, 1 << 20])
def test_sizes_that_are_broadcast_and_beyond(spark, docs, listed):
    many = docs.unionByName(spark.createDataFrame([(1000 + i, "the same text", "en", "s", 13) for i in range(300)], docs.schema))
    rows = [(r["doc_id"], r["text"]) for r in many.collect()]
    for bits in (64, 1):
        found = D.exact_dedup(many, key_bits=bits, capacity=2, listed=listed).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
        assert sorted(map(tuple, found.collect())) == brute(rows)


def test_bytes_decide_not_hashes(spark):
    """All texts under one key: the chain walk alone tells them apart."""
    texts = ["a", "b", "a\x00", "a ", "é", "e\u0301", "\u0000", "", "b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {r["doc_id"]: r for r in D.exact_dedup(docs, key_bits=1).collect()}
    assert [found[i]["group_size"] for i in range(9)] == [1, 2, 1, 1, 1, 1, 1, 1, 2]


def test_copies_go_whatever_their_ids(spark):
    rows = [(7, "x", 1), (7, "y", 2), (9, "x", 3), (5, "same", 4), (5, "same", 5), (None, "x", 6), (None, "z", 7), (None, "z", 8)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n int").repartition(3)
    kept = D.drop_copies(docs).collect()
    assert sorted(r["text"] for r in kept) == ["same", "x", "y", "z"]
    assert next(r["doc_id"] for r in kept if r["text"] == "x") == 9


def test_long_texts(spark):
    long = "word " * 600_000
    docs = spark.createDataFrame([(1, long), (2, long), (3, long + "x"), (4, "x" * 3_000_000)], "doc_id bigint, text string")
    found = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in D.exact_dedup(docs).collect()}
    assert found == {1: (2, 2), 2: (2, 2), 3: (3, 1), 4: (4, 1)}


def test_odd_and_empty_tables(odd, empty):
    rows = D.exact_dedup(odd).collect()
    found = {(r["doc_id"], r["text_sha256"]): r for r in rows}
    alone = found[None, hashlib.sha256(b"no id here").hexdigest()]
    assert alone["keep_id"] is None and alone["kept"] and alone["group_size"] == 1
    twice = [r for r in rows if r["text_sha256"] == hashlib.sha256(b"twice the same row").hexdigest()]
    assert [r["group_size"] for r in twice] == [2, 2] and sum(r["kept"] for r in twice) == 1
    assert len(rows) == odd.count() and sum(r["kept"] for r in rows) == D.drop_copies(odd).count()
    assert D.exact_dedup(empty).count() == 0
    assert D.drop_copies(odd).columns == odd.columns
    assert D.drop_copies(empty).count() == 0


def test_normalised_and_native(docs):
    lower = D.exact_dedup(docs, normalise=F.lower(F.trim("text")))
    assert lower.agg({"group_size": "max"}).first()[0] >= 3
    plan = D.exact_dedup(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan
