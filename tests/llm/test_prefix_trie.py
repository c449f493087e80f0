"""The trie against one built with dictionaries."""

import hashlib
import math
import os
import random
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from folioscope.llm import prefix_trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
SF = "/root/testdata/sf0.001"


def plain(rows):
    """rows (conv_id, turn, role, text) -> the nodes' rows; equal turns must not tell."""
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [(r, x) for _, _, r, x in sorted(t)] for c, t in turns.items()}
    full = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        full[c] = turns.get(c - int(math.fmod(c, 5)), [])[:h] + own[h:]
    members, ends, children = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, t in sorted(full.items()):
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
            if d:
                children[tuple(t[: d - 1])].add(tuple(t[:d]))
        ends[tuple(t)].append(c)
    leaves, saved = defaultdict(int), defaultdict(int)
    for node in sorted(members, key=len, reverse=True):
        leaves[node] += not children[node]
        saved[node] += (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        if node:
            leaves[node[:-1]] += leaves[node]
            saved[node[:-1]] += saved[node]
    return sorted(
        (m[0], len(n), members[n[:-1]][0] if n else -1, len(m), len(children[n]), leaves[n], saved[n], hashlib.sha256(",".join(map(str, ends[n])).encode()).hexdigest()) for n, m in members.items()
    )


def got(df):
    return sorted((r["conv_id"], r["depth"], -1 if r["parent_conv_id"] is None else r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in df.collect())


def table(seed, convs, longest, words):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(convs * 2), convs):
        n = rng.randint(1, longest)
        shared = rng.random() < 0.5
        for t in range(n):
            text = "same start" if shared and t < 3 else rng.choice(words)
            rows.append((c, None if t == 0 and rng.random() < 0.3 else t, rng.choice(["user", None]) if not shared else "user", text))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_equals_the_plain_trie(spark, seed):
    rows = table(seed, 60, 14, ["a", "b é", None, ""])
    assert got(prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(5))) == plain(rows)


def test_nested_chains_and_a_long_conversation(spark):
    # Ids divisible by five keep their own turns: each is a prefix of the next, in both orders.
    up = [(5 * n, t, "u", f"t{t}") for n in range(1, 25) for t in range(n)]
    down = [(1000 - 5 * n, t, "u", f"t{t}") for n in range(1, 25) for t in range(n)]
    long_ = [(2000, t, "u", f"t{t % 7}") for t in range(1500)]
    for rows in (up, down, up + down + long_):
        assert got(prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(4))) == plain(rows)


def test_many_conversations_that_end_at_one_node(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 7)
    rows = [(5 * c, 0, "user", "hi") for c in range(300)] + [(5 * c + 1, 0, "user", "dropped or kept") for c in range(300)]
    found = prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(6))
    assert got(found) == plain(rows)


def test_odd_rows(spark):
    rows = [(None, 1, "user", "nobody's"), (3, 1, "user", "no base"), (7, 1, "user", "x"), (7, 1, "user", "x"), (5, None, None, None), (5, 2, "user", "y"), (-3, 0, "user", "below zero"), (0, 1, "u", "long " * 20000)]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("owner", "depth", "n", "up", "first"):
        df = df.withColumn(name, F.lit("clash"))
    assert got(prefix_trie.prefix_trie(df)) == plain(rows)


def test_an_empty_table(spark):
    assert got(prefix_trie.prefix_trie(spark.createDataFrame([], SCHEMA))) == []


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_the_query_on_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(prefix_trie.op13(spark, SF)) == plain(rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_the_sql_has_the_same_rows():
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    found = duck.execute(prefix_trie.SQL)
    names = [d[0] for d in found.description]
    assert names == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    rows = duck.execute("SELECT conv_id, turn, role, text FROM conversations").fetchall()
    assert sorted(tuple(-1 if v is None else v for v in r) for r in duck.execute(prefix_trie.SQL).fetchall()) == plain(rows)
