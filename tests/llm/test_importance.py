"""Importance resampling against plain loops."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from folioscope.llm import importance as I

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def features(text):
    w = WORDS.findall((text or "").translate(LOWER))
    return len(w), [" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def bucket(f, buckets=10_000):
    return zlib.crc32(f.encode()) % buckets


def plain(docs, target):
    """Rows (id, n_features, weight, score, rank) of docs (id, text)."""
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(map(bucket, features(text)[1]))
    for text in target:
        t.update(map(bucket, features(text)[1]))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000)))) for b in range(10_000)]
    out, enough = [], []
    for n, (id_, text) in enumerate(docs):
        words, f = features(text)
        h = int(hashlib.sha256(f"42:{'' if id_ is None else id_}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(x)] for x in f)
        out.append([id_, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
        if words >= 20:
            enough.append(n)
    enough.sort(key=lambda n: (-out[n][3], out[n][0] is None, out[n][0] or 0))
    for rank, n in enumerate(enough[: 5 * len(enough) // 100], 1):
        out[n][4] = rank
    return sorted(map(tuple, out), key=repr)


def got(df):
    return sorted(((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


def corpus(seed, n, vocabulary):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé数") for _ in range(rng.randint(1, 9))) for _ in range(vocabulary)]
    return [(i, " ".join(rng.choice(words).title() + rng.choice(["", ",", ".\n"]) for _ in range(rng.choice([3, 19, 20, 40, 400])))) for i in rng.sample(range(5 * n), n)]


@pytest.mark.parametrize("owners", [None, 3])
def test_equals_the_plain_form(spark, owners):
    docs = corpus(1, 220, 300)
    target = [t for _, t in corpus(2, 10, 50)] + [docs[0][1], None]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)
    aims = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id bigint, text string")
    assert got(I.resample(df, aims, owners=owners)) == plain(docs, target)


def test_chunks_and_pieces_change_nothing(spark, monkeypatch):
    docs = corpus(3, 60, 40) + [(999, "so " * 3000 + "x" * 5000 + " tail words here " * 50)]
    target = ["so so tail words here"]
    chunk, piece = 3000, 200
    texts = spark.createDataFrame(docs, "doc_id bigint, text string").coalesce(1)
    aims = spark.createDataFrame([(1, target[0])], "item_id bigint, text string")
    # Workers import the module anew, so the small sizes are set in the function they get.
    whole = got(I.resample(texts, aims))
    assert whole == plain(docs, target)
    monkeypatch.setattr(I, "PIECE", piece)
    monkeypatch.setattr(I, "CHUNK", chunk)
    for text in [t for _, t in docs]:
        parts = list(I.pieces(text.translate(LOWER).encode()))
        assert [last for _, last in parts] == [False] * (len(parts) - 1) + [True]
        words, runs, doc, n = I.chunk_runs([(0, p, last) for p, last in parts])
        one, want, _, m = I.chunk_runs([(0, text.translate(LOWER).encode(), True)])
        spell = lambda w, r: [[*w.to_pylist(), None][i] for c in r for i in c.tolist()]
        assert n.sum() == m.sum() and spell(words, runs) == spell(one, want)


def test_blocks_give_the_same_sums_however_texts_are_cut():
    docs = corpus(5, 80, 60)
    parts = [(i, t.translate(LOWER).encode(), True) for i, (_, t) in enumerate(docs)]
    rows = np.arange(100, 100 + len(docs))
    sums, weights = [], []
    for cuts, owners in (([0, 80], 1), ([0, 10, 35, 80], 4)):
        per = {}
        for a, b in zip(cuts, cuts[1:], strict=False):
            for o, block in I.chunk_blocks([(i - a, t, x) for i, t, x in parts[a:b]], rows[a:b], owners)[0]:
                per.setdefault(o, []).append(block)
        total, held = np.zeros(500, np.int64), Counter()
        gains = np.arange(500) * 7 - 900
        for blocks in per.values():
            s, hashed = I.owned(blocks, 500, True)
            total += s
            for h in hashed:
                for r, w in zip(*I.joined(h, gains)[1:], strict=True):
                    held[int(r)] += int(w)
        sums.append(total.tolist())
        weights.append(held)
    assert sums[0] == sums[1] and weights[0] == weights[1]
    want = Counter(bucket(f, 500) for _, t in docs for f in features(t)[1])
    assert sums[0] == [want[b] for b in range(500)]


def test_crc_of_joined_texts():
    rng = random.Random(2)
    pairs = [(bytes(rng.randrange(256) for _ in range(rng.randint(0, 9))), bytes(rng.randrange(256) for _ in range(rng.choice([0, 1, 7, 300, 70000])))) for _ in range(40)]
    a, b = (np.array([zlib.crc32(p[k]) for p in pairs], np.uint32) for k in (0, 1))
    kinds, kind = np.unique([len(y) for _, y in pairs], return_inverse=True)
    assert I.crc_join(I.crc_tables(kinds), a, b, kind).tolist() == [zlib.crc32(x + y) for x, y in pairs]


def test_very_many_words_are_ordered_without_packing():
    for most in (3, 1 << 20, 1 << 40):
        runs = list(np.random.default_rng(1).integers(0, most, (3, 50)))
        assert I.entry_order(runs, most).tolist() == sorted(range(50), key=lambda i: [c[i] for c in runs])


def test_odd_rows(spark, odd, docs):
    for table in (odd, docs):
        rows = [(r["doc_id"], r["text"]) for r in table.select("doc_id", "text").collect()]
        target = ["the on er", None, ""]
        aims = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id bigint, text string")
        assert got(I.resample(table, aims)) == plain(rows, target)


def test_empty_tables(spark, empty, docs):
    aims = spark.createDataFrame([], "item_id bigint, text string")
    assert got(I.resample(empty, aims)) == []
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert got(I.resample(docs, aims)) == plain(rows, [])


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_the_query_on_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert got(I.op12(spark, SF)) == plain(rows, target)
