import math
import random

import pyarrow as pa
import pytest

from folioscope.llm import near_dedup as N
from folioscope.llm.components import components

from .conftest import words


def brute(rows, k, percent):
    sets = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets.append((i, {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()))
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                parent[find(a)] = find(b)
    out = {}
    for n, (i, s) in enumerate(sets):
        same = [j for m, (j, _) in enumerate(sets) if find(m) == find(n)]
        out[i] = (len(s), min((j for j in same if j is not None), default=None))
    return out


def family(seed, n, edits):
    """A group of near copies of one text, and texts that share only a passage with it."""
    rng = random.Random(seed)
    base = words(seed, 120).split()
    out = []
    for i in range(n):
        copy = base.copy()
        for _ in range(rng.randint(0, edits)):
            copy[rng.randrange(len(copy))] = f"new{i}x{rng.randrange(9)}"
        out.append(" ".join(copy))
    out += [" ".join([*words(seed + 100 + i, 60).split(), *base[:50], *words(seed + 500 + i, 30).split()]) for i in range(n // 2)]
    return out


@pytest.mark.parametrize(("k", "percent", "small", "block"), [(3, 90, 16, 128), (5, 80, 3, 8), (3, 90, 2, 4), (1, 100, 2, 4)])
def test_components_against_brute_force(spark, texts, monkeypatch, k, percent, small, block):
    monkeypatch.setattr(N, "SMALL", small)
    monkeypatch.setattr(N.bucket_pairs, "__defaults__", (small,))
    monkeypatch.setattr(N, "BLOCK", block)
    monkeypatch.setattr(N, "ROOM", 120)
    rows = list(enumerate([*texts, *family(1, 40, 9), *family(2, 30, 3)], 100))
    random.Random(0).shuffle(rows)
    found = N.jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), k, percent).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == brute(rows, k, percent)


@pytest.mark.parametrize("most", [1, 3])
def test_cut_list_of_frequent_shingles_against_brute_force(spark, monkeypatch, most):
    """Texts that share a passage and are alone in their bands of size, and a near copy of each in
    the next band."""
    monkeypatch.setattr(N, "SMALL", 3)
    monkeypatch.setattr(N.bucket_pairs, "__defaults__", (3,))
    monkeypatch.setattr(N, "MOST_FREQUENT", most)
    width, passage, rows = N.band_width(80), [f"common{i}" for i in range(30)], []
    for j in range(18, 30, 2):
        edge = int(math.exp(j * width)) + 1
        text = [*passage, *(f"own{j}x{i}" for i in range(edge + 3 - len(passage)))]
        rows += [(2 * j, " ".join(text[:-6])), (2 * j + 1, " ".join(text))]  # the hub's row comes first
    found = N.jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string"), 1, 80).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == brute(rows, 1, 80)


@pytest.mark.parametrize("longest", [1024, 4])
def test_a_full_list_of_frequent_shingles_leaves_out_far_pairs(spark, monkeypatch, longest):
    """Texts of few different words share many shingles; a pair is compared only if its prefixes say so."""
    monkeypatch.setattr(N, "SMALL", 3)
    monkeypatch.setattr(N, "LONGEST", longest)
    rng, compared = random.Random(5), []
    rows = [(i, " ".join(f"w{rng.randrange(60)}" for _ in range(150))) for i in range(60)]
    rows += [(100 + i, t + " end") for i, t in rows[:9]]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    run = N.overlaps
    monkeypatch.setattr(N, "overlaps", lambda pairs, *rest: compared.append(pairs.count()) or run(pairs, *rest))
    for most in (1 << 18, 200):
        monkeypatch.setattr(N, "MOST_FREQUENT", most)
        found = N.jaccard_components(frame, 2, 90).collect()
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == brute(rows, 2, 90)
    assert longest == 4 or compared[1] < 200


def test_one_of_a_component_stays_whatever_its_id(spark):
    base, other = words(21, 60), words(22, 60)
    near = base + " more"
    rows = [(7, base, 1), (7, other, 2), (5, near, 3), (5, near, 4), (None, base, 5), (None, words(23, 50), 6), (None, words(23, 50), 7), (8, "", 8), (8, None, 9)]
    kept = N.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string, n int").repartition(3)).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept) == sorted([(5, near), (7, other), (0, words(23, 50)), (8, ""), (8, "")])


def test_many_equal_rows_and_null_ids(spark):
    base = words(31, 40)
    rows = [(None, base) for _ in range(150)] + [(i, base.upper() if i % 2 else "") for i in range(200)] + [(1000, words(32, 30))]
    found = N.jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4), 3, 90)
    assert found.count() == len(rows) and found.where("kept").count() == 1 + 100 + 1
    assert {r["component_id"] for r in found.where("n_shingles > 0").collect()} == {1, 1000}


def test_odd_and_empty_tables(odd, empty):
    found = N.jaccard_components(odd, 3, 90).collect()
    assert len(found) == odd.count()
    assert all(r["component_id"] == r["doc_id"] for r in found if not r["n_shingles"])
    kept = N.keep_one(odd)
    assert kept.columns == odd.columns
    assert N.jaccard_components(empty, 3, 90).count() == 0 and N.keep_one(empty).count() == 0


def test_pairs_do_not_depend_on_batches():
    rng = random.Random(3)
    rows = sorted((rng.randrange(6), rng.randrange(5, 40), i) for i in range(150))

    def run(size):
        batches = [pa.RecordBatch.from_pydict({"token": [t for t, _, _ in part], "cid": [c for _, _, c in part], "n": [n for _, n, _ in part], "spare": [0] * len(part)}) for part in (rows[i : i + size] for i in range(0, len(rows), size))]
        return {tuple(r.values()) for b in N.bucket_pairs(90, 5)(iter(batches)) for r in b.to_pylist() if r["x"] != r["y"]}

    assert run(1) == run(7) == run(1000)


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (9, 9), (10, 11), (11, 12), (12, 13), (13, 14), (14, 1)]
    found = dict(map(tuple, components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()))
    assert found == {**dict.fromkeys((1, 2, 3, 10, 11, 12, 13, 14), 1), 4: 4, 5: 4}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_long_texts(spark):
    long = " ".join(f"w{i}" for i in range(300_000))
    rows = [(1, long), (2, long + " more"), (3, "x" * 2_000_000), (4, "same " * 400_000), (5, "same " * 400_000)]
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in N.jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string"), 3, 90).collect()}
    assert found == {1: (299_998, 1), 2: (299_999, 1), 3: (1, 3), 4: (1, 4), 5: (1, 4)}
