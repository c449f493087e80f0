import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioscope.llm import fingerprints as P
from folioscope.llm.words import shingles, word_hashes


def test_edited_texts_and_neighbours(docs):
    rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), reverse=True)
    found = {r["doc_id"]: r for r in P.edited_fingerprints(docs).collect()}
    assert len(found) == len(rows)
    for at, (i, text) in enumerate(rows):
        after = rows[(at + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert found[i]["n_chars"] == len(text)
        assert found[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        own, other, following = P.sketches([t.encode() for t in (text, edited, after)])
        assert found[i]["fingerprint"] == P.pack(own) and found[i]["edited_fingerprint"] == P.pack(other)
        assert found[i]["near_edited"] == P.resemblance(own, other) and found[i]["near_next"] == P.resemblance(own, following)


def test_runs_of_far_ids(spark):
    ids = [5, 300, 301, 70_000, 10**7, 10**12, -4]
    docs = spark.createDataFrame([(i, f"text of {i} " * 5) for i in ids], "doc_id bigint, text string")
    found = {r["doc_id"]: r["edited_sha256"] for r in P.edited_fingerprints(docs).collect()}
    order = sorted(ids, reverse=True)
    for at, i in enumerate(order):
        a, b = f"text of {i} " * 5, f"text of {order[(at + 1) % len(order)]} " * 5
        assert found[i] == hashlib.sha256((a[: len(a) - len(a) // 2] + b[: len(a) // 2]).encode()).hexdigest()


def successors(rows):
    """Edited texts by the definition, of rows (id, text) without repeated ids."""
    order = sorted(rows, reverse=True)
    out = {}
    for at, (i, a) in enumerate(order):
        b = order[(at + 1) % len(order)][1]
        out[i] = hashlib.sha256((a[: len(a) - len(a) // 2] + b[: len(a) // 2]).encode()).hexdigest()
    return out


@pytest.mark.parametrize("runs", [1, 2, 7, 64])
def test_random_sparse_ids(spark, runs):
    rng = random.Random(runs)
    rows = [(rng.getrandbits(62) * rng.choice([1, -1]), f"text {rng.random()} " * rng.randrange(6)) for _ in range(700)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    found = P.edited_fingerprints(docs, runs=runs)
    assert {r["doc_id"]: r["edited_sha256"] for r in found.collect()} == successors(rows)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert runs == 1 or "SinglePartition" not in plan


def test_rows_that_repeat_an_id_and_a_text(spark):
    """Half of the rows are equal: each follows itself but for one, which meets the next document."""
    rows = [(i, f"{i} text") for i in range(300)] + [(150, "150 text")] * 2500 + [(None, "none")] * 40 + [(None, f"other {i}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    found = P.edited_fingerprints(docs, runs=9).collect()
    assert len(found) == len(rows)
    own = [r for r in found if r["doc_id"] == 150]
    assert len(own) == 2501 and sum(r["edited_sha256"] == hashlib.sha256(b"150 150 ").hexdigest() for r in own) == 2500
    assert sum(r["edited_sha256"] == hashlib.sha256(b"150 149 ").hexdigest() for r in own) == 1
    rest = successors(rows[:300])
    assert all(rest[r["doc_id"]] == r["edited_sha256"] for r in found if r["doc_id"] not in (None, 0, 150))
    assert sum(r["doc_id"] is None for r in found) == 80


def test_a_long_text(spark):
    docs = spark.createDataFrame([(1, "word " * 1_000_000), (2, "x" * 3_000_000), (3, "short")], "doc_id bigint, text string")
    found = {r["doc_id"]: r for r in P.edited_fingerprints(docs).collect()}
    assert found[1]["n_chars"] == 5_000_000 and found[2]["edited_sha256"] == hashlib.sha256(("x" * 1_500_000 + ("word " * 1_000_000)[:1_500_000]).encode()).hexdigest()


def test_ids_that_are_texts(spark):
    texts = ["one two three four five six", "", "seven eight nine", "ten " * 40, None, "seven eight nine"]
    ids = ["b", "a", "10", "9", None, "b"]
    numbers = {"b": 4, "a": 3, "9": 2, "10": 1, None: None}  # in order of texts
    named = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id string, text string")
    plain = spark.createDataFrame([(numbers[i], t) for i, t in zip(ids, texts, strict=True)], "doc_id bigint, text string")
    key = lambda df, to: sorted(((to(r["doc_id"]), *r[1:]) for r in df.collect()), key=repr)
    assert key(P.edited_fingerprints(named), lambda i: numbers[i]) == key(P.edited_fingerprints(plain), lambda i: i)


def test_odd_and_empty_tables(odd, empty):
    assert P.edited_fingerprints(odd).count() == odd.count()
    assert P.edited_fingerprints(odd).where("doc_id IS NULL").count() == 1
    assert P.edited_fingerprints(empty).count() == 0 and P.fingerprint(empty).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.sets(st.integers(0, 4000), min_size=1, max_size=900), st.sets(st.integers(0, 4000), min_size=1, max_size=900))
def test_estimates(a, b):
    both = [P.sketch(shingles(np.array(sorted(s), np.uint64), 1)) for s in (a, b)]
    near = len(a & b) / len(a | b)
    assert abs(P.resemblance(*both) - near) < 0.2
    assert abs(P.containment(*both) - len(a & b) / len(a)) < 0.35
    assert abs(P.distinct(both[0]) / len(a) - 1) < 0.5
    assert (P.merge(*both) == P.sketch(shingles(np.array(sorted(a | b), np.uint64), 1))).all()
    assert (P.unpack(P.pack(both[0])) == both[0]).all()


def test_word_hashes_do_not_depend_on_place():
    one, two = word_hashes([b"x yy zzz x", "été\tX".encode()])
    assert one[0] == one[3] == two[1] and len(set(one.tolist())) == 3 and len(two) == 2
