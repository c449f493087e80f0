import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from folioscope.llm import mixing as M

from .conftest import words


def spread(target, weights, room):
    """Shares of target by weight where nobody gets more than there is room for, round by round."""
    out, left, open_ = [0.0] * len(weights), target, [i for i, r in enumerate(room) if r > 0]
    while open_ and left > 1e-9:
        total = sum(weights[i] for i in open_)
        if total <= 0:
            break
        full = [i for i in open_ if out[i] + left * weights[i] / total >= room[i]]
        if not full:
            for i in open_:
                out[i] += left * weights[i] / total
            break
        for i in full:
            left -= room[i] - out[i]
            out[i] = room[i]
        open_ = [i for i in open_ if i not in full]
    return out


def brute_budgets(tokens, total, weights, max_epochs):
    def under(node):
        return sorted({leaf[: len(node) + 1] for leaf in tokens if leaf[: len(node)] == node and len(leaf) > len(node)}, key=repr)

    def room(node):
        return max_epochs * sum(n for leaf, n in tokens.items() if leaf[: len(node)] == node)

    def given(node, target):
        if node in tokens:
            return {node: target}
        parts = spread(target, [weights.get(c, 1.0) for c in under(node)], [room(c) for c in under(node)])
        return {k: v for c, t in zip(under(node), parts, strict=True) for k, v in given(c, t).items()}

    return given((), min(total, room(()))) if tokens else {}


def budgets(spark, tokens, total, weights, max_epochs):
    width = max((len(k) for k in tokens), default=1)
    names = [f"l{i}" for i in range(width)]
    leaves = spark.createDataFrame([(*k, n) for k, n in tokens.items()], ", ".join(f"{n} string" for n in names) + ", leaf_tokens bigint")
    return {tuple(r[n] for n in names): r["budget"] for r in M.budgets(leaves, names, total, weights, max_epochs).collect()}


def test_budgets_against_rounds(spark):
    rng = random.Random(4)
    for _ in range(6):
        tokens = {(rng.choice("ab"), rng.choice(["x", None, "y\"é"]), f"s{i}"): rng.randrange(1, 500) for i in range(rng.randrange(1, 40))}
        weights = {k[:d]: rng.choice([0.0, 0.5, 3.0]) for k in tokens for d in (1, 2, 3) if rng.random() < 0.4}
        total = rng.random() * 2 * sum(tokens.values())
        found, want = budgets(spark, tokens, total, weights, 2), brute_budgets(tokens, total, weights, 2)
        assert found.keys() == want.keys() and all(math.isclose(found[k], want[k], rel_tol=1e-9, abs_tol=1e-6) for k in want)


def test_shortages_go_to_siblings_before_ancestors(spark):
    tokens = {("a", "x"): 10, ("a", "y"): 1000, ("b", "z"): 1000}
    got = budgets(spark, tokens, 200, {}, 1)
    assert got == {("a", "x"): 10, ("a", "y"): 90, ("b", "z"): 100}
    tokens = {("a", "x"): 10, ("a", "y"): 20, ("b", "z"): 1000}
    assert budgets(spark, tokens, 200, {}, 1) == {("a", "x"): 10, ("a", "y"): 20, ("b", "z"): 170}
    assert budgets(spark, tokens, 10**9, {}, 2) == {k: 2 * v for k, v in tokens.items()}
    weighted = budgets(spark, {("a",): 1000, ("b",): 1000}, 100, {("a",): 3.0}, 1)
    assert weighted == {("a",): 75.0, ("b",): 25.0}
    assert budgets(spark, {}, 10, {}, 1) == {}


@pytest.fixture(scope="module")
def tagged(spark):
    rows = [(i, words(i, 10 + i % 30), ["en", "fr"][i % 5 == 0], f"src{min(i % 7, 3)}") for i in range(300)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")


@pytest.mark.parametrize("ranges", [2, 16, 4096])
def test_prefixes_against_brute_force(tagged, ranges):
    levels = [("lang", F.col("lang")), ("source", F.col("source"))]
    found = M.mix_sources(tagged, levels, 0.7, {("fr",): 2.0}, 2, 1, ranges=ranges).collect()
    assert len(found) == 300
    tokens = defaultdict(int)
    for r in found:
        tokens[r["lang"], r["source"]] += r["n_tokens"]
    given = brute_budgets(tokens, 0.7 * sum(tokens.values()), {("fr",): 2.0}, 2)
    at = tagged.select("doc_id", "lang", "source", *[F.xxhash64(F.lit(1), F.lit(w), "lang", "source", "doc_id", F.xxhash64("text")).alias(f"o{w}") for w in (0, 1, 2)]).collect()
    place = {r["doc_id"]: r for r in at}
    for leaf, budget in given.items():
        whole = int(budget // tokens[leaf])
        own = sorted((r for r in found if (r["lang"], r["source"]) == leaf), key=lambda r: place[r["doc_id"]][f"o{whole}"] % (1 << 64))
        left = budget - whole * tokens[leaf]
        for r in own:
            assert r["copies"] == whole + (left > 0) and abs(r["budget"] - budget) < 1e-6
            left -= r["n_tokens"]


def test_odd_and_empty_tables(odd, empty):
    found = M.mix_sources(odd, M.tree(), weights=M.language_weights()).collect()
    assert len(found) == odd.count() and all(r["copies"] == 0 for r in found if not r["n_tokens"])
    kept = M.keep_mixture(odd, 0.5)
    assert kept.columns == odd.columns and 0 < kept.count() < odd.count()
    assert M.mix_sources(empty, M.tree()).count() == 0 and M.keep_mixture(empty).count() == 0


def test_long_texts_and_clashing_columns(spark, tagged):
    rows = [(1000, "word " * 500_000, "en", "src0"), (1001, "x" * 2_000_000, "en", "src0")]
    docs = tagged.union(spark.createDataFrame(rows, tagged.schema)).withColumn("leaf", F.lit("a")).withColumn("parent", F.lit("b")).withColumn("weight", F.lit(1))
    found = {r["doc_id"]: r["n_tokens"] for r in M.mix_sources(docs, [("lang", F.col("lang")), ("source", F.col("source"))]).collect()}
    assert found[1000] == 500_000 and found[1001] == 1 and len(found) == 302
    kept = M.keep_mixture(docs, 0.5)
    assert kept.columns == docs.columns
