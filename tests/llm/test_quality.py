import numpy as np
import pytest

from folioscope.llm import quality as Q

from .conftest import words


@pytest.fixture(scope="module")
def mixed(spark):
    bad = [lambda t: t.upper().replace(" ", "!! "), lambda t: t.replace(" ", "### "), lambda t: t.replace(" ", " | "), lambda t: " ".join(w + " " + w + " " + w for w in t.split())]
    rows = []
    for i in range(800):
        text = words(i, 60)
        rows.append((i, bad[i // 8 % 4](text) if i % 8 == 0 else text, "en", "s"))
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")


def test_bad_goes_and_good_stays(mixed):
    found = {r["doc_id"]: r for r in Q.classify(mixed).collect()}
    kept = np.array([found[i]["kept"] for i in range(800)])
    bad = np.arange(800) % 8 == 0
    assert kept[~bad].mean() > 0.99 and kept[bad].mean() < 0.15
    assert {r["doc_id"] for r in Q.keep_good(mixed).collect()} == {i for i in found if found[i]["kept"]}


def test_em_finds_accuracies():
    rng = np.random.default_rng(2)
    good = rng.random(4000) < 0.8
    votes = np.stack([np.where(~good & (rng.random(4000) < p), -1, 0) for p in (0.9, 0.7, 0.5)] + [np.where(good & (rng.random(4000) < 0.9), 1, 0)], axis=1)
    patterns, n = np.unique(votes, axis=0, return_counts=True)
    posterior, accuracy = Q.posteriors([(tuple(p), int(c)) for p, c in zip(patterns.tolist(), n, strict=True)])
    assert posterior[-1, -1, 0, 0] < 0.05 and posterior[0, 0, 0, 1] > 0.95 and accuracy.min() > 0.95
    assert Q.posteriors([])[0] == {}


def test_odd_and_empty_tables(odd, empty):
    found = Q.classify(odd).collect()
    assert len(found) == odd.count() and all(0 <= r["quality"] <= 1 for r in found)
    blank = [r["doc_id"] for r in odd.collect() if not (r["text"] or "").split()]
    assert all(not r["kept"] and r["quality"] == 0 for r in found if r["doc_id"] in blank)
    assert Q.keep_good(odd).columns == odd.columns
    assert Q.classify(empty).count() == 0 and Q.keep_good(empty).count() == 0


def slow_posteriors(rows, rounds=100):
    """EM with loops over documents, answers and classes."""
    heuristics = len(rows[0])
    n = len(rows)
    held = []
    for r in rows:
        called = [1.0 if v < 0 else 0.0 for v in r]
        own = [0.1 if any(called) else 0.95]
        rest = [c + 0.05 / heuristics for c in called]
        held.append(own + [(1 - own[0]) * x / sum(rest) for x in rest])
    for _ in range(rounds):
        share = [(sum(h[c] for h in held) + 0.1) / (n + 1) for c in range(heuristics + 1)]
        rate = {}
        for c in range(heuristics + 1):
            for k in range(heuristics):
                count = {a: 0.1 + sum(h[c] for h, r in zip(held, rows, strict=True) if r[k] == a) for a in (-1, 0, 1)}
                if c == 0:
                    rest = count[0] + count[1]
                    prior = {-1: Q.WRONG, 0: (1 - Q.WRONG) * count[0] / rest, 1: (1 - Q.WRONG) * count[1] / rest}
                    count = {a: count[a] + Q.TRUST * n * prior[a] for a in count}
                for a in count:
                    rate[c, k, a] = count[a] / sum(count.values())
        moved, new = 0.0, []
        for r, old in zip(rows, held, strict=True):
            p = [share[c] * np.prod([rate[c, k, r[k]] for k in range(heuristics)]) for c in range(heuristics + 1)]
            new.append([x / sum(p) for x in p])
            moved = max(moved, *(abs(x - y) for x, y in zip(new[-1], old, strict=True)))
        held = new
        if moved < 1e-6:
            break
    return {r: h[0] for r, h in zip(rows, held, strict=True)}


def test_em_against_loops():
    rng = np.random.default_rng(11)
    good = rng.random(150) < 0.7
    votes = np.stack([np.where(~good & (rng.random(150) < 0.8), -1, 0), np.where((rng.random(150) < 0.1) | ~good & (rng.random(150) < 0.5), -1, 0), np.where(good & (rng.random(150) < 0.9), 1, 0)], axis=1)
    rows = [tuple(v) for v in votes.tolist()]
    patterns = sorted({r: rows.count(r) for r in rows}.items())
    posterior, accuracy = Q.posteriors(patterns)
    slow = slow_posteriors(rows)
    assert all(abs(posterior[r] - slow[r]) < 1e-6 for r in slow)
    assert (accuracy > 0.5).all()


def test_scores_against_loops(mixed, odd):
    from .test_words import simple

    rows = mixed.select("doc_id", "text").union(odd.select("doc_id", "text"))
    model = Q.fit(rows.selectExpr("doc_id AS id", "text AS body"))
    found = Q.score(rows.selectExpr("doc_id", "text", "text AS body"), model, ["doc_id", "text"]).collect()
    half = Q.DIMS // 2 - 1
    for r in found[::7]:
        text = (r["text"] or "").encode()
        tf = {}
        words, shapes = simple(text.lower(), ())[0], simple(text.translate(Q._SHAPE), ())[0]
        for d in [w % half for w in words] + [w % half + half for w in shapes]:
            tf[d] = tf.get(d, 0) + 1
        again = sum(a == b for a, b in zip(words, words[1:], strict=False))
        if again:
            tf[Q.DIMS - 1] = tf.get(Q.DIMS - 1, 0) + again
        size = sum(tf.values()) ** 0.5
        margin = model["bias"] + sum(float(model["weights"][d]) * n**0.5 / size for d, n in tf.items()) if words else 0
        assert abs(r["quality"] - (1 / (1 + np.exp(-margin)) if words else 0.0)) < 1e-4
        assert r["kept"] == (r["quality"] >= Q.KEEP)


def test_null_and_equal_ids_are_sampled_by_text(spark, mixed):
    same = mixed.selectExpr("cast(null AS bigint) AS id", "text AS body").union(mixed.selectExpr("5 AS id", "text AS body"))
    model = Q.fit(same, sample=200)
    assert model["weights"] is not None and np.abs(model["weights"]).max() > 0
    kept = Q.score(same.select("id", "body"), model, ["id"]).where("kept").count()
    assert 0.6 * 1600 < kept < 0.95 * 1600


def test_repeated_rows_and_long_texts(spark, mixed):
    long = "a text of very many words and of more of them in the end. " * 60_000
    rows = [(1, long), (1, long), (2, "#### " * 300_000), (3, "x" * 2_000_000), (None, "the same"), (None, "the same")]
    found = Q.classify(mixed.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id bigint, text string"))).where("doc_id IS NULL OR doc_id IN (1, 2, 3)").collect()
    null = [r["quality"] for r in found if r["doc_id"] is None]
    assert len(null) == 2 and null[0] == null[1]
