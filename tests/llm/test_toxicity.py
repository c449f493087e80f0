import numpy as np
import pytest

from folioscope.llm import toxicity as X

from .conftest import words


@pytest.fixture(scope="module")
def talk(spark):
    rng = np.random.default_rng(4)
    rows, labels = [], []
    for i in range(900):
        text = words(i, 40).split()
        bad = i % 6 == 0
        for _ in range(1 + i % 4 if bad else 0):
            text.insert(int(rng.integers(len(text))), str(rng.choice(["scoundrel", "vile", "wretch"])))
        rows.append((i, " ".join(text), "en", "s"))
        if i % 3 != 1:
            labels.append((i, None if i % 31 == 0 else int(bad)))
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")


def test_toxic_ones_are_caught_and_clean_left(talk):
    found = {r["doc_id"]: r for r in X.grade_toxicity(*talk).collect()}
    toxic = np.array([found[i]["toxic"] for i in range(900)])
    bad = np.arange(900) % 6 == 0
    assert toxic[bad].mean() > 0.95 and toxic[~bad].mean() < 0.01
    severity = [np.mean([found[i]["severity"] for i in range(900) if i % 6 == 0 and i % 4 == k]) for k in (0, 2)]
    assert severity[0] < severity[1]
    assert all(0 <= r["severity"] <= 3 and (r["grade"] >= 1) == r["toxic"] for r in found.values())


def test_ordinal_fit_recovers_thresholds():
    rng = np.random.default_rng(0)
    x = rng.random(4000) * 4
    grade = (x[:, None] + rng.logistic(0, 0.3, (4000, 1)) > np.array([1.0, 2.0, 3.0])).sum(axis=1)
    rows = [(np.array([0]), np.array([v])) for v in x]
    w, limits = X.fit_ordinal(rows, grade, 1)
    assert np.allclose(limits / w[0], [1, 2, 3], atol=0.15) and (np.diff(limits) > 0).all()


def test_odd_and_empty_tables(spark, odd, empty, talk):
    labels = spark.createDataFrame([(7, 1), (7, 0), (None, 1), (0, None), (37, 0)], "doc_id bigint, toxic int")
    assert X.grade_toxicity(odd, labels).count() == odd.count()
    assert X.grade_toxicity(empty, labels).count() == 0
    none = X.grade_toxicity(odd, labels.limit(0)).collect()
    assert all(r["severity"] == 0 and not r["toxic"] for r in none)


def slow_score(text, model):
    """Probabilities above each threshold, word by word."""
    from .test_words import simple

    dims = [h >> 64 - X.BITS for h in simple(text.encode().lower().translate(X._MARKS), X.PREFIXES)[0]]
    place = {int(d): i for i, d in enumerate(model["words"])}
    hits = [place[d] for d in dims if d in place]
    margin = sum(model["weights"][i] for i in set(hits))
    margin += model["weights"][len(place)] * np.log1p(len(hits)) + model["weights"][len(place) + 1] * np.log1p(100 * len(hits) / max(1, len(dims)))
    return [1 / (1 + np.exp(t - margin)) for t in model["limits"]]


def test_words_and_scores_against_loops(talk):
    from .test_words import simple

    docs, labels = talk
    model = X.fit(docs.selectExpr("doc_id AS id", "text AS body"), labels.selectExpr("doc_id AS id", "toxic"))
    known = {r["doc_id"]: r["toxic"] for r in labels.collect() if r["toxic"] is not None}
    seen = {0: {}, 1: {}}
    rows = docs.collect()
    for r in rows:
        if r["doc_id"] in known:
            for d in {h >> 64 - X.BITS for h in simple(r["text"].encode(), X.PREFIXES)[0]}:
                seen[known[r["doc_id"]]][d] = seen[known[r["doc_id"]]].get(d, 0) + 1
    toxic, clean = sum(known.values()), len(known) - sum(known.values())
    want = []
    for d, a in seen[1].items():
        b = seen[0].get(d, 0)
        low = np.log((a + 0.5) / (b + 0.5)) - X.Z * np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
        if a >= max(X.LEAST, X.SHARE * toxic) and low > np.log(2 * toxic / clean):
            want.append(d)
    assert sorted(want) == model["words"].tolist()
    found = {r["doc_id"]: r for r in X.grade_toxicity(docs, labels).collect()}
    for r in rows[::9]:
        above = slow_score(r["text"], model)
        assert abs(found[r["doc_id"]]["severity"] - sum(above)) < 1e-6 and found[r["doc_id"]]["grade"] == sum(p >= 0.5 for p in above)


def test_fit_is_a_minimum_of_the_likelihood():
    """The gradient, taken by differences of the plain likelihood, is about zero."""
    rng = np.random.default_rng(6)
    rows = [(np.array([0, 1]), rng.random(2)) for _ in range(200)]
    grade = np.array([min(3, int(4 * (0.7 * v[0] + 0.3 * rng.random()))) for _, v in rows])
    w, t = X.fit_ordinal(rows, grade, 2, steps=4000)

    def loss(w, t):
        total = 0.0
        for (c, v), g in zip(rows, grade, strict=True):
            edges = [-np.inf, *t, np.inf]
            p = [1 / (1 + np.exp(-(e - v @ w[c]))) for e in (edges[g + 1], edges[g])]
            total -= np.log(p[0] - p[1])
        return total / len(rows) + 0.5e-4 * (w**2).sum()

    for i in range(2):
        step = np.eye(2)[i] * 1e-4
        assert abs(loss(w + step, t) - loss(w - step, t)) / 2e-4 < 5e-3
    for i in range(3):
        step = np.eye(3)[i] * 1e-4
        assert abs(loss(w, t + step) - loss(w, t - step)) / 2e-4 < 5e-3


def test_grades_come_from_the_other_folds():
    rng = np.random.default_rng(3)
    toxic = np.arange(60) % 3 == 0
    rows = [(np.array([0]), np.array([2.0 * t + rng.random()])) for t in toxic]
    odds = X.out_of_fold(rows, toxic, 1)
    changed = X.out_of_fold([*rows[:7], (np.array([0]), np.array([50.0])), *rows[8:]], toxic, 1)
    assert (odds[2::5] == changed[2::5])[[i != 1 for i in range(12)]].all() and (odds[0::5] != changed[0::5]).any()
    grades = X.graded(toxic, odds)
    assert (grades[~toxic] == 0).all() and set(grades[toxic]) == {1, 2, 3}


def test_one_id_of_many_texts_and_long_texts(spark):
    rows = [(1, f"fine words number {i}") for i in range(300)] + [(2, "vile words " * 200_000), (3, "vile thing"), (4, "vile"), (5, "x" * 1_500_000)]
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 1), (4, 1), (5, 0)], "doc_id bigint, toxic int")
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    model = X.fit(docs.selectExpr("doc_id AS id", "text AS body"), labels.selectExpr("doc_id AS id", "toxic"), sample=100)
    assert model is None or len(model["limits"]) == 3
    found = X.grade_toxicity(docs, labels)
    assert found.count() == len(rows) and found.where("toxic").select("doc_id").distinct().count() == 3
