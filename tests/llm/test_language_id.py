import zlib

import numpy as np
import pytest

from folioscope.llm import language_id as L

WORDS = {"en": "the and that with house have this they are water".split(), "fr": "le la les maison avec nous étaient très eau pour".split(), "de": "der die das haus mit wir waren sehr wasser für".split()}


@pytest.fixture(scope="module")
def spoken(spark):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(rng.choice(WORDS[lang], 25)), lang, "s") for i in range(240) for lang in [list(WORDS)[i % 3]]]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")


def test_held_out_accuracy_and_split(spoken):
    found = {r["doc_id"]: r for r in L.identify(spoken).collect()}
    truth = {r["doc_id"]: r["lang"] for r in spoken.collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    assert {i for i, r in found.items() if r["held_out"]} == set(held)
    assert np.mean([found[i]["lang_pred"] == truth[i] for i in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in found.values())


def test_prediction_looks_at_the_text_only(spark, spoken):
    from pyspark.sql import functions as F

    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1
    other = spoken.withColumn("lang", F.when(fold, "zz").otherwise(F.col("lang"))).withColumn("source", F.lit("other"))
    key = lambda df: sorted(map(tuple, L.identify(df).collect()))
    assert key(spoken) == key(other)


def test_odd_and_empty_tables(spark, odd, empty):
    found = L.identify(odd).collect()
    texts = {r["doc_id"]: r["text"] for r in odd.collect()}
    assert len(found) == odd.count()
    for r in found:
        if not any(c.isalpha() for c in texts[r["doc_id"]] or ""):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        else:
            assert r["lang_pred"] in ("en", "fr")
    assert L.identify(empty).count() == 0
    untold = spark.createDataFrame([(1, "words", None)], "doc_id bigint, text string, lang string")
    assert L.identify(untold).first()["lang_pred"] == "und"


def test_a_language_whose_texts_have_no_letter(spark):
    rows = [(i, "12 7", "xx") for i in range(20)] + [(100 + i, "the house and that water", "en") for i in range(20)]
    found = {r["doc_id"]: r["lang_pred"] for r in L.identify(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()}
    assert found == {i: "und" for i in range(20)} | {100 + i: "en" for i in range(20)}


def test_clusters_are_unit_vectors_and_reject_far_ones():
    rng = np.random.default_rng(1)
    x = np.abs(np.concatenate([rng.normal([1, 0, 0], 0.05, (50, 3)), rng.normal([0, 1, 0], 0.05, (50, 3))]))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    centre, floor = L.cluster(x, 2)
    assert np.allclose(np.linalg.norm(centre, axis=1), 1)
    assert ((x @ centre.T).max(axis=1) >= floor.min()).mean() > 0.9
    assert (np.array([0, 0, 1.0]) @ centre.T < floor).all()


def slow_counts(text):
    letters = "".join(c if c.isalpha() else " " for c in text.lower())
    while "  " in letters:
        letters = letters.replace("  ", " ")
    c, mask, out = [ord(x) for x in letters], (1 << 32) - 1, {}
    for i in range(len(c)):
        grams = [c[i] * 0xC2B2AE3D]
        if i:
            two = c[i - 1] * 0x9E3779B1 + c[i]
            grams.append(two * 0x27D4EB2F)
        if i > 1:
            grams.append(((c[i - 2] * 0x9E3779B1 + c[i - 1]) * 0x85EBCA77 + c[i]) * 0x165667B1)
        for g in grams:
            h = (g & mask ^ (g & mask) >> 15) & L.DIMS - 1
            out[h] = out.get(h, 0) + 1
    return out


def test_counts_by_pieces_against_loops(monkeypatch):
    monkeypatch.setattr(L, "_PIECE", 5)
    for text in ("", "a", "ab", " a  b!! c12d", "Été à la plage — und Straße", "  \n", "İstanbul \U0001d49e"):
        found = L.counts(text)
        assert {d: int(found[d]) for d in np.flatnonzero(found)} == slow_counts(text)


def test_predictions_against_loops(spoken):
    from pyspark.sql import functions as F

    training = spoken.selectExpr("doc_id AS id", "text AS body", "lang").where("doc_id % 4 > 0")
    model = L.fit(training)
    texts = [r["body"] for r in training.collect()]
    seen = {}
    for t in texts:
        for d in slow_counts(t):
            seen[d] = seen.get(d, 0) + 1
    idf = {d: np.log((1 + len(texts)) / (1 + seen.get(d, 0))) + 0.1 for d in range(L.DIMS)}
    assert np.allclose(model["idf"], [idf[d] for d in range(L.DIMS)], atol=1e-5)
    rows = spoken.where("doc_id < 40").withColumn("body", F.col("text"))
    for r in L.predict(rows, model, [F.col("doc_id"), F.col("text")]).collect():
        x = {d: np.log1p(n) * idf[d] for d, n in slow_counts(r["text"]).items()}
        size = sum(v * v for v in x.values()) ** 0.5
        cosine = [sum(v / size * float(c[d]) for d, v in x.items()) for c in model["centre"]]
        best = int(np.argmax(cosine))
        assert r["lang_pred"] == model["lang"][best] and abs(r["score"] - cosine[best]) < 1e-4


def test_equal_and_null_ids_are_sampled_by_text(spark, spoken):
    same = spoken.selectExpr("cast(null AS bigint) AS id", "text AS body", "lang")
    model = L.fit(same.union(same), sample=30)
    assert set(model["lang"]) == set(WORDS)


def test_a_long_text_and_repeated_rows(spark, spoken):
    long = "la maison avec nous " * 250_000
    more = spark.createDataFrame([(5000, long, None, "s"), (7, "the water", "en", "s"), (7, "the water", "en", "s"), (5001, "1 " * 500_000, "en", "s")], spoken.schema)
    found = L.identify(spoken.union(more)).collect()
    assert next(r["lang_pred"] for r in found if r["doc_id"] == 5000) == "fr" and next(r["lang_pred"] for r in found if r["doc_id"] == 5001) == "und"
    twice = [tuple(r)[2:] for r in found if r["doc_id"] == 7 and r["lang_pred"] == "en"]
    assert len(twice) >= 2 and twice[-1] == twice[-2]
