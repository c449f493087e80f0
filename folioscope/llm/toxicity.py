"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

P(grade > j) = sigmoid(w . x - t_j) with one weight vector for all ordered thresholds t_1 < t_2 <
t_3. The features are hashed words and beginnings of words that go with toxic labels (a bound on their odds and a
floor on their share), how many such words a text has, and how dense they are. The labels know toxic or
not, so the grades are derived: 0 not toxic; 1, 2 and 3 the toxic documents by thirds of the log-odds
that models fitted to the other folds of the sample give them. A grade is thus how sure others of
its kind make us that it is toxic, which is no feature; it stands in for a severity nobody labelled.

The model is fitted on about ``SAMPLE`` labelled documents, drawn by a hash of their id, and where
rows share ids also of their text; the drawn ids are broadcast. Every whole text is scored.

Defined cases: a null text counts as empty, with the features of no word; labels and documents of a
null id are not learned from, but scored; labels that are null are not learned from; contradicting
labels of one id count as one toxic label, and copies of a text as one document, toxic if one is;
repeated rows are scored alike; probabilities of exactly one half count as toxic; without both classes
everything has grade 0 and severity 0; a text of any length is hashed piece by piece; an empty table
gives an empty result; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.runtime import documents, utf8
from folioscope.llm.words import word_hashes

BITS = 20
#: About so many labelled documents fit the model.
SAMPLE = 20_000
GRADES = 4
#: A word is a feature if this share of the toxic documents has it (and at least LEAST of them), and
#: if the lower bound (Z deviations) of its odds of being in a toxic one is twice the odds at large.
SHARE, LEAST, Z = 0.03, 3, 1.96
FOLDS = 5
#: Bytes of the beginnings of words.
PREFIXES = (5, 6, 7)
TOXIC = 0.5
#: ASCII marks around a word are not part of it.
_MARKS = bytes.maketrans(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", b" " * 32)


def word_dims(texts: list[bytes]) -> Iterator[np.ndarray]:
    """Hashed words of each text and their beginnings, which hold the stems."""
    for words in word_hashes([t.translate(_MARKS) for t in texts], prefixes=PREFIXES):
        yield (words >> np.uint64(64 - BITS)).astype(np.int32)


def chosen_words(counted: list[tuple[int, int, int]], toxic: int, clean: int) -> np.ndarray:
    """Dims that go with toxic, given (dim, toxic documents, clean documents) that have each."""
    if not counted or not toxic or not clean:
        return np.zeros(0, np.int64)
    dim, a, b = np.array(counted, np.int64).T
    odds = np.log((a + 0.5) / (b + 0.5)) - Z * np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
    strong = (a >= max(LEAST, SHARE * toxic)) & (odds > np.log(2 * toxic / clean))
    return np.sort(dim[strong])


def features(dims: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Columns and values: chosen words by how often, then their number and their density."""
    at = np.searchsorted(words, dims)
    hit = at[(at < len(words)) & (words[np.minimum(at, len(words) - 1)] == dims)] if len(words) else np.zeros(0, int)
    column, n = np.unique(hit, return_counts=True)
    density = 100 * len(hit) / max(1, len(dims))
    return np.append(column, [len(words), len(words) + 1]), np.append(np.minimum(1.0, n), [np.log1p(len(hit)), np.log1p(density)])


def fit_ordinal(rows: list[tuple[np.ndarray, np.ndarray]], grade: np.ndarray, size: int, grades: int = GRADES, steps: int = 400, decay: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ascending thresholds that maximise the cumulative-link likelihood (Adam)."""
    row = np.repeat(np.arange(len(rows)), [len(c) for c, _ in rows])
    column, value = np.concatenate([c for c, _ in rows]), np.concatenate([v for _, v in rows])
    # Thresholds are a first one and logarithms of the gaps, so they stay in order.
    p = np.concatenate([np.zeros(size), [1.0], np.zeros(grades - 2)])
    first, second = np.zeros_like(p), np.zeros_like(p)
    n = len(rows)
    for step in range(1, steps + 1):
        gaps = np.exp(p[size + 1 :])
        limits = p[size] + np.concatenate([[0.0], np.cumsum(gaps)])
        margin = np.bincount(row, value * p[column], n)
        edge = np.concatenate([[-np.inf], limits, [np.inf]])
        upper, lower = edge[grade + 1] - margin, edge[grade] - margin
        a, b = 1 / (1 + np.exp(-np.clip(upper, -40, 40))), 1 / (1 + np.exp(-np.clip(lower, -40, 40)))
        a, b = np.where(np.isinf(upper), 1.0, a), np.where(np.isinf(lower), 0.0, b)
        chance = np.maximum(a - b, 1e-12)
        up, low = a * (1 - a) / chance, b * (1 - b) / chance
        slope = np.bincount(column, value * (up - low)[row], size) / n + decay * p[:size]
        by_limit = -(np.bincount(grade, up, grades)[: grades - 1] - np.bincount(grade, low, grades)[1:]) / n
        after = np.cumsum(by_limit[::-1])[::-1]
        g = np.concatenate([slope, [after[0]], after[1:] * gaps])
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        p -= 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
    return p[:size], p[size] + np.concatenate([[0.0], np.cumsum(np.exp(p[size + 1 :]))])


def out_of_fold(rows: list[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray, size: int, folds: int = FOLDS) -> np.ndarray:
    """Each row's log-odds of being toxic by a model of two grades that the row's fold had no part in."""
    fold = np.arange(len(rows)) % folds
    out = np.zeros(len(rows))
    for f in range(folds):
        own, rest = np.flatnonzero(fold == f), np.flatnonzero(fold != f)
        if len(rest) and toxic[rest].any() and not toxic[rest].all():
            weights, limits = fit_ordinal([rows[i] for i in rest], toxic[rest].astype(int), size, 2)
            out[own] = [value @ weights[column] - limits[0] for column, value in (rows[i] for i in own)]
    return out


def graded(toxic: np.ndarray, odds: np.ndarray, grades: int = GRADES) -> np.ndarray:
    """0 for clean documents; for toxic ones 1 to grades - 1 by equal parts of their odds."""
    cut = np.quantile(odds[toxic], np.arange(1, grades - 1) / (grades - 1)) if toxic.any() else np.zeros(grades - 2)
    return np.where(toxic, 1 + np.searchsorted(cut, odds, side="left"), 0)


def fit(rows: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict | None:
    """The model from (id, body) and (id, toxic)."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("id").isNotNull()).groupBy("id").agg(F.max("toxic").alias("toxic"))
    total = known.count()
    if total > sample:
        known = known.where(F.pmod(F.xxhash64("id", F.lit("toxicity sample")), F.lit(1 << 30)) < F.lit(int(sample / total * (1 << 30))))
    # The broadcast side has the sample's ids and labels only. Copies of a text count once.
    labelled = rows.join(F.broadcast(known), "id")
    there = rows.select("id").join(F.broadcast(known), "id").count()
    if there > 2 * sample:  # many rows of one id: their texts are drawn too
        labelled = labelled.where(F.pmod(F.xxhash64("id", "body"), F.lit(1 << 30)) < F.lit(int(sample / there * (1 << 30))))
    drawn = labelled.groupBy("body").agg(F.min("id").alias("id"), F.max("toxic").alias("toxic"))

    def count(batches):
        toxic, clean, n, seen = np.zeros(1 << BITS, np.int32), np.zeros(1 << BITS, np.int32), [0, 0], False
        for b in batches:
            seen = True
            for dims, bad in zip(word_dims(utf8(b["body"].tolist())), b["toxic"].tolist(), strict=True):
                (toxic if bad else clean)[np.unique(dims)] += 1
                n[not bad] += 1
        if seen:
            had = np.flatnonzero(toxic)
            yield pd.DataFrame({"dim": np.append(had, -1), "toxic": np.append(toxic[had], n[0]), "clean": np.append(clean[had], n[1])})
            rest = np.flatnonzero((clean > 0) & (toxic == 0))
            yield pd.DataFrame({"dim": rest, "toxic": 0, "clean": clean[rest]})

    sums = drawn.select("body", "toxic").mapInPandas(count, "dim int, toxic bigint, clean bigint").groupBy("dim").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    useful = sums.where((F.col("dim") < 0) | (F.col("toxic") >= LEAST)).collect()  # 2 ** BITS rows at most
    found = {r["dim"]: (r["toxic"], r["clean"]) for r in useful}
    toxic, clean = found.pop(-1, (0, 0))
    words = chosen_words([(d, *n) for d, n in sorted(found.items())], toxic, clean)
    if not toxic or not clean:
        return None
    shipped = rows.sparkSession.sparkContext.broadcast(words)

    def reduced(batches):
        for b in batches:
            every = [(dims, *features(dims, shipped.value)) for dims in word_dims(utf8(b["body"].tolist()))]
            yield pd.DataFrame({"id": [f"{i}" for i in b["id"]], "toxic": b["toxic"] > 0, "columns": [c for _, c, _ in every], "value": [v for _, _, v in every]})

    kept = drawn.mapInPandas(reduced, "id string, toxic boolean, columns array<int>, value array<double>").orderBy("id").collect()
    vectors = [(np.array(r["columns"], np.int64), np.array(r["value"])) for r in kept]
    bad = np.array([r["toxic"] for r in kept])
    weights, limits = fit_ordinal(vectors, graded(bad, out_of_fold(vectors, bad, len(words) + 2)), len(words) + 2)
    return {"words": words, "weights": weights, "limits": limits}


def score(rows: DataFrame, model: dict | None, columns: list[Column], grades: int = GRADES) -> DataFrame:
    """columns (named), severity (expected grade), p_toxic, grade and toxic for the text in column body."""
    shipped = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = shipped.value
        for b in batches:
            above = np.zeros((len(b), grades - 1))
            if own is not None:
                for i, dims in enumerate(word_dims(utf8(b["body"].tolist()))):
                    column, value = features(dims, own["words"])
                    above[i] = 1 / (1 + np.exp(-np.clip(value @ own["weights"][column] - own["limits"], -40, 40)))
            yield b.drop(columns="body").assign(severity=above.sum(axis=1), p_toxic=above[:, 0], grade=(above >= 0.5).sum(axis=1), toxic=above[:, 0] >= TOXIC)

    picked = rows.select(*columns, "body")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema if f.name != "body")
    return picked.mapInPandas(run, f"{schema}, severity double, p_toxic double, grade int, toxic boolean")


def grade_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", toxic_col: str = "toxic") -> DataFrame:
    """One row per document: id, severity, p_toxic, grade, toxic."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body"))
    model = fit(rows, labels.select(F.col(id_col).alias("id"), F.col(toxic_col).alias("toxic")))
    return score(rows, model, [F.col("id")]).withColumnRenamed("id", id_col)


def op4(spark, sf_dir: str) -> DataFrame:
    return grade_toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
